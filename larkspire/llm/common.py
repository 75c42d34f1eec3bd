"""What the operators of this subpackage share: tables, the shared folder and files in it."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch on its way to Python: whole texts are long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master (in tests) a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Written as a table in the shared folder and read back: cuts the lineage, survives lost executors. Tables of stored() in spent are deleted after that."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    discard(*spent)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for t in tables:
        path = t is not None and t.__dict__.pop("stored_at", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What worker processes keep from task to task, by operator: a function that empties it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, empty: Callable[[], None]) -> None:
    """An operator's tables that outlive a task in a worker process; they go when a task of another operator starts there."""
    _kept[owner] = empty


def trimmed() -> None:
    """Memory that is free goes back to the system, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_worker(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """run over batches, in a worker that keeps the owner's tables alone."""

    def task(batches: Iterator) -> Iterator:
        others = [_kept.pop(name) for name in list(_kept) if name != owner]
        for empty in others:
            empty()
        if others:
            gc.collect()
            trimmed()
        yield from run(batches)
        trimmed()

    return task


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, owner: str = "") -> DataFrame:
    """mapInPandas in batches bounded by rows and bytes."""
    bounded_batches(df.sparkSession)
    return df.mapInPandas(in_worker(run, owner), schema)


def mapped_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "") -> DataFrame:
    """mapInArrow in batches bounded likewise."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(in_worker(run, owner), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def filesystem(uri: str):
    """(filesystem, path) of a URI in the shared folder, local or remote; used on the executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def key(col):
    """An integer key on its way to Python: as text, since a nullable integer column would become floating point there."""
    return col.cast("long").cast("string")


def keyed(x: str | None) -> int | None:
    return int(x) if isinstance(x, str) else None


def ints(values) -> pd.api.extensions.ExtensionArray:
    """A nullable integer column on its way back."""
    return pd.array(list(values), dtype="Int64")


def commit_bytes(uri: str, chunks) -> None:
    """Writes chunks under a temporary name of this attempt and then renames: readers see whole files only, retries replace them."""
    where, path = filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.tmp-{uuid.uuid4().hex}"
    with where.open_output_stream(temp, compression=None) as out:
        for c in chunks:
            out.write(c)
    where.move(temp, path)
