"""Retirement of uploaded objects as a mark and sweep.

Marking counts the references to every object of the inventory by a full join and gives each its next state. Sweeping
deletes what has been unreferenced for the retention, in tasks, and can be taken up again: a manifest names what is to go
before anything goes, a file that is gone already counts as deleted, and the states change only by what tasks report.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspire.operators.log import CommitLog

DAY = 24 * 3600


def marked(inventory: DataFrame, references: DataFrame, now: Column) -> DataFrame:
    """inventory (object_id, tenant_id, state, created_at, retired_at, ...) with ref_count and the state that follows: referenced ones are active, others retired from now on (or as before). Deleted ones stay deleted. references: object_id, tenant_id, one row a use; uses of another tenant don't count, and those of unknown objects are dangling."""
    uses = references.groupBy("object_id", "tenant_id").agg(F.count("*").alias("ref_count"))
    both = inventory.drop("ref_count").withColumn("__i", F.lit(True)).join(uses, ["object_id", "tenant_id"], "full_outer")
    count, gone = F.coalesce("ref_count", F.lit(0)), F.col("state") == "deleted"
    state = F.when(F.col("__i").isNull(), "dangling").when(gone, "deleted").when(count > 0, "active").when(F.col("state") == "orphaned", "orphaned").otherwise("retired")
    at = F.when(gone, F.col("retired_at")).when((count > 0) | F.col("__i").isNull(), F.lit(None)).when(F.col("state") == "orphaned", F.col("retired_at")).otherwise(F.coalesce("retired_at", now))
    return both.withColumns({"ref_count": count, "retired_at": at, "state": state}).drop("__i")


def due(objects: DataFrame, now: Column, retention_seconds: int = DAY, tenant_id: str | None = None) -> DataFrame:
    """Objects to delete: orphaned or retired, without references, since the retention."""
    rows = objects if tenant_id is None else objects.where(F.col("tenant_id") == tenant_id)
    cutoff = now - F.make_dt_interval(secs=F.lit(retention_seconds).cast("decimal(18,6)"))
    return rows.where(F.col("state").isin("orphaned", "retired") & (F.col("ref_count") == 0) & (F.coalesce("retired_at", "created_at") <= cutoff))


class Sweep:
    """Deletes the files (storage_path) of objects that are due, below a folder for its manifests."""

    def __init__(self, spark, root: str, delete=None):
        """delete(path): in tasks; by default from a filesystem that tasks share."""
        self.spark, self.root, self.delete = spark, root.rstrip("/"), delete or _delete
        self.log = CommitLog(spark, f"{self.root}/sweeps")

    def run(self, objects: DataFrame, now: Column, retention_seconds: int = DAY) -> DataFrame:
        """(object_id, deleted, error) of this sweep. One that stopped half-way is taken up again first, whatever is due by now."""
        at, state = self.log.state()
        manifest = state.get("open")
        if not manifest:
            manifest = f"{self.root}/manifest-{at + 1:08d}"
            due(objects, now, retention_seconds).select("object_id", "storage_path").write.mode("overwrite").parquet(manifest)
            at = self.log.commit({"open": manifest}, at)
        delete = self.delete

        def gone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i, path in zip(pdf["object_id"], pdf["storage_path"], strict=True):
                    try:
                        delete(path)
                        rows.append((i, True, None))
                    except FileNotFoundError:
                        rows.append((i, True, None))
                    except Exception as e:
                        rows.append((i, False, str(e)[:500]))
                yield pd.DataFrame(rows, columns=["object_id", "deleted", "error"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        todo = self.spark.read.parquet(manifest).select("object_id", "storage_path").repartition(parts, "object_id")
        done = todo.mapInPandas(gone, "object_id string, deleted boolean, error string")
        done.write.mode("overwrite").parquet(f"{manifest}-done")
        self.log.commit({"open": None, "last": manifest}, at)
        return self.spark.read.schema("object_id string, deleted boolean, error string").parquet(f"{manifest}-done")


def swept(objects: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """objects after a sweep: those that were deleted are so."""
    d = done.where("deleted").select("object_id", F.lit(True).alias("__d")).distinct()
    hit = F.coalesce("__d", F.lit(False)) & F.col("state").isin("orphaned", "retired")
    return objects.join(d, "object_id", "left").withColumns({"retired_at": F.when(hit, F.coalesce("retired_at", now)).otherwise(F.col("retired_at")), "state": F.when(hit, "deleted").otherwise(F.col("state"))}).drop("__d")


def _delete(path: str) -> None:
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") or "://" not in path else fs.FileSystem.from_uri(path)
    where.delete_file(name)
