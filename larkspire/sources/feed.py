"""Change feeds as a Python data source: a connector's splits are read side by side, as a batch or as a stream.

A connector has splits (folders, pages, prefixes), each an append-only list of changes (kind, external_id, version, record
as JSON): splits() names them, latest(split) says how many changes a split has, between(split, a, b) gives those from place
a to b. The stream's offset is a place for each split, so a batch that is read again after a crash gives the same rows, and
a task reads a slice of one split. commit() tells a connector that has promote() up to where rows have been published.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "kind string, external_id string, remote_version string, record string, split string, position long"
ROWS = 10_000  # of a task's slice


def _connector(options):
    module, _, name = options["connector"].partition(":")
    return getattr(importlib.import_module(module), name)(json.loads(options.get("config", "{}")))


class _Slice(InputPartition):
    def __init__(self, split: str, start: int, end: int):
        super().__init__((split, start, end))
        self.split, self.start, self.end = split, start, end


def _slices(start: dict, end: dict, rows: int) -> list[_Slice]:
    return [_Slice(s, a, min(a + rows, end[s])) for s in sorted(end) for a in range(start.get(s, 0), end[s], rows)]


def _read(options, part: _Slice) -> Iterator[tuple]:
    for n, change in enumerate(_connector(options).between(part.split, part.start, part.end), part.start):
        yield (*change, part.split, n)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        c = _connector(self.options)
        return _slices({}, {s: c.latest(s) for s in c.splits()}, int(self.options.get("rows", ROWS)))

    def read(self, partition) -> Iterator[tuple]:
        return _read(self.options, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        c = _connector(self.options)
        return {s: c.latest(s) for s in c.splits()}

    def partitions(self, start: dict, end: dict):
        return _slices(start, end, int(self.options.get("rows", ROWS)))

    def read(self, partition) -> Iterator[tuple]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        c = _connector(self.options)
        if hasattr(c, "promote"):
            c.promote(end)


class ChangeFeed(DataSource):
    """spark.dataSource.register(ChangeFeed); spark.read.format("change_feed").option("connector", "module:Class")."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


class ListConnector:
    """A connector over lists of changes in its configuration: changes, or splits of them by name."""

    def __init__(self, config):
        self.lists = config.get("splits") or {"": config["changes"]}

    def splits(self) -> list[str]:
        return list(self.lists)

    def latest(self, split: str) -> int:
        return len(self.lists[split])

    def between(self, split: str, start: int, end: int) -> Iterator[tuple]:
        return map(tuple, self.lists[split][start:end])


def _files(root: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if root.startswith("file:") or "://" not in root else fs.FileSystem.from_uri(root)


class FolderConnector:
    """Changes as Parquet files that exported() has appended below a folder, a subfolder for each split: exports in order of their numbers, rows in the order of their file. promote() notes how far each split has been published."""

    def __init__(self, config):
        self.fs, self.path = _files(config["root"])

    def _listed(self, path: str) -> list:
        from pyarrow import fs

        return sorted(self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.base_name)

    def splits(self) -> list[str]:
        return sorted({f.base_name for e in self._listed(self.path) if e.base_name.startswith("export-") for f in self._listed(e.path) if f.base_name.startswith("split=")})

    def _parts(self, split: str) -> list[str]:
        return [f.path for e in self._listed(self.path) if e.base_name.startswith("export-") for f in self._listed(f"{e.path}/{split}") if f.base_name.endswith(".parquet")]

    def latest(self, split: str) -> int:
        import pyarrow.parquet as pq

        return sum(pq.read_metadata(p, filesystem=self.fs).num_rows for p in self._parts(split))

    def between(self, split: str, start: int, end: int) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        at = 0
        for p in self._parts(split):
            with self.fs.open_input_file(p) as opened:
                f = pq.ParquetFile(opened)
                n = f.metadata.num_rows
                if at + n <= start or at >= end:  # its rows are other tasks' rows
                    at += n
                    continue
                for b in f.iter_batches(1000, columns=["kind", "external_id", "remote_version", "record"]):
                    for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        if start <= at < end:
                            yield row
                        at += 1

    def promote(self, end: dict) -> None:
        with self.fs.open_output_stream(f"{self.path}/published.json") as out:
            out.write(json.dumps(end, sort_keys=True).encode())


def exported(changes: DataFrame, root: str, number: int, order: list[str]) -> None:
    """Appends changes (kind, external_id, remote_version, record, split) as the export of a number: each split in order, in one file."""
    one = changes.repartition("split").sortWithinPartitions("split", *order)
    one.select("kind", "external_id", "remote_version", "record", "split").write.partitionBy("split").parquet(f"{root}/export-{number:08d}")


def stream(spark: SparkSession, connector: str, config: dict, **options: str) -> DataFrame:
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").options(connector=connector, config=json.dumps(config), **options).load()
