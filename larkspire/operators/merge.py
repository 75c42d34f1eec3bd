"""Tables by key that are merged on read: an upsert writes its batch alone.

Base and deltas are bucketed Spark tables (files dealt by the hash that a shuffle would use), registered in the session's
catalog when they are read. A batch becomes a delta, its place among the deltas is that of its commit, deletions are rows
that carry the key alone, and nothing that is there is rewritten. A reader takes, for each key, the newest row: the base is
read as it lies, without a shuffle or a sort, against a hash table of the deltas' keys in its bucket; only the deltas, which
are small beside it, are aggregated. compact() writes a new base of what a reader sees, while readers go on with the old
files. Commits go through a CommitLog: two writers of different batches both win, in the order of their commits; of two
compactions one gives way. Keys can't be null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspire.operators.log import CommitLog, Conflict

BUCKETS = 16
SEQUENCE, DELETED = "__sequence", "__deleted"


def _fold(state: dict, commit: dict) -> dict:
    out = {"schema": commit.get("schema", state.get("schema")), "keys": commit.get("keys", state.get("keys")), "buckets": commit.get("buckets", state.get("buckets"))}
    gone = set(commit.get("remove", ()))
    out["base"] = commit.get("base", state.get("base"))
    out["deltas"] = [d for d in state.get("deltas", []) if d not in gone] + commit.get("add", [])
    return out


class MergeTable:
    """A table below a folder. create() once, then upsert(), delete(), read(), compact()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root, _fold)

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> MergeTable:
        """A new table of rows; of rows with equal keys one stays, the last by all its columns."""
        t = cls(spark, root)
        version, _ = t.log.state()
        if version:
            raise Conflict("the table is there already")
        schema = rows.schema.json()
        state = {"schema": schema, "keys": keys, "buckets": buckets}
        path = t._write(t._last(rows, keys, None).withColumns({DELETED: F.lit(False)}), state)
        t.log.commit(state | {"base": path, "add": []}, 0)
        return t

    def _last(self, rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
        """One row for each key. Without order it is the greatest by all columns, so that a repeated run makes the same choice."""
        by = [F.desc(order)] if order else []
        w = Window.partitionBy(*keys).orderBy(*by, *[F.desc_nulls_last(F.to_json(F.struct(F.col(f"`{c}`")))) for c in rows.columns if c not in keys])
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def _write(self, rows: DataFrame, state: dict) -> str:
        """Rows with DELETED in one file a bucket, below a new name that no reader knows before the commit."""
        keys, n = state["keys"], state["buckets"]
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        sure = {k: F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.raise_error(F.lit(f"the key {k} is null"))) for k in keys}
        rows.withColumns(sure).repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(self._name(path))
        return path

    @staticmethod
    def _name(path: str) -> str:
        return f"larkspire_{path.rpartition('/')[2]}"

    def _files(self, path: str, schema: StructType, state: dict) -> DataFrame:
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(f'`{k}`' for k in state['keys'])}) INTO {state['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _delta(self, rows: DataFrame) -> int:
        version, state = self.log.state()
        return self.log.commit({"add": [self._write(rows, state)]}, version, lambda other: False)

    def upsert(self, batch: DataFrame, order: str | None = None) -> int:
        """Inserts the batch's rows, or puts them in place of those of equal key; columns that the batch lacks keep what is there. Of several rows of a key the last by order counts. Gives the commit's number."""
        _, state = self.log.state()
        columns, keys = StructType.fromJson(json.loads(state["schema"])).names, state["keys"]
        last = self._last(batch, keys, order)
        rest = [c for c in columns if c not in batch.columns]
        if rest:
            last = last.select(*[c for c in columns if c in batch.columns]).join(self.read().select(*keys, *rest), keys, "left")
        return self._delta(last.select(*columns, F.lit(False).alias(DELETED)))

    def delete(self, gone: DataFrame) -> int:
        """Deletes by key: a row for each key, without the other columns."""
        _, state = self.log.state()
        schema = StructType.fromJson(json.loads(state["schema"]))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in state["keys"] else F.col(f.name) for f in schema]
        return self._delta(gone.select(*state["keys"]).distinct().select(*empty, F.lit(True).alias(DELETED)))

    def read(self, version: int | None = None) -> DataFrame:
        """The table after its last commit, or as it was after an earlier one."""
        _, state = self.log.state(version)
        return self._merged(state).where(f"NOT {DELETED}").drop(DELETED)

    def _merged(self, state: dict) -> DataFrame:
        """Base rows without a newer one, and the newest row of each key of the deltas."""
        keys = state["keys"]
        full = StructType(list(StructType.fromJson(json.loads(state["schema"])).fields)).add(DELETED, "boolean")
        base = self._files(state["base"], full, state)
        if not state["deltas"]:
            return base
        deltas = None
        for n, path in enumerate(state["deltas"]):
            d = self._files(path, full, state).withColumn(SEQUENCE, F.lit(n))
            deltas = d if deltas is None else deltas.unionByName(d)
        newest = deltas.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in full.names if c not in keys]), SEQUENCE).alias("__row")).select(*keys, "__row.*")
        old = base.join(newest.select(*keys).hint("shuffle_hash"), keys, "left_anti")
        return old.select(*full.names).unionByName(newest)

    def compact(self) -> int:
        """Writes what a reader sees as a new base. Deltas that other writers commit meanwhile stay deltas; another compaction is a Conflict."""
        version, state = self.log.state()
        path = self._write(self._merged(state).where(f"NOT {DELETED}"), state)
        return self.log.commit({"base": path, "remove": state["deltas"]}, version, lambda other: "base" in other)

    def vacuum(self) -> list[str]:
        """Deletes files that no commit from the current state on names: those of compacted deltas and of writers that failed. Readers of older versions lose them."""
        _, state = self.log.state()
        live = {state["base"], *state["deltas"]}
        folder = self.log._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        gone = []
        for f in self.log._fs.listStatus(folder) if self.log._fs.exists(folder) else []:
            path = f"{self.root}/data/{f.getPath().getName()}"
            if path not in live:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
                self.log._fs.delete(f.getPath(), True)
                gone.append(path)
        return gone


def history(table: MergeTable) -> Iterator[tuple[int, dict]]:
    """Each version's number and state, from the first."""
    for n in range(1, table.log.version() + 1):
        yield n, table.log.state(n)[1]
