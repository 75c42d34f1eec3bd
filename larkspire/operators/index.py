"""Index versions: a corpus embedded anew beside the one that serves, validated, and switched by a pointer.

A registry is a table of versions (one row each, so it is small) with its state in status: building, validating, ready,
active, retired, failed. The pointer says which version readers see. Registry and
pointer are one commit log: an activation changes both at once, and is refused if another one came first.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.operators import quality
from larkspire.operators.snapshot import Generations

_NEXT = {"building": {"validating", "failed"}, "failed": {"building"}, "validating": {"ready", "failed"}, "ready": {"active", "retired"}, "active": {"retired"}, "retired": {"active"}}


class IndexVersions:
    """The versions below a folder, with their vectors as tables and a pointer file."""

    def __init__(self, spark: SparkSession, root: str, embedders: dict[str, tuple], now=lambda: datetime.now(UTC)):
        """embedders: contract id -> (a pandas UDF text -> vector, its dimension)."""
        self.spark, self.root, self.embedders, self.now = spark, root.rstrip("/"), embedders, now
        self.files = Generations(spark, self.root)

    def _versions(self) -> dict[str, dict]:
        return self.files.log.state()[1].get("rows", {})

    def _set(self, version: str, **values) -> dict:
        """One commit; a writer that has changed the same version meanwhile wins."""
        at, state = self.files.log.state()
        row = self._next(state.get("rows", {}).get(version, {}), version, values)
        self.files.log.commit({"rows": {version: row}}, at, lambda other: version in other.get("rows", {}))
        return row

    @staticmethod
    def _next(row: dict, version: str, values: dict) -> dict:
        status = values.get("status", row.get("status"))
        if row and status != row["status"] and status not in _NEXT[row["status"]]:
            raise ValueError(f"{version} can't go from {row['status']} to {status}")
        return row | values

    def table(self) -> DataFrame:
        rows = [(v, x["status"], x["contract"], x["dimension"], x.get("vectors"), x.get("delete_after")) for v, x in sorted(self._versions().items())]
        return self.spark.createDataFrame(rows, "version string, status string, contract string, dimension int, vectors long, delete_after string")

    def active(self) -> str | None:
        return self.files.active()

    def create(self, version: str, contract: str) -> None:
        if version in self._versions():
            raise ValueError(f"{version} is there already")
        self._set(version, status="building", contract=contract, dimension=self.embedders[contract][1])

    @staticmethod
    def fingerprint(chunks: DataFrame) -> dict:
        r = quality.fingerprint(chunks).first()
        return {"rows": r["rows"], "xor": r["xor"], "total": str(r["total"])}

    def build(self, version: str, chunks: DataFrame) -> int:
        """Embeds all chunks (chunk_id, doc_id, checksum, text); fails if the catalog changes meanwhile or a vector hasn't the contract's dimension."""
        row = self._versions()[version]
        if row["status"] == "failed":
            row = self._set(version, status="building")
        if row["status"] != "building":
            raise ValueError(f"{version} is {row['status']}")
        embed, dimension = self.embedders[row["contract"]]
        before = self.fingerprint(chunks)
        try:
            vector = F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit("a vector of another dimension")))
            made = chunks.select("chunk_id", "doc_id", embed(F.col("text")).alias("vector")).withColumn("vector", vector)
            path = f"{self.root}/version={version}/{uuid.uuid4().hex}"
            made.write.parquet(path)
            n = self.spark.read.schema(made.schema).parquet(path).count()
            if n != before["rows"] or self.fingerprint(chunks) != before:
                raise RuntimeError("the catalog has changed while the index was built")
        except Exception as e:
            self._set(version, status="failed", error=str(e)[:500])
            raise
        self._set(version, status="validating", vectors=n, fingerprint=before, path=path)
        return n

    def mark_ready(self, version: str, evidence: dict, approved: bool, chunks: DataFrame) -> None:
        if not evidence or not approved:
            raise ValueError("a version needs evidence and approval")
        self._current(version, chunks)
        self._set(version, status="ready", evidence=json.loads(json.dumps(evidence)))

    def _current(self, version: str, chunks: DataFrame) -> None:
        if self._versions()[version].get("fingerprint") != self.fingerprint(chunks):
            raise RuntimeError("the catalog has changed since the index was built")

    def activate(self, version: str, chunks: DataFrame, expected: str | None = None, keep: timedelta = timedelta(days=7)) -> None:
        """Readers see the version from now on; the one before is kept for a while."""
        if self._versions()[version]["status"] not in ("ready", "retired"):
            raise ValueError("a version must be ready, or retired to go back to")
        self._current(version, chunks)
        every = self._versions()
        rows = {version: self._next(every[version], version, {"status": "active", "delete_after": None})}
        if expected and expected in every:
            rows[expected] = self._next(every[expected], expected, {"status": "retired", "delete_after": (self.now() + keep).isoformat()})
        self.files.activate(version, expected, rows)  # the pointer and both rows in one commit

    def rollback(self, target: str, chunks: DataFrame) -> None:
        self.activate(target, chunks, self.active())

    def reconcile(self) -> str:
        """The registry after the pointer, should they differ: consistent or repaired."""
        at, state = self.files.log.state()
        seen, every = state.get("active"), state.get("rows", {})
        if seen is not None and seen not in every:
            raise RuntimeError("the pointer names a version that isn't registered")
        wrong = [v for v, x in every.items() if (x["status"] == "active") != (v == seen)]
        if wrong:
            self.files.log.commit({"rows": {v: every[v] | {"status": "active" if v == seen else "retired"} for v in wrong}}, at)
        return "repaired" if wrong else "consistent"

    def prune(self) -> list[str]:
        """Deletes retired versions whose time is over: first they leave the registry, then their files go."""
        at, state = self.files.log.state()
        every, now = state.get("rows", {}), self.now().isoformat()
        gone = [v for v, x in every.items() if x["status"] == "retired" and x.get("delete_after") and x["delete_after"] <= now and v != state.get("active")]
        if gone:
            self.files.log.commit({"rows": dict.fromkeys(gone)}, at, lambda other: "active" in other or bool(set(other.get("rows", {})) & set(gone)))
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            for v in gone:
                where = path(every[v]["path"])
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return gone

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.files.path(version or self.active()))


def prunable(versions: DataFrame, now: Column) -> DataFrame:
    """Retired versions whose time is over."""
    return versions.where((F.col("status") == "retired") & (F.col("delete_after") <= now))


def switched(versions: DataFrame, target: str, now: Column, keep_days: int = 7) -> DataFrame:
    """The registry after target has been activated: it is active, the one before is retired and kept for keep_days."""
    was = (F.col("status") == "active") & (F.col("version") != target)
    until = now + F.make_dt_interval(days=F.lit(keep_days))
    return versions.withColumns({
        "delete_after": F.when(F.col("version") == target, F.lit(None)).when(was, until).otherwise(F.col("delete_after")),
        "status": F.when(F.col("version") == target, "active").when(was, "retired").otherwise(F.col("status")),
    })
