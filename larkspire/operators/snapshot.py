"""Incremental snapshots: reuse of unchanged chunks, stale and removed rows, change feeds, generations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspire.operators.log import CommitLog, Conflict
from larkspire.session import kept


def reuse_key(columns: list[str]) -> Column:
    """One narrow key for many columns; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def reused(candidate: DataFrame, previous: DataFrame, columns: list[str], inherited: list[str]) -> DataFrame:
    """candidate with the inherited columns of the previous row of equal key (the last by chunk_id) and whether there was one."""
    last = Window.partitionBy("__key").orderBy(F.desc("chunk_id"))
    old = previous.withColumn("__key", reuse_key(columns)).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    old = old.select("__key", *[F.col(c).alias(f"__{c}") for c in inherited], F.lit(True).alias("__hit"))
    joined = candidate.withColumn("__key", reuse_key(columns)).join(old, "__key", "left")
    hit = F.coalesce("__hit", F.lit(False))
    out = [c for c in candidate.columns if c not in inherited]
    return joined.select(*out, *[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c) if c in candidate.columns else F.lit(None)).alias(c) for c in inherited], hit.alias("reused"))


def stale(previous: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    return previous.join(current.select(key), key, "left_anti")


def changes(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """added, removed, changed or unchanged of each key."""
    a, b = previous.select(key, F.col(version).alias("__old")), current.select(key, F.col(version).alias("__new"))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def unchanged_documents(previous: DataFrame, remote: DataFrame) -> DataFrame:
    """external_id of the remote documents whose chunks all have the remote version."""
    have = previous.where("external_id <> ''").groupBy("external_id").agg(F.min("remote_version").alias("a"), F.max("remote_version").alias("b"))
    return remote.join(have, "external_id").where("a = b AND a = remote_version").select("external_id")


def apply_changes(previous: DataFrame, feed: DataFrame, key: str, order: str, kind: str = "kind", full_resync: bool = False) -> DataFrame:
    """The last change of each key wins; deletes remove; a full resync forgets what was there. feed: key, order, kind and previous's columns."""
    last = feed.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1")
    upserts = last.where(F.col(kind) == "upsert").select(*previous.columns)
    if full_resync:
        return upserts
    return previous.join(last.select(key), key, "left_anti").unionByName(upserts)


def numbered(rows: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """rows with their place (from 0) in a total order, without one task that sees them all: ranges are numbered on their own and shifted by the counts of those before."""
    spark = rows.sparkSession
    dealt = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part").count().orderBy("__part").collect()  # a row a range
    before, shifts = 0, []
    for r in counts:
        shifts.append((r["__part"], before))
        before += r["count"]
    known = F.broadcast(spark.createDataFrame(shifts, "__part int, __before long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(known, "__part").withColumn(name, F.col("__before") + place).drop("__part", "__before")


def outbox(ids: DataFrame, order: str, key: str, size: int = 500) -> DataFrame:
    """Distinct ids in order of first appearance, in batches of size."""
    first = ids.groupBy(key).agg(F.min(order).alias("__at"))
    return numbered(first, "__at", key).select(key, "position", F.floor(F.col("position") / size).alias("batch"))


def _folded(state: dict, commit: dict) -> dict:
    """Rows of generations or versions by name (null: gone), and the pointer."""
    rows = state.get("rows", {}) | commit.get("rows", {})
    out = {k: v for k, v in (state | commit).items() if k != "rows"}
    return out | {"rows": {k: v for k, v in rows.items() if v is not None}}


class Generations:
    """Versioned tables of a source: write a generation beside the active one, check it, swap a pointer.

    Every change is a commit of a CommitLog: readers resolve the pointer once and see whole generations, and of two writers
    that activate from the same state one gets a Conflict.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root, _folded)

    def active(self) -> str | None:
        return self.log.state()[1].get("active")

    def previous(self) -> str | None:
        """The generation that the active one was activated over."""
        return self.log.state()[1].get("previous")

    def stage(self, rows: DataFrame, generation: str) -> int:
        """Writes a generation under a new name and registers it as prepared; a repeated one replaces what was registered."""
        path = f"{self.root}/generation={generation}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).count()
        version, _ = self.log.state()
        self.log.commit({"rows": {generation: {"status": "prepared", "rows": n, "path": path}}}, version, lambda other: generation in other.get("rows", {}))
        return n

    def activate(self, generation: str, expected: str | None = None, rows: dict | None = None) -> None:
        """Only if the active generation is the expected one still, and this one has been prepared; rows are other changes of the same commit."""
        version, state = self.log.state()
        if state.get("active") != expected:
            raise Conflict("another generation has been activated meanwhile")
        if state["rows"].get(generation, {}).get("status") in (None, "staging"):
            raise RuntimeError("the generation isn't prepared")
        self.log.commit({"active": generation, "previous": expected, "rows": rows or {}}, version, lambda other: "active" in other or bool(set(other.get("rows", {})) & {generation, expected}))

    def rollback(self) -> None:
        version, state = self.log.state()
        self.log.commit({"active": state.get("previous"), "previous": None}, version)

    def path(self, generation: str) -> str:
        return self.log.state()[1]["rows"][generation]["path"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path(self.active()))
