"""Ingestion from end to end: reuse against the active generation, embedding through a cache, staging, activation, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspire.operators import ingest
from larkspire.operators.lexindex import LexicalIndex
from larkspire.operators.log import Conflict
from larkspire.operators.merge import MergeTable
from larkspire.operators.snapshot import Generations
from larkspire.session import bounded, kept


class EmbeddingCache:
    """Vectors by contract and SHA-256 of the text, kept across runs in a table that is merged on read.

    A run looks up its distinct texts (an equi-join on the key, for which Spark makes a runtime Bloom filter of the run's
    keys where the cache is large), embeds those that aren't there, and writes back what it embedded and when it used what.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedded = spark.sparkContext.accumulator(0)  # texts that an embedder has been asked for

    def table(self) -> MergeTable:
        t = MergeTable(self.spark, self.root)
        if not t.log.version():
            try:
                t = MergeTable.create(self.spark, self.root, self.spark.createDataFrame([], "contract string, key string, vector array<double>, used timestamp_ntz"), ["contract", "key"])
            except Conflict:  # another run has made it meanwhile
                pass
        return t

    def vectors(self, rows: DataFrame, embed, contract: str, now: Column, body: str = "text", out: str = "vector", prefix: str = "") -> DataFrame:
        """rows with the vector of each text under a contract (model, dimension and instruction by name)."""
        t, told = self.table(), self.embedded
        key = F.sha2(F.coalesce(body, F.lit("")), 256)
        once = rows.select(key.alias("key"), F.coalesce(body, F.lit("")).alias("__t")).dropDuplicates(["key"])
        known = t.read().where(F.col("contract") == contract).select("key", F.col("vector").alias("__known"))
        found = kept(once.join(known, "key", "left"), "looked-up")
        missing = found.where("__known IS NULL")

        def counted(batches):
            for b in batches:
                told.add(b.num_rows)
                yield b

        asked = bounded(missing.select("key", "__t")).mapInArrow(counted, "key string, __t string")
        made = kept(asked.select("key", embed(F.concat(F.lit(prefix), F.col("__t"))).cast("array<double>").alias("vector")), "embedded")
        every = found.where("__known IS NOT NULL").select("key", F.col("__known").alias("vector")).unionByName(made)
        t.upsert(every.select(F.lit(contract).alias("contract"), "key", "vector", now.cast("timestamp_ntz").alias("used")))
        return rows.withColumn("__k", key).join(every.select(F.col("key").alias("__k"), F.col("vector").alias(out)), "__k").drop("__k")

    def evict(self, unused_since: Column) -> int:
        """Deletes vectors that no run has used since then; gives the commit's number."""
        t = self.table()
        return t.delete(t.read().where(F.col("used") < unused_since.cast("timestamp_ntz")))


class Corpus:
    """The chunks of a source as generations, with their index and vectors.

    run() is one ingestion: it writes a generation beside the active one, activates it if that is still the one it started
    from (a Conflict otherwise, and nothing has changed), and brings the index to it. A run that stops before the activation
    leaves what readers see as it was; one that stops after it leaves the index behind, and the next repair() or run() brings
    it up, since chunk ids say their content.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.generations = Generations(spark, f"{self.root}/chunks")
        self.index = LexicalIndex(spark, f"{self.root}/index")
        self.cache = EmbeddingCache(spark, f"{self.root}/vectors")

    def run(self, candidate: DataFrame, source: dict, generation_id: str, now: Column, previous: DataFrame, existing: DataFrame, embed=None, contract: str = "hash") -> ingest.Outcome:
        """candidate: doc_id, chunk_index, text, checksum, path, url. previous and existing are what counts as the last snapshot before the first generation."""
        expected = self.generations.active()
        if expected is not None:
            previous = self.generations.read()
            existing = previous.groupBy("doc_id").agg(F.max("document_version").alias("version"))
        out = ingest.ingested(candidate, previous, existing, source, generation_id, now, versions=True)
        rows = out.current.where("doc_id IS NOT NULL")
        if embed is not None:
            rows = self.cache.vectors(rows, embed, contract, now)
        self.generations.stage(rows, generation_id)
        self.generations.activate(generation_id, expected)
        self.repair()
        return out

    def repair(self) -> None:
        """The index after the active generation, if it is behind. Where it has the one before, only chunks that weren't taken over can be new to it."""
        active, before = self.generations.active(), self.generations.previous()
        if active is None:
            return
        path, state = self.generations.path(active), self.index.log.state()[1]
        if (state.get("note"), state.get("source")) != (active, path):
            rows, has = self.generations.read(), state.get("source")
            fresh = rows.where("NOT reused").select("chunk_id", "text") if has and before and has == self.generations.path(before) else None
            self.index.sync(rows.select("chunk_id", "text"), active, rows.select("chunk_id", "vector") if "vector" in rows.columns else None, fresh, path)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.search(queries, k)
