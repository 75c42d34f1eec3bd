"""The engine's front: batches of queries with a plan, filters, a deadline and a trace."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspire.functions import text, vector
from larkspire.operators import retrieval
from larkspire.operators.filters import Filter
from larkspire.session import kept

# The names of plans, with those that they used to have.
PLANS = {"vector": "dense", "dense": "dense", "lexical": "lexical", "hybrid": "hybrid_rrf", "hybrid_rrf": "hybrid_rrf", "dense_sparse": "dense_sparse"}


class NotSupported(ValueError):
    pass


class DeadlineExceeded(TimeoutError):
    def __init__(self, stage: str, trace: dict):
        super().__init__(f"the deadline passed in {stage}")
        self.stage, self.trace = stage, trace


def plan(name: str | None = None, mode: str | None = None) -> str:
    found = PLANS.get((name or mode or "hybrid_rrf").strip().lower())
    if found is None:
        raise NotSupported(f"no plan {name or mode}; there are {sorted(set(PLANS.values()))}")
    return found


@dataclass(frozen=True)
class Fusion:
    """Weights and constant of the fusion inside the dense and sparse plan."""

    dense: float = 1.0
    sparse: float = 1.0
    k: int = 2

    def __post_init__(self):
        if self.dense <= 0 or self.sparse <= 0 or self.k <= 0:
            raise ValueError("weights and k must be positive")

    @property
    def contract_id(self) -> str:
        value = {"k": self.k, "method": "rrf", "weights": [float(self.dense), float(self.sparse)]}
        return f"fusion-{hashlib.sha256(json.dumps(value, sort_keys=True, separators=(',', ':')).encode()).hexdigest()[:24]}"


def fusions(pairs: str, k: int = 2) -> list[Fusion]:
    """Specifications from a list like 1:1,3:1, each once."""
    out: dict[Fusion, None] = {}
    for token in filter(None, (t.strip() for t in pairs.split(","))):
        a, sep, b = token.partition(":")
        if not sep:
            raise ValueError(f"{token} isn't dense:sparse")
        out[Fusion(float(a), float(b), k)] = None
    if not out:
        raise ValueError("at least one pair of weights")
    return list(out)


@dataclass(frozen=True)
class Request:
    top_k: int = 20
    plan: str = "hybrid_rrf"
    filters: Filter = field(default_factory=Filter)
    candidate_pool: int | None = None
    rerank: bool = True
    diversity: bool = False
    deadline_ms: int | None = None
    fusion: Fusion | None = None
    index_version: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "plan", plan(self.plan))
        for name in ("top_k", "candidate_pool", "deadline_ms"):
            value = getattr(self, name)
            if value is not None and int(value) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.index_version is not None and not self.index_version.strip():
            raise ValueError("index_version must not be empty")
        if self.fusion is not None and self.plan != "dense_sparse":
            raise ValueError("a fusion belongs to the plan dense_sparse")


class Budget:
    """A deadline over the stages of a request: what a stage starts runs in a job group that is cancelled when time is up."""

    def __init__(self, spark: SparkSession, deadline_ms: int | None, trace: dict):
        self.spark, self.trace, self.began = spark, trace, time.monotonic()
        self.left = lambda: None if deadline_ms is None else deadline_ms / 1000 - (time.monotonic() - self.began)

    def stage(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        left, began, sc = self.left(), time.monotonic(), self.spark.sparkContext
        if left is not None and left <= 0:
            raise DeadlineExceeded(name, self.trace)
        group, late = f"larkspire-{uuid.uuid4().hex}", threading.Event()

        def stop():
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(left, stop) if left is not None else None
        sc.setJobGroup(group, name, interruptOnCancel=True)
        try:
            if timer:
                timer.start()
            return run()
        except Exception as e:
            if late.is_set():
                raise DeadlineExceeded(name, self.trace) from e
            raise
        finally:
            if timer:
                timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
            self.trace["stage_ms"][name] = round((time.monotonic() - began) * 1000, 3)


def overlap_scorer(query: Column, body: Column) -> Column:
    """The reranker that needs no model: Jaccard similarity of the word sets."""
    return text.jaccard(text.word_set(query), text.word_set(body))


class Engine:
    """Search over chunks (chunk_id, doc_id, chunk_index, text, path, url, tenant_id, ...) and points (chunk_id, vector).

    Filters are applied to chunks before any candidate is scored, and to points through the chunks that they belong to.
    """

    def __init__(self, chunks: DataFrame, points: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, reranker: Callable[[Column, Column], Column] | None = overlap_scorer, hash_embedder: bool = False):
        self.spark, self.chunks, self.points, self.embed, self.reranker, self.hash_embedder = chunks.sparkSession, chunks, points, embed, reranker, hash_embedder

    def _visible(self, request: Request) -> tuple[DataFrame, DataFrame | None]:
        if request.filters == Filter():
            return self.chunks, self.points
        rows = request.filters.apply(self.chunks)
        return rows, self.points and self.points.join(rows.select("chunk_id"), "chunk_id", "left_semi")

    def _asked(self, queries: DataFrame) -> DataFrame:
        q = queries.where(F.trim("query") != "")
        return q if "vector" in q.columns or self.embed is None else q.withColumn("vector", self.embed(F.col("query")))

    def search(self, queries: DataFrame, request: Request | None = None) -> tuple[DataFrame, dict]:
        """Results (query_id, rank, chunk_id, doc_id, score, citation) of queries (query_id, query and, without an embedder, vector), and a trace."""
        request = request or Request()
        pool = retrieval.pool(request.top_k, request.candidate_pool)
        trace = {"plan": request.plan, "candidate_pool": pool, "deadline_ms": request.deadline_ms, "stage_ms": {}, "candidates": {}, "rerank": request.rerank, "diversity": request.diversity, "index_version": request.index_version}
        budget = Budget(self.spark, request.deadline_ms, trace)
        chunks, points = self._visible(request)
        asked = self._asked(queries)
        if request.plan != "lexical" and (points is None or "vector" not in asked.columns):
            raise NotSupported(f"the plan {request.plan} needs points and query vectors")
        ranked = self._candidates(asked, chunks, points, request, pool, budget, trace)
        if request.rerank and self.reranker is not None:
            ranked = self._reranked(ranked, asked, chunks, pool)
        if request.diversity:
            rows = chunks.select("chunk_id", "text").join(ranked, "chunk_id")
            ranked = retrieval.diversified(rows.select(*ranked.columns, "text")).drop("text")
        final = retrieval.top(ranked.withColumn("__order", -F.col("rank")).drop("rank"), request.top_k, "__order").drop("__order")
        out = retrieval.materialised(final.select("query_id", "chunk_id", "rank", "score"), chunks)
        return budget.stage("results", lambda: kept(out.select("query_id", "rank", "chunk_id", "doc_id", "score", "citation"), "results")), trace

    def _candidates(self, asked, chunks, points, request, pool, budget, trace) -> DataFrame:
        def branch(name: str, run: Callable[[], DataFrame]) -> DataFrame:
            seen = Observation(f"{name}-{uuid.uuid4().hex}")  # counted by the job that writes the branch
            found = budget.stage(name, lambda: kept(run().observe(seen, F.count(F.lit(1)).alias("rows")), name))
            trace["candidates"][name] = seen.get["rows"]
            return found

        if request.plan == "lexical":
            return branch("lexical", lambda: retrieval.lexical(asked, chunks, pool))
        if self.hash_embedder:  # vectors of hashed ASCII words say nothing about a question in CJK
            asked_dense = asked.where(~text.contains_cjk(F.col("query")))
        else:
            asked_dense = asked
        if request.plan == "dense":
            return branch("dense", lambda: retrieval.dense(asked_dense, points, pool))
        if request.plan == "dense_sparse":
            f = request.fusion or Fusion()
            trace["fusion"] = f.contract_id
            d = branch("dense", lambda: retrieval.dense(asked_dense, points, 4 * pool))
            s = branch("sparse", lambda: retrieval.sparse(asked, chunks, 4 * pool))
            return retrieval.rrf(d, s, pool, f.dense, f.sparse, f.k).select("query_id", "chunk_id", "rank", "score")
        d = branch("dense", lambda: retrieval.dense(asked_dense, points, pool))
        x = branch("lexical", lambda: retrieval.lexical(asked, chunks, pool))
        told = retrieval.told(asked, d, x, chunks)
        weights = retrieval.policy(told, self.hash_embedder).select("query_id", "dense_weight", "lexical_weight")
        return retrieval.rrf(d.join(weights, "query_id"), x.join(weights, "query_id"), pool, F.col("dense_weight"), F.col("lexical_weight")).select("query_id", "chunk_id", "rank", "score")

    def _reranked(self, ranked: DataFrame, asked: DataFrame, chunks: DataFrame, pool: int) -> DataFrame:
        """The first pool rows of each query by the reranker's score; ties by the rank before."""
        rows = chunks.select("chunk_id", "text").join(ranked, "chunk_id").join(asked.select("query_id", "query"), "query_id")  # Spark broadcasts by the size of what has been stored
        scored = rows.where(F.col("rank") <= pool).withColumn("__new", self.reranker(F.col("query"), F.col("text")))
        order = F.struct(F.col("__new"), -F.col("rank"))
        return retrieval.top(scored.withColumn("__order", order).drop("rank"), pool, "__order").select("query_id", "chunk_id", "rank", F.col("__new").alias("score"))


def hash_engine(chunks: DataFrame, dim: int = 128) -> Engine:
    """An engine whose vectors are hashed words, for chunks without points."""
    embed = vector.hash_embedding(dim)
    return Engine(chunks, chunks.select("chunk_id", embed(F.col("text")).alias("vector")), embed, hash_embedder=True)
