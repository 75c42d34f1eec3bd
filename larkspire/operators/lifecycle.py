"""Index versions, shadow comparison, schedules, failures, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspire.operators.catalog import next_window

# HTTP states that are tried again, and words of failures that aren't. One further marker of the
# original list, and the name in another, are an application's own and left out.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
FENCED = ("source lifecycle generation changed", "source is deleted during ingestion", "source disappeared during ingestion", "source tenant changed during ingestion")
PERMANENT = ("permission denied", "no such file", "not found:", "requires non-empty", "must not be empty", "invalid source", "unsupported source_type", "credential reference environment variable is not set", "api principal requires", "allowed_local_source_roots", "pdf local path rejected:")


def failure(message: Column) -> Column:
    """(failure_class, retryable) of a persisted message: the first HTTP state that decides, then fences, then configuration."""
    low = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    states = F.transform(F.regexp_extract_all(low, F.lit("\\b([1-5][0-9]{2})\\b"), F.lit(1)), lambda s: s.cast("int"))
    counted = F.filter(states, lambda s: s.isin(*RETRYABLE) | s.between(400, 499))
    state = F.when(F.size(counted) > 0, F.element_at(counted, 1))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    name = F.when(state.isNotNull(), F.concat(F.lit("http_"), state.cast("string"))).when(some(FENCED), "source_generation_mismatch").when(some(PERMANENT), "configuration_error").otherwise("pipeline_failure")
    return F.struct(name.alias("failure_class"), F.coalesce(state.isin(*RETRYABLE), name == "pipeline_failure").alias("retryable"))


def due(sources: DataFrame, jobs: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Due sources with the id of their next job and their next time; blocked where a job of theirs is active."""
    active = jobs.where("status IN ('pending', 'running')").select("source_id").distinct().withColumn("__busy", F.lit(True))
    rows = sources.where((F.col("status") == "active") & F.col("sync_enabled") & (F.col("sync_next_at") <= now)).orderBy("sync_next_at", "source_id").limit(limit)
    job = F.concat(F.lit("sync-"), F.substring(F.sha2(F.concat_ws(":", "source_id", F.unix_timestamp(F.col("sync_next_at").cast("timestamp")).cast("string")), 256), 1, 27))
    following = next_window(F.col("sync_next_at"), F.col("__now"), F.col("sync_interval"))
    return rows.join(active, "source_id", "left").withColumn("__now", now).select("source_id", job.alias("job_id"), F.coalesce("__busy", F.lit(False)).alias("blocked"), following.alias("sync_next_at"))


def deletable(objects: DataFrame, now: Column, retention_days: int) -> DataFrame:
    return objects.where(F.col("state").isin("orphaned", "retired") & (F.col("ref_count") == 0) & (F.col("updated_at") <= now - F.make_dt_interval(days=F.lit(retention_days))))


def shadow(baseline: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """Overlap at k of two rankings (query_id, chunk_id, rank) for each query."""
    ids = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("chunk_id").alias(name))
    both = ids(baseline, "a").join(ids(candidate, "b"), "query_id", "full_outer")
    none = F.array().cast(dict(baseline.dtypes)["chunk_id"].join(["array<", ">"]))
    return both.select("query_id", F.round(F.size(F.array_intersect(F.coalesce("a", none), F.coalesce("b", none))) / F.lit(max(1, k)), 4).alias("overlap"))


def inventory(chunks: DataFrame, contract: str, *columns: str) -> DataFrame:
    """The contracts in use, a row for each hash."""
    return chunks.where(F.col(contract).isNotNull()).groupBy(contract).agg(F.count("*").alias("chunks"), *[F.min(c).alias(c) for c in columns])
