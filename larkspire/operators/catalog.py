"""Catalog and job-queue analytics: overviews, latest rows, keyset pages, queue transitions."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.operators.filters import after


def latest(df: DataFrame, key: str, ts: str, item: str) -> DataFrame:
    """The newest row of each key; ties go to the larger item."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(item))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def counted(status: str, condition: Column | None = None) -> Column:
    hit = F.col("status") == status
    return F.count(F.when(hit if condition is None else hit & condition, 1)).alias(status)


def queue_overview(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs by status, stale leases, the oldest pending, and what ended in the last 24 hours."""
    recent = F.col("completed_at") >= now - F.expr("INTERVAL 24 HOURS")
    return jobs.agg(
        *[counted(s) for s in ("pending", "running", "failed", "dead_lettered")],
        F.min(F.when(F.col("status") == "pending", F.col("created_at"))).alias("oldest_pending_at"),
        counted("running", F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") <= now)).alias("stale_running"),
        counted("completed", recent).alias("completed_24h"),
        counted("failed", recent).alias("failed_24h"),
    )


def source_overview(sources: DataFrame) -> DataFrame:
    live = F.col("status") != "deleted"
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return sources.agg(
        n(live, "total"), n(F.col("status") == "active", "active"), n(F.col("status") == "paused", "paused"), n(live & F.col("sync_enabled"), "scheduled"),
        F.min(F.when(live & F.col("sync_enabled"), F.col("sync_next_at"))).alias("next_sync_at"),
    )


def knowledge_size(jobs: DataFrame) -> DataFrame:
    """Documents and chunks by the latest completed job of each source; chunks_total of the stats if it is there."""
    done = latest(jobs.where("status = 'completed'"), "source_id", "created_at", "job_id")
    total = F.expr("try_cast(nullif(get_json_object(stats, '$.chunks_total'), '') AS bigint)")
    return done.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.coalesce(total, "chunk_count", F.lit(0))), F.lit(0)).alias("chunks"))


def page(df: DataFrame, ts: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """One row more than limit, newest first, behind the cursor: the extra row says that there is another page."""
    rows = df if cursor is None else df.where(after(ts, key, *cursor))
    return rows.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)


def page_of(df: DataFrame, ts: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """page() with the number of all rows, whatever the cursor, as total."""
    return page(df, ts, key, limit, cursor).join(F.broadcast(df.agg(F.count("*").alias("total"))), how="cross")


def encode_cursor(kind: str, ts, key) -> str:
    return base64.urlsafe_b64encode(json.dumps({"kind": kind, "ts": str(ts), "id": key}).encode()).decode()


def decode_cursor(kind: str, cursor: str) -> tuple[str, object]:
    found = json.loads(base64.urlsafe_b64decode(cursor))
    if found.get("kind") != kind:
        raise ValueError(f"not a cursor of {kind}")
    return found["ts"], found["id"]


def claimable(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    return jobs.where((F.col("status") == "pending") & (F.coalesce("available_at", "created_at") <= now) & (F.col("attempts") < max_attempts))


def claimed(jobs: DataFrame, now: Column, worker: str, n: int, lease_seconds: int = 60, max_attempts: int = 3) -> DataFrame:
    """The n oldest claimable jobs as running under the worker's lease."""
    rows = claimable(jobs, now, max_attempts).orderBy("created_at", "job_id").limit(n)
    return rows.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(worker), "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds).cast("decimal(18,6)"))})


def transition(now: Column, max_attempts: int = 3) -> Column:
    """What reconciling does to a job; the first that applies."""
    expired = (F.col("status") == "running") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") <= now)
    spent = F.col("attempts") >= max_attempts
    return (
        F.when(expired & spent, "dead_lettered_running")
        .when(expired, "recovered_running")
        .when((F.col("status") == "failed") & ~spent, "recovered_failed")
        .when(F.col("status").isin("failed", "pending") & spent, "dead_lettered_exhausted")
        .otherwise("kept")
    )


def reconciled(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    t = transition(now, max_attempts)
    status = F.when(t.startswith("dead_lettered"), "dead_lettered").when(t.startswith("recovered"), "pending").otherwise(F.col("status"))
    return jobs.withColumn("transition", t).withColumn("status", status)


def backoff(attempt: Column, base: float = 2.0, most: float = 300.0, chance: Column | None = None) -> Column:
    """Seconds to wait after an attempt: doubled each time, up to a limit; with a chance (0 to 1) between half of that and all."""
    raw = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    return raw if chance is None else F.least(F.lit(most), raw * (0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance))))


def decoded(rows: DataFrame, column: str, schema: str, **defaults) -> DataFrame:
    """rows with the fields of a JSON column, those that are missing by their defaults."""
    names = F.from_json(column, schema)
    fields = [f.split()[0] for f in schema.split(", ")]
    return rows.withColumns({f: F.coalesce(names[f], F.lit(defaults[f])) if f in defaults else names[f] for f in fields})


def next_window(due: Column, now: Column, seconds: Column | int) -> Column:
    """The first due time after now, in whole periods from the last."""
    late = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(due.cast("timestamp"))
    periods = F.greatest(F.lit(1), F.floor(late / seconds) + 1)
    return due + F.make_dt_interval(secs=(periods * seconds).cast("decimal(18,6)"))


def orphaned(generations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unfinished generations whose job is gone or doesn't run."""
    mine = jobs.select("job_id", F.col("status").alias("job_status"))
    return generations.where("status IN ('staging', 'prepared')").join(mine, "job_id", "left").where("job_status IS NULL OR job_status <> 'running'")


def items(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """A page of sources with their latest job and what their latest completed one has indexed."""
    last = latest(jobs, "source_id", "created_at", "job_id").select("source_id", F.col("job_id").alias("latest_job"), F.col("status").alias("latest_status"))
    total = F.expr("try_cast(nullif(get_json_object(stats, '$.chunks_total'), '') AS bigint)")
    done = latest(jobs.where("status = 'completed'"), "source_id", "created_at", "job_id").select("source_id", F.col("doc_count").alias("documents"), F.coalesce(total, "chunk_count", F.lit(0)).alias("chunks"), F.col("completed_at").alias("indexed_at"))
    return sources.join(last, "source_id", "left").join(done, "source_id", "left").fillna(0, ["documents", "chunks"])


def by_status(jobs: DataFrame) -> DataFrame:
    """Statuses that jobs have, with their number and share."""
    n = jobs.groupBy("status").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("__all"))
    return n.join(F.broadcast(whole), how="cross").select("status", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))


def pending_age(jobs: DataFrame, now: Column) -> DataFrame:
    """Seconds that the oldest pending job has waited."""
    oldest = F.min(F.when(F.col("status") == "pending", F.col("created_at")))
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))) / 1e6
    return jobs.agg(F.round(F.greatest(F.lit(0.0), seconds), 3).alias("oldest_pending_age"))


def failures(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The latest failed and the latest dead-lettered jobs, n of each."""
    part = lambda kind: jobs.where(F.col("status") == kind).orderBy(F.desc("completed_at"), F.desc("job_id")).limit(n).withColumn("kind", F.lit(kind))
    return part("failed").unionByName(part("dead_lettered"))


def counts(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Running jobs, chunks, and chunks with text."""
    a = jobs.agg(F.count(F.when(F.col("status") == "running", 1)).alias("running"))
    b = chunks.agg(F.count("*").alias("chunks"), F.count(F.when(F.length("text") > 0, 1)).alias("filled"))
    return a.join(b, how="cross")  # one row each
