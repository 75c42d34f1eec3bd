"""Tables by key: upserts, insert-once, deletes and cascades, ownership, queue writes. Each is a new table from an old one and a batch; Generations or an overwrite publishes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.operators import catalog, lifecycle
from larkspire.operators.catalog import backoff
from larkspire.sources.files import canonical


def upserted(old: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the batch's rows inserted, or in place of those of equal key; of several in the batch the last by order, or else by all columns. Columns that the batch lacks are kept."""
    by = [F.desc(order)] if order else []
    w = Window.partitionBy(*keys).orderBy(*by, *[F.desc_nulls_last(F.to_json(F.struct(F.col(f"`{c}`")))) for c in batch.columns if c not in keys])
    batch = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    rest = [c for c in old.columns if c not in batch.columns]
    new = batch if not rest else batch.join(old.select(*keys, *rest), keys, "left")
    return old.join(batch.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def inserted(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new keys alone: what is there already stays as it is."""
    return old.unionByName(batch.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(documents: DataFrame, chunks: DataFrame, points: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, chunks and points without the documents in gone (doc_id)."""
    lost = chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
    return deleted(documents, gone, ["doc_id"]), deleted(chunks, gone, ["doc_id"]), deleted(points, lost, ["chunk_id"])


def vectors_upserted(old: DataFrame, batch: DataFrame, dim: int) -> DataFrame:
    """Points by point_id; a vector of another length is an error."""
    right = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector hasn't {dim} dimensions")))
    return upserted(old, batch.withColumn("vector", right), ["point_id"])


def owned(documents: DataFrame, source_id: str, tenant_id: str, base_doc_id: str | None = None) -> DataFrame:
    """The documents of a source: by its id, or, where none is stored, by the names that its documents used to have."""
    base = base_doc_id or f"doc-{source_id}"
    old = F.col("source_id").isNull() & (F.col("uri").startswith(f"source://{source_id}") | (F.col("doc_id") == base) | F.col("doc_id").startswith(f"{base}:"))
    return documents.where((F.col("tenant_id") == tenant_id) & ((F.col("source_id") == source_id) | F.coalesce(old, F.lit(False))))


def adopted(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents without a source that have the name of one (its doc_id, or that and a suffix) with its id and legacy generation: an equi-join on the name before the colon and on the whole name."""
    names = sources.select(F.coalesce(F.nullif("base_doc_id", F.lit("")), F.concat(F.lit("doc-"), "source_id")).alias("__base"), F.col("source_id").alias("__source"))
    known = names.groupBy("__base").agg(F.min("__source").alias("__source"))
    n = F.size(F.split("doc_id", ":"))
    bases = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.split("doc_id", ":"), 1, i), ":"))
    lost = documents.where("source_id IS NULL").select("doc_id", F.explode(bases).alias("__base")).join(known, "__base").groupBy("doc_id").agg(F.min("__source").alias("__source"))
    both = documents.join(lost, "doc_id", "left")
    legacy = F.concat(F.lit("legacy:"), F.col("__source"))
    return both.withColumn("generation_id", F.coalesce("generation_id", legacy)).withColumn("source_id", F.coalesce("source_id", "__source")).drop("__source")


def with_documents(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """The sources that have a document by name: an existence test as a semi-join on prefixes of names."""
    base = F.coalesce(F.nullif("base_doc_id", F.lit("")), F.concat(F.lit("doc-"), "source_id"))
    n = F.size(F.split("doc_id", ":"))
    names = documents.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.split("doc_id", ":"), 1, i), ":"))).alias("__base")).distinct()
    return sources.withColumn("__base", base).join(names, "__base", "left_semi").drop("__base")


def backfilled(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks without source or generation with those of their document."""
    d = documents.select("doc_id", F.col("source_id").alias("__s"), F.col("generation_id").alias("__g"))
    lacks = F.col("source_id").isNull() | F.col("generation_id").isNull()
    both = chunks.join(d, "doc_id", "left").withColumn("__lacks", lacks)
    fill = lambda c, new: F.when(F.col("__lacks"), F.coalesce(new, c)).otherwise(F.col(c))
    return both.withColumns({"source_id": fill("source_id", "__s"), "generation_id": fill("generation_id", "__g")}).drop("__s", "__g", "__lacks")


def access(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """Sources with the hash of their policy; public where it has none that is known."""
    p = policies.select(F.col("policy_id").alias("acl_policy_id"), F.col("policy_hash").alias("acl_hash"))
    return sources.join(p, "acl_policy_id", "left").withColumn("acl_hash", F.coalesce("acl_hash", F.lit("public")))


def unexpired(runs: DataFrame, now: Column) -> DataFrame:
    """Without the runs whose time is over."""
    return runs.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def objects(rows: DataFrame, tenant_id: str | None = None, state: str | None = None) -> DataFrame:
    """Uploaded objects by tenant and state, where these are given."""
    for c, v in (("tenant_id", tenant_id), ("state", state)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows


UPLOADS = "upload:"


def upload_object(uri: Column) -> Column:
    """The object's id of an upload address (32 hexadecimal digits); null for any other."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(uri), f"(?i)^{UPLOADS}/*([0-9a-f]{{32}})/*$", 1)), F.lit(""))


def resolved(sources: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Sources with the storage path of their upload, or their own path where it is none."""
    o = uploaded.select(F.col("object_id").alias("__o"), F.col("storage_path").alias("__p"))
    return sources.withColumn("__o", upload_object(F.col("path"))).join(o, "__o", "left").withColumn("resolved_path", F.when(F.col("__o").isNull(), F.col("path")).otherwise(F.col("__p"))).drop("__o", "__p")


def source_key(tenant: Column, kind: Column, location: Column) -> Column:
    """The id of a source by tenant, kind and canonical location."""
    return _source_id(tenant, kind, canonical(location))


def _source_id(tenant: Column, kind: Column, place: Column) -> Column:
    # It is never null, and said not to be: else joins on it filter every request by its canonical form before anything is grouped.
    return F.coalesce(F.substring(F.sha2(F.concat_ws("\x00", tenant, kind, place), 256), 1, 32), F.lit(""))


def job_key(source_id: Column, idempotency: Column) -> Column:
    return F.coalesce(F.substring(F.sha2(F.concat_ws("\x00", F.lit("quick-ingest"), source_id, idempotency), 256), 1, 32), F.lit(""))


def imported(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Sources after quick imports (tenant_id, source_type, location, name, at): one for each canonical location; the last request names it, one that was deleted comes back."""
    written = ["tenant_id", "source_type", "location"]
    # A source's last request is the last of one of its locations as written: maxima by hash find these, and only they get a
    # canonical form and are sorted. That is made of an aggregate's value, so that no filter on it is moved to the requests.
    newest = requests.groupBy(*written).agg(F.max("at").alias("at")).groupBy(*written, "at").agg(F.any_value("location").alias("__place"))
    newest = newest.select(*written, "at", canonical(F.col("__place")).alias("__at")).withColumn("source_id", _source_id(F.col("tenant_id"), F.col("source_type"), F.col("__at"))).alias("n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*written, "at")]
    asked = requests.alias("r").join(newest, same).select("r.tenant_id", "r.source_type", "r.name", "r.at", "n.__at", "n.source_id")
    w = Window.partitionBy("source_id").orderBy(F.desc("at"), F.desc_nulls_last("name"))
    last = asked.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("source_id", "tenant_id", "source_type", F.col("__at").alias("location"), "name", F.lit("active").alias("status"), F.col("at").alias("updated_at"))
    return upserted(sources, last, ["source_id"])


def import_jobs(jobs: DataFrame, requests: DataFrame, idempotency: str = "idempotency_key") -> DataFrame:
    """Jobs (job_id, source_id, status, created_at) after quick imports: one for each source and idempotency key, made by its first request; a repeated request finds the job that is there."""
    source = source_key(F.col("tenant_id"), F.col("source_type"), F.col("location"))
    written = requests.groupBy("tenant_id", "source_type", "location", F.col(idempotency).alias("__k")).agg(F.min("at").alias("at"))  # a canonical form for each location as written, not for each request
    asked = written.select(source.alias("source_id"), "__k", "at").groupBy("source_id", "__k").agg(F.min("at").alias("created_at"))
    new = asked.select(job_key(F.col("source_id"), F.col("__k").cast("string")).alias("job_id"), "source_id", F.lit("pending").alias("status"), "created_at")
    return inserted(jobs, new, ["job_id"])


# The queue


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, lease_seconds: int = 120) -> DataFrame:
    """Leases of running jobs extended for their owners alone. beats: job_id, worker."""
    b = beats.select("job_id", F.col("worker").alias("__w")).dropDuplicates(["job_id"])
    mine = (F.col("status") == "running") & (F.col("lease_owner") == F.col("__w"))
    until = now + F.make_dt_interval(secs=F.lit(lease_seconds).cast("decimal(18,6)"))
    return jobs.join(b, "job_id", "left").withColumn("lease_expires_at", F.when(mine, until).otherwise(F.col("lease_expires_at"))).drop("__w")


def released(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """The worker's running jobs back to pending."""
    mine = (F.col("status") == "running") & (F.col("lease_owner") == worker)
    free = lambda c, v: F.when(mine, v).otherwise(F.col(c))
    none = F.lit(None)
    return jobs.withColumns({"status": free("status", F.lit("pending")), "available_at": free("available_at", now), "lease_owner": free("lease_owner", none), "lease_expires_at": free("lease_expires_at", none)})


HISTORY = 20


def retried(jobs: DataFrame, failures: DataFrame, now: Column, max_attempts: int = 3, base: float = 5.0, most: float = 300.0) -> DataFrame:
    """Failed jobs back to pending after a delay, with the failure in their bounded history; or dead-lettered, if they can't be retried or have no attempts left. failures: job_id, error, failure_class, retryable; jobs have history array of (attempt, failure_class, delay)."""
    f = failures.select("job_id", F.col("error").alias("__e"), F.col("failure_class").alias("__c"), F.col("retryable").alias("__r"), F.lit(True).alias("__hit"))
    delay = backoff(F.greatest(F.coalesce("attempts", F.lit(0)), F.lit(1)), base, most)
    dead = F.col("__hit") & (~F.col("__r") | (F.col("attempts") >= max_attempts))
    again = F.col("__hit") & ~dead
    entry = F.struct(F.col("attempts").cast("int").alias("attempt"), F.col("__c").alias("failure_class"), delay.cast("double").alias("delay"))
    kept = F.slice("history", F.greatest(F.size("history") - (HISTORY - 2), F.lit(1)), HISTORY - 1)
    later = now + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))
    pick = lambda c, dead_value, again_value: F.when(dead, dead_value).when(again, again_value).otherwise(F.col(c))
    new = {
        "status": pick("status", F.lit("dead_lettered"), F.lit("pending")), "completed_at": pick("completed_at", F.coalesce("completed_at", now), F.lit(None)), "available_at": pick("available_at", F.col("available_at"), later),
        "history": F.when(again, F.concat(kept, F.array(entry))).otherwise(F.col("history")), "failure_class": F.coalesce("__c", "failure_class"),
    }
    return jobs.join(f, "job_id", "left").withColumns(new).drop("__e", "__c", "__r", "__hit")


def outbox_claimed(events: DataFrame, now: Column, worker: str, n: int = 10, lease_seconds: int = 120) -> DataFrame:
    """The n first pending events that are due, as running under the worker's lease."""
    rows = events.where((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("outbox_id").limit(max(1, n))
    return rows.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "lease_owner": F.lit(worker), "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds).cast("decimal(18,6)"))})


def outbox_settled(events: DataFrame, done: DataFrame, now: Column, max_attempts: int = 10, base: float = 5.0, most: float = 300.0) -> DataFrame:
    """Running events after their work: completed, pending again after a delay, or dead once attempts are used up; expired leases are pending again. done: outbox_id, worker, error (null if it went well); only the lease's owner settles."""
    d = done.select("outbox_id", F.col("worker").alias("__w"), F.col("error").alias("__e"))
    mine = (F.col("status") == "running") & (F.col("lease_owner") == F.col("__w"))
    good, bad = mine & F.col("__e").isNull(), mine & F.col("__e").isNotNull()
    spent = F.col("attempts") >= max_attempts
    expired = (F.col("status") == "running") & ~F.coalesce(mine, F.lit(False)) & (F.col("lease_expires_at") <= now)
    status = F.when(good, "completed").when((bad | expired) & spent, "dead_lettered").when(bad | expired, "pending").otherwise(F.col("status"))
    later = now + F.make_dt_interval(secs=backoff(F.greatest("attempts", F.lit(1)), base, most).cast("decimal(18,6)"))
    at = F.when(bad & ~spent, later).when(expired & ~spent, now).otherwise(F.col("available_at"))
    return events.join(d, "outbox_id", "left").withColumn("available_at", at).withColumn("status", status).drop("__w", "__e")


def unfenced(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """Changes (source_id, token) whose source is there still, isn't deleted and has the token that they began with."""
    s = sources.where("status <> 'deleted'").select("source_id", F.col("token").alias("__t"))
    return changes.join(s, "source_id").where(F.col("token").eqNullSafe(F.col("__t"))).drop("__t")


def breaker(calls: DataFrame, failures: int = 3, open_seconds: int = 30) -> DataFrame:
    """Calls (tool, at, ok) with the run of failures before each, and whether a circuit that opens after so many would refuse it: within open_seconds of the last of them."""
    w = Window.partitionBy("tool").orderBy("at", "call_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    runs = calls.withColumn("__good", F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)))
    in_run = Window.partitionBy("tool", "__good").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    bad = F.coalesce(F.sum((~F.col("ok")).cast("int")).over(in_run), F.lit(0))
    last = F.max(F.when(~F.col("ok"), F.col("at"))).over(in_run)
    out = runs.withColumn("failures_before", bad).withColumn("__last", last)
    since = F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("__last").cast("timestamp"))
    return out.withColumn("refused", (F.col("failures_before") >= failures) & F.coalesce(since < open_seconds, F.lit(False))).drop("__good", "__last")


# Generations and the worker

_GENERATION = {"prepared": ("staging",), "active": ("prepared",), "failed": ("staging", "prepared")}


def moved(generations: DataFrame, wanted: DataFrame, status: str, now: Column) -> DataFrame:
    """Generations (generation_id, source_id, status, changed_at) in wanted (generation_id) on their way to a status, where theirs allows it; a new active one retires that of its source before."""
    w = wanted.select("generation_id", F.lit(True).alias("__w")).dropDuplicates(["generation_id"])
    g = generations.join(w, "generation_id", "left").withColumn("__go", F.coalesce("__w", F.lit(False)) & F.col("status").isin(*_GENERATION[status]))
    old = F.lit(False)
    if status == "active":
        won = g.where("__go").select("source_id", F.lit(True).alias("__won")).dropDuplicates(["source_id"])
        g = g.join(won, "source_id", "left")
        old = F.coalesce("__won", F.lit(False)) & (F.col("status") == "active")
    changed = F.col("__go") | old
    return g.select(*[c for c in generations.columns if c not in ("status", "changed_at")], F.when(F.col("__go"), status).when(old, "retired").otherwise(F.col("status")).alias("status"), F.when(changed, now).otherwise(F.col("changed_at")).alias("changed_at"))


def may_cut_over(jobs: DataFrame) -> DataFrame:
    """Whether an index may be switched: no job is running."""
    running = F.count(F.when(F.col("status") == "running", 1))
    return jobs.agg(running.alias("running"), (running == 0).alias("allowed"))


def worker_step(jobs: DataFrame, sources: DataFrame, outbox: DataFrame, now: Column, worker: str, n: int = 1) -> dict[str, DataFrame]:
    """One turn of the worker, as the tables that it leads to: jobs reconciled, outbox events claimed, jobs of due sources, jobs claimed."""
    fixed = catalog.reconciled(jobs, now)
    return {"reconciled": fixed, "outbox": outbox_claimed(outbox, now, worker), "scheduled": lifecycle.due(sources, fixed, now).where("NOT blocked"), "claimed": catalog.claimed(fixed.drop("transition"), now, worker, n)}


def work(stream: DataFrame, turn, checkpoint: str, every: str = "10 seconds"):
    """The worker as a stream: turn(batch, id) for each micro-batch, taken up again at the checkpoint; turn must bear being called twice with one id."""
    return stream.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def exported(table: DataFrame) -> DataFrame:
    """A table as JSON lines, to be written as text."""
    return table.select(F.to_json(F.struct(*table.columns)).alias("value"))
