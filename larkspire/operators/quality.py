"""Retrieval quality: case scores, summaries, gates, request metrics, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flagged(hits: DataFrame, entity: str = "entity") -> DataFrame:
    """hits (case_id, rank, relevant, entity) with flag: relevant, and the first of its entity."""
    w = Window.partitionBy("case_id", entity, "relevant").orderBy("rank")
    return hits.withColumn("flag", (F.col("relevant") & (F.row_number().over(w) == 1)).cast("int"))


def case_scores(hits: DataFrame, totals: DataFrame, max_rank: int = 5) -> DataFrame:
    """First relevant rank, reciprocal rank, precision, recall and nDCG at 10 of each case of totals (case_id, total)."""
    f = flagged(hits)
    dcg = F.sum(F.when(F.col("rank") <= 10, F.col("flag") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    scored = f.groupBy("case_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), dcg.alias("dcg"), F.sum("flag").alias("found"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("flag")).otherwise(0)).alias(f"hits_{k}") for k in (5, 10)],
    )
    rows = totals.join(scored, "case_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.coalesce("total", F.lit(1)), F.lit(1)), F.lit(10)).cast("int")), F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1))
    first = F.col("first_rank")
    return rows.select(
        *totals.columns, "first_rank",
        F.when(first <= 10, 1.0 / first).otherwise(0.0).alias("rr_10"),
        (F.coalesce("hits_5", F.lit(0)) / 5.0).alias("precision_5"), (F.coalesce("hits_10", F.lit(0)) / 10.0).alias("precision_10"),
        F.when(F.col("total") > 0, F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("total"))).alias("recall_10"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_10"),
        F.coalesce(first <= max_rank, F.lit(False)).alias("passed"),
    )


def summary(scores: DataFrame, category: str = "category") -> DataFrame:
    """Means over all cases (category null) and for each category."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))), 6).alias(f"hit_{k}")
    return scores.groupingSets([[], [F.col(category)]], category).agg(
        F.count("*").alias("cases"), hit(1), hit(3), hit(5), hit(10), *[F.round(F.avg(c), 6).alias(c) for c in ("rr_10", "precision_5", "precision_10", "recall_10", "ndcg_10")]
    )


def gate(metrics: DataFrame, checks: list[tuple[str, str, float]]) -> DataFrame:
    """A row a check (metric, 'min' or 'max', threshold) with its value and whether it holds; a missing value fails."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(kind).alias("kind"), F.lit(float(t)).alias("threshold"), F.col(m).cast("double").alias("value")) for m, kind, t in checks]))
    out = metrics.select(rows.alias("c")).select("c.*")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))


def promotion(baseline: DataFrame, candidate: DataFrame, metrics: list[str], max_drop: float = 0.0, latency: str = "p95_ms", ratio: float = 1.15) -> DataFrame:
    """Checks of a candidate's one-row metrics against a baseline's: no metric falls by more than max_drop, latency stays within ratio."""
    both = baseline.select(*[F.col(m).alias(f"b_{m}") for m in (*metrics, latency)]).crossJoin(candidate.select(*metrics, latency))
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(m).alias("candidate"), F.coalesce(F.col(m) >= F.col(f"b_{m}") - max_drop, F.lit(False)).alias("ok")) for m in metrics]
    rows.append(F.struct(F.lit(latency).alias("metric"), F.col(f"b_{latency}").alias("baseline"), F.col(latency).alias("candidate"), F.coalesce(F.col(latency) <= F.col(f"b_{latency}") * ratio, F.lit(False)).alias("ok")))
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def percentile_nearest(values: Column, q: float) -> Column:
    """Nearest rank, rounded up, of a sorted array."""
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.size(values) * q).cast("int")))


def percentile_truncated(values: Column, q: float) -> Column:
    """Index floor(n q) of a sorted array, the last at most."""
    return F.element_at(values, F.least(F.floor(F.size(values) * q).cast("int") + 1, F.size(values)))


def percentile_rounded(values: Column, q: float) -> Column:
    """Index round((n - 1) q), half to even, of a sorted array."""
    return F.element_at(values, F.bround((F.size(values) - 1) * q).cast("int") + 1)


def truncated_percentile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """percentile_truncated, without gathering a group."""
    return ranked_percentile(df, by, value, q, "truncated", f"p{round(q * 100)}")


def ranked_percentile(df: DataFrame, by: list[str], value: str, q: float, kind: str, name: str) -> DataFrame:
    """A percentile that is a value of the group, by its rank: truncated (floor(n q) + 1), nearest (ceil(n q)) or rounded ((n - 1) q half to even, + 1).

    No group is gathered: equal values are counted first, and these counts are summed over 1,025 ranges of values, so that
    only the range with the rank is sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    bounds = counts.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("__k").alias("__n"))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / 1024).otherwise(F.lit(1.0))
    binned = counts.join(F.broadcast(bounds), by).withColumn("__bin", F.floor((F.col(value) - F.col("__lo")) / width))
    bins = binned.groupBy(*by, "__bin", "__n").agg(F.sum("__k").alias("__in"))  # 1,025 rows a group at most
    before = F.sum("__in").over(Window.partitionBy(*by).orderBy("__bin")) - F.col("__in")
    n = F.col("__n")
    want = {"truncated": F.least(F.floor(n * q) + 1, n), "nearest": F.greatest(F.lit(1), F.ceil(n * q)), "rounded": F.bround((n - 1) * q).cast("long") + 1}[kind]
    chosen = bins.withColumn("__before", before).where((want > F.col("__before")) & (want <= F.col("__before") + F.col("__in"))).select(*by, "__bin", "__before", want.alias("__want"))
    inside = binned.join(F.broadcast(chosen), [*by, "__bin"])
    upto = F.sum("__k").over(Window.partitionBy(*by).orderBy(value)) + F.col("__before")
    return inside.withColumn("__upto", upto).where("__upto >= __want").groupBy(*by).agg(F.min(value).alias(name))


def cost(tokens_in: Column, cached: Column, tokens_out: Column, rate_in: float, rate_cached: float, rate_out: float) -> Column:
    """Price of a call by rates for a million tokens."""
    return ((tokens_in - cached) * rate_in + cached * rate_cached + tokens_out * rate_out) / 1e6


def costs(calls: DataFrame) -> DataFrame:
    """Totals by tier, by model, by task and over all (tier, model, task, cost_usd, tokens)."""
    sets = [[F.col("tier")], [F.col("model")], [F.col("task")], []]
    return calls.groupingSets(sets, "tier", "model", "task").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("tokens").alias("tokens"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """An order-free digest of a catalog: count, and xor and sum of row hashes. Partial sums, so no task sees all rows."""
    h = F.xxhash64("chunk_id", "doc_id", "checksum")
    return chunks.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """One row over requests (request_id, at, citations, evidence, confidence, tool_calls array of (name, ok), retrieval_ms, total_ms, iterations, feedback)."""
    calls = requests.select(F.explode("tool_calls").alias("c")).select("c.*").agg(
        F.count("*").alias("tool_calls"), F.count(F.when(~F.col("ok"), 1)).alias("tool_failures"),
        F.avg(F.when(F.col("name") == "retrieve", F.col("ok").cast("int"))).alias("hit"),
    )
    n = lambda c: F.count(F.when(c, 1))
    good, bad = n(F.col("feedback") == "positive"), n(F.col("feedback") == "negative")
    zero = F.lit(0.0)
    main = requests.agg(
        F.count("*").alias("total_requests"), F.round(F.coalesce(F.avg((F.col("citations") > 0).cast("int")), zero), 6).alias("citation_coverage"),
        F.round(F.coalesce(F.avg("citations"), zero), 6).alias("avg_citations"), F.round(F.coalesce(F.avg("evidence"), zero), 6).alias("avg_evidence"),
        *[n(F.col("confidence") == c).alias(f"confidence_{c}") for c in ("high", "medium", "low")],
        F.round(F.coalesce(F.avg(F.when(F.col("retrieval_ms") > 0, F.col("retrieval_ms"))), zero), 6).alias("avg_retrieval_ms"),
        good.alias("positive_feedback"), bad.alias("negative_feedback"), F.round(F.coalesce(F.try_divide(good, good + bad), zero), 6).alias("feedback_score"),
        F.round(F.coalesce(F.avg("total_ms"), zero), 6).alias("avg_duration_ms"), F.round(F.coalesce(F.avg("iterations"), zero), 6).alias("avg_iterations"),
    )
    p95 = truncated_percentile(requests.withColumn("__all", F.lit(1)), ["__all"], "total_ms", 0.95).select(F.col("p95").alias("p95_duration_ms"))
    rates = calls.select(F.round(F.coalesce(F.try_divide("tool_failures", "tool_calls"), zero), 6).alias("tool_failure_rate"), F.round(F.coalesce("hit", zero), 6).alias("retrieval_hit_rate"))
    return main.join(rates, how="cross").join(p95, F.lit(True), "left")  # one row each


def tool_stats(requests: DataFrame) -> DataFrame:
    """Successes and failures of each tool."""
    return requests.select(F.explode("tool_calls").alias("c")).groupBy("c.name").agg(F.count(F.when(F.col("c.ok"), 1)).alias("success"), F.count(F.when(~F.col("c.ok"), 1)).alias("failure"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and estimated cost of each request."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens")]
    cost = F.coalesce("estimated_cost_usd", F.lit(0)).cast("decimal(28,10)")  # sums of decimals don't hang on their order
    return calls.groupBy("request_id").agg(F.count("*").alias("calls"), *sums, F.round(F.sum(cost).cast("double"), 8).alias("estimated_cost_usd"))


def model_contracts(calls: DataFrame) -> DataFrame:
    """Of each request the models that it used, with their tasks."""
    return calls.groupBy("request_id", "provider", "model").agg(F.sort_array(F.collect_set("task")).alias("tasks"))


def latency_summary(timings: DataFrame, by: list[str], ms: str = "latency_ms") -> DataFrame:
    """Linear percentiles, mean and queries a second of each group."""
    return timings.groupBy(*by).agg(F.round(F.percentile(ms, 0.5), 3).alias("p50_ms"), F.round(F.percentile(ms, 0.95), 3).alias("p95_ms"), F.round(F.avg(ms), 3).alias("mean_ms"), F.round(F.try_divide(F.lit(1000.0), F.avg(ms)), 3).alias("queries_per_second"))


def ablation(scores: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5 and 10 and reciprocal rank of each mode, overall (category null) and by category. scores: mode, category, first_rank."""
    first = F.col("first_rank")
    recall = [F.round(F.avg(F.coalesce((first <= k).cast("int"), F.lit(0))), 4).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)]
    rr = F.round(F.avg(F.when(first <= 10, 1.0 / first).otherwise(0.0)), 4).alias("mrr_at_10")
    return scores.groupingSets([[F.col("mode")], [F.col("mode"), F.col("category")]], "mode", "category").agg(F.count("*").alias("labeled_cases"), *recall, rr)


def repeated_runs(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Of each mode: a case is a hit only if all its runs without error hit, its reciprocal rank is their mean, 0 without any. runs: mode, case_id, rank, error, latency_ms."""
    ok = runs.where("error IS NULL")
    rr = F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)
    per = ok.groupBy("mode", "case_id").agg(*[F.bool_and(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"all_{k}") for k in (1, 5)], F.avg(rr).alias("rr"))
    every = cases.join(runs.select("mode").distinct(), how="cross").join(per, ["mode", "case_id"], "left")  # modes are a handful
    hit = lambda k: F.round(F.avg(F.coalesce(F.col(f"all_{k}").cast("int"), F.lit(0))), 4).alias(f"hit_at_{k}")
    quality = every.groupBy("mode").agg(hit(1), hit(5), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 4).alias("mrr_at_10"))
    counts = runs.groupBy("mode").agg(F.count("*").alias("requests"), F.count("error").alias("errors"))
    return counts.join(quality, "mode").join(latency_summary(ok, ["mode"]).select("mode", "p50_ms", "p95_ms"), "mode", "left")


def suite(results: DataFrame) -> DataFrame:
    """Totals, passes and mean time of an agent's evaluation, overall (category null) and by category; retrieval means over results that have any."""
    has = (F.col("mrr_10") > 0) | (F.col("recall_10") > 0)
    passed = F.count(F.when(F.col("passed"), 1))
    return results.groupingSets([[], [F.col("category")]], "category").agg(
        F.count("*").alias("total"), passed.alias("passed"), (F.count("*") - passed).alias("failed"), F.round(passed / F.count("*"), 4).alias("pass_rate"), F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"),
        F.coalesce(F.round(F.avg(F.when(has, F.col("mrr_10"))), 4), F.lit(0.0)).alias("avg_mrr_at_10"), F.coalesce(F.round(F.avg(F.when(has, F.col("recall_10"))), 4), F.lit(0.0)).alias("avg_recall_at_10"), F.count(F.when(has, 1)).alias("retrieval_eval_count"),
    )


def agent_failure(result: str = "passed") -> Column:
    """Why an agent's case failed, the first that applies: an error, the route, too little evidence, too few citations, what the answer lacks; null if it passed."""
    return (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("expected_route").isNotNull() & (F.col("expected_route") != F.col("route")), "wrong_route")
        .when(F.col("evidence") < F.col("min_evidence"), "insufficient_evidence")
        .when(F.col("citations") < F.col("min_citations"), "missing_citations")
        .when(~F.forall("expected_terms", lambda t: F.contains(F.lower("answer"), F.lower(t))), "answer_content")
    )


def answer_quality(samples: DataFrame) -> DataFrame:
    """Word overlap of the answer with its contexts, of the answer with the question, and of the contexts with the ground truth; each sample, with their mean."""
    from larkspire.functions.text import keyword_overlap

    joined = F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), " ")
    parts = {"faithfulness": keyword_overlap(F.col("answer"), joined), "answer_relevancy": keyword_overlap(F.col("answer"), F.col("question")), "context_precision": keyword_overlap(joined, F.col("ground_truth"))}
    return samples.withColumns(parts).withColumn("overall", (F.col("faithfulness") + F.col("answer_relevancy") + F.col("context_precision")) / 3)


def shadow_summary(rows: DataFrame, k: int) -> DataFrame:
    """Hits, reciprocal ranks and overlap of a baseline and a candidate over labelled cases. rows: baseline_ids, candidate_ids, expected (arrays)."""

    def first(ids: str) -> Column:
        ranks = F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda r: r.isNotNull())
        return F.when(F.size(ranks) > 0, F.element_at(ranks, 1))

    overlap = F.round(F.size(F.array_intersect("baseline_ids", "candidate_ids")) / F.lit(max(1, k)), 4)
    r = rows.withColumns({"b": first("baseline_ids"), "c": first("candidate_ids"), "o": overlap, "labelled": F.size("expected") > 0})
    mean = lambda x, name: F.round(F.avg(F.when(F.col("labelled"), F.coalesce(x, F.lit(0.0)))), 4).alias(name)
    return r.agg(
        F.count("*").alias("cases"), F.count(F.when(F.col("labelled"), 1)).alias("labeled_cases"), F.round(F.avg("o"), 4).alias("mean_overlap_at_k"),
        mean(F.col("b").isNotNull().cast("double"), "baseline_hit_at_k"), mean(F.col("c").isNotNull().cast("double"), "candidate_hit_at_k"), mean(1.0 / F.col("b"), "baseline_mrr"), mean(1.0 / F.col("c"), "candidate_mrr"),
    )


def subset(required: Column, present: Column) -> Column:
    """A struct (passed, missing): whether all that is required is present, and what isn't, in order. Null counts as nothing."""
    empty = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.coalesce(required, empty), F.coalesce(present, empty)))
    return F.struct((F.size(missing) == 0).alias("passed"), missing.alias("missing"))


# The metrics of a promotion with the drop that each may have, and the ratios that time and cost may grow by.
QUALITY, RATIOS = {"recall": 0.0, "mrr": 0.0, "ndcg": 0.0}, {"p95_latency_ms": 0.15, "cost_usd": 0.25}


def decision(baseline: DataFrame, candidate: DataFrame, floors: dict[str, float] | None = None, critical: DataFrame | None = None) -> DataFrame:
    """A row a check (name, baseline, candidate, passed) between two one-row evaluations: quality may not fall nor leave 0..1, time and cost stay within their ratios, floors hold, critical cases (case_id, passed) pass. What is missing fails."""
    names = [*QUALITY, *RATIOS]
    both = baseline.select(*[F.col(m).cast("double").alias(f"b_{m}") for m in names]).join(candidate.select(*[F.col(m).cast("double").alias(m) for m in names]), how="cross")  # one row each
    no = F.lit(False)
    rows = []
    for m, drop in QUALITY.items():
        a, b = F.col(f"b_{m}"), F.col(m)
        rows.append((m, a, b, F.coalesce(a.between(0, 1) & b.between(0, 1) & (b >= a - drop), no)))
    for m, grow in RATIOS.items():
        a, b = F.col(f"b_{m}"), F.col(m)
        free = F.when(a == 0, b == 0) if m == "cost_usd" else F.when(a == 0, no)
        rows.append((m, a, b, F.coalesce(F.coalesce(free, b <= a * (1 + grow)), no)))
    for m, least in (floors or {}).items():
        rows.append((f"min_{m}", F.lit(float(least)), F.col(m), F.coalesce(F.col(m) >= least, no)))
    out = both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), a.alias("baseline"), b.alias("candidate"), ok.alias("passed")) for n, a, b, ok in rows])))
    if critical is None:
        return out
    failed = F.count(F.when(~F.coalesce("passed", no), 1))
    return out.unionByName(critical.agg(failed.cast("double").alias("candidate")).select(F.lit("critical_cases").alias("name"), F.lit(0.0).alias("baseline"), "candidate", (F.col("candidate") == 0).alias("passed")))


def compared(control: DataFrame, candidate: DataFrame) -> DataFrame:
    """Each case of the control (case_id, category, first_rank, passed) with the candidate's: whether it fails anew, and whether its rank got worse."""
    c = candidate.select("case_id", F.col("first_rank").alias("new_rank"), F.col("passed").alias("new_passed"), F.lit(True).alias("__there"))
    both = control.join(c, "case_id", "left")
    gone = F.col("__there").isNull()
    fails = gone | (F.col("passed") & ~F.coalesce("new_passed", F.lit(False)))
    worse = ~gone & F.col("first_rank").isNotNull() & (F.col("new_rank").isNull() | (F.col("new_rank") > F.col("first_rank")))
    return both.select("case_id", "category", "first_rank", "new_rank", fails.alias("new_failure"), worse.alias("rank_regression"))


def category_regressions(control: DataFrame, candidate: DataFrame, least: float = -0.05) -> DataFrame:
    """Categories whose mean reciprocal rank fell by more than allowed."""
    mrr = lambda df, name: df.groupBy("category").agg(F.avg(F.when(F.col("first_rank") <= 10, 1.0 / F.col("first_rank")).otherwise(0.0)).alias(name))
    both = mrr(control, "a").join(mrr(candidate, "b"), "category", "left")
    delta = F.coalesce("b", F.lit(0.0)) - F.col("a")
    return both.where(delta < least).select("category", F.round(delta, 4).alias("mrr_delta"))


def best(specs: DataFrame) -> DataFrame:
    """The specification of the largest (ndcg, mrr, recall, -p95)."""
    key = F.struct(F.coalesce("ndcg", F.lit(0.0)), F.coalesce("mrr", F.lit(0.0)), F.coalesce("recall", F.lit(0.0)), F.coalesce(-F.col("p95_latency_ms"), F.lit(float("-inf"))))
    return specs.agg(F.max_by(F.struct(*specs.columns), key).alias("r")).select("r.*")


def fidelity(blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """How much a parser keeps, from blocks (doc_id, page, bbox, kind, section, text) and expected pages (doc_id, page_count)."""
    share = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(name)
    pages = blocks.where("page IS NOT NULL").select("doc_id", "page").distinct().agg(F.count("*").alias("seen"))
    told = blocks.agg(F.sum(F.length("text")).alias("characters"), share(F.col("page").isNotNull(), "page_block_rate"), share(F.col("bbox").isNotNull(), "bbox_block_rate"), share(F.contains(F.lower("kind"), F.lit("table")), "table_block_rate"), share(F.length("section") > 0, "section_block_rate"))
    n = F.greatest(F.col("n_pages"), F.lit(1))
    one = told.join(pages, how="cross").join(expected.agg(F.sum("page_count").alias("n_pages")), how="cross")  # one row each
    return one.select("characters", F.round(F.col("characters") / n, 3).alias("characters_per_page"), F.round(F.col("seen") / n, 6).alias("page_metadata_coverage"), "page_block_rate", "bbox_block_rate", "table_block_rate", "section_block_rate")


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of a manifest (path, sha256) and of a corpus (path, sha256): same, changed, missing or undeclared."""
    both = manifest.select("path", F.lower("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    kind = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "undeclared").when((F.col("want") == "") | (F.col("want") == F.col("have")), "same").otherwise("changed")
    return both.select("path", kind.alias("state"))


def retrieved(chunks: DataFrame, sampled: Column) -> DataFrame:
    """What a run keeps of its hits: ids, score, ranks, and the branches' trace for sampled requests."""
    return chunks.select("request_id", "chunk_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("rank").alias("final_rank"), F.when(sampled, F.struct("dense_rank", "lexical_rank")).alias("candidate_trace"))


def cited(chunks: DataFrame) -> DataFrame:
    """A row a citation."""
    return chunks.select("request_id", F.explode("citations").alias("citation_id"), "chunk_id", "doc_id")


def evaluation(summary_row: DataFrame, run_id: str) -> DataFrame:
    """A benchmark's one-row summary as the rows of an evaluation run: metric and value."""
    names = [c for c, t in summary_row.dtypes if t in ("double", "float", "int", "bigint")]
    return summary_row.select(F.lit(run_id).alias("evaluation_run_id"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
