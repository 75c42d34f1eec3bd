"""Evidence of an answer: dedup, budget, extractive summary, verification, confidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.functions.text import strip

MAX_ITEM, MAX_TOTAL, TRUNCATED = 3000, 12_000, "\n... [truncated]"


def deduplicated(items: DataFrame) -> DataFrame:
    """items (request_id, position, score, text): the first of each text of a request."""
    w = Window.partitionBy("request_id", F.md5("text")).orderBy("position")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def compressed(items: DataFrame, max_total: int = MAX_TOTAL, max_item: int = MAX_ITEM) -> DataFrame:
    """Best scores first, long texts cut, what would pass the budget dropped while later ones may still fit.

    Each step hangs on what was kept before, so it is a fold over a request's items, which its retrieval has bounded.
    """
    cut = F.when(F.length("text") > max_item, F.concat(F.substring("text", 1, max_item), F.lit(TRUNCATED))).otherwise(F.col("text"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "position"], ascending=[False, True])
        total, keep = 0, []
        for n in pdf["text"].str.len():
            ok = not keep or not any(keep) or total + n <= max_total
            keep.append(ok)
            total += n if ok else 0
        return pdf[keep]

    return items.withColumn("text", cut).groupBy("request_id").applyInPandas(fold, items.schema)


def keywords(query: Column) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit("([A-Za-z0-9_\\-]+|[\\u4e00-\\u9fff]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) > 1)


def summary(items: DataFrame, n: int = 3) -> DataFrame:
    """The n best distinct sentences of a request's texts; ties by place. items: request_id, query, position, text."""
    parts = F.transform(F.split("text", "[。！？!?.]+"), strip)
    s = items.select("request_id", "query", "position", F.posexplode(F.filter(parts, lambda x: x != "")).alias("place", "sentence"))
    low = F.lower("sentence")
    score = F.size(F.filter(keywords(F.col("query")), lambda k: F.contains(low, k))) * 2 + F.least(F.floor(F.length("sentence") / 80).cast("int"), F.lit(2))
    first = s.withColumn("score", score).groupBy("request_id", "sentence").agg(F.max("score").alias("score"), F.min(F.struct("position", "place")).alias("at"))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "at")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("request_id", "rank", "score", "sentence")


def missing(route: Column, kinds: Column, sql_rows: Column) -> Column:
    """What a route lacks: sql_rows, code_snippets, doc_chunks or nothing (null)."""
    has = lambda k: F.array_contains(kinds, k)
    return (
        F.when((route == "sql") & (~has("sql_rows") | (F.coalesce(sql_rows, F.lit(0)) == 0)), "sql_rows")
        .when((route == "code") & ~has("code_snippets"), "code_snippets")
        .when(route.isin("doc_rag", "mixed") & ~has("doc_chunk"), "doc_chunks")
    )


def next_action(lacks: Column) -> Column:
    return F.when(lacks == "doc_chunks", "retrieve").when(lacks == "sql_rows", "sql_query").when(lacks == "code_snippets", "code_search")


def confidence(has_draft: Column, enough: Column, lacks: Column) -> Column:
    """high with a draft and enough evidence, medium if something is missing all the same, else low."""
    sure = F.coalesce(has_draft & enough, F.lit(False))
    return F.when(sure & lacks.isNull(), "high").when(sure, "medium").otherwise("low")
