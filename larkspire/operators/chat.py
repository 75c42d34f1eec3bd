"""Conversations: the query of a chat, its history, bounded sessions, keyword routes, checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.functions.text import strip

# Substrings that send a question to a tool, tried in this order.
ROUTES = (
    ("sql", ("select", "from", "join", "where", "group by", "报表", "统计", "sum", "count")),
    ("code", ("stacktrace", "error", "exception", "报错", "函数", "方法", "class", "代码", "repo")),
    ("doc_rag", ("规范", "文档", "说明", "教程", "指南")),
)


def prepared(turns: DataFrame) -> DataFrame:
    """Of each conversation the query (last user turn with text, else the last turn), the system prompt and the history."""
    role, content = F.lower(F.trim("role")), strip(F.coalesce("text", F.lit("")))
    t = turns.select("conv_id", "turn", role.alias("role"), content.alias("content"))
    asked = F.max(F.when((F.col("role") == "user") & (F.col("content") != ""), F.col("turn")))
    t = t.withColumn("at", F.coalesce(asked.over(Window.partitionBy("conv_id")), F.max("turn").over(Window.partitionBy("conv_id"))))
    kept = F.col("content") != ""
    item = F.struct("turn", "role", "content")
    system = F.array_sort(F.collect_list(F.when(kept & (F.col("role") == "system"), item)))
    history = F.array_sort(F.collect_list(F.when(kept & F.col("role").isin("user", "assistant") & (F.col("turn") != F.col("at")), item)))
    return t.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == F.col("at"), F.col("content"))).alias("query"),
        F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda x: x["content"]), "\n\n")).alias("system_prompt"),
        F.transform(history, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"),
    )


def session(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def route(query: Column) -> Column:
    out = None
    for name, hints in ROUTES:
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(query, F.lit(h))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("mixed")


def constraints(query: Column) -> Column:
    """(repo, source_types) that a question names: repo:name, and pdf or web."""
    repo = F.nullif(F.regexp_extract(query, "repo:([\\w\\-/]+)", 1), F.lit(""))
    web = F.contains(query, F.lit("web")) | F.contains(query, F.lit("\u7f51\u9875"))
    kind = F.when(F.contains(query, F.lit("pdf")), "pdf").when(web, "web")
    return F.struct(repo.alias("repo"), kind.alias("source_type"))


def expectation(answer: Column, contains_all: list[str], contains_any: list[str], citations: Column, min_citations: int) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    ok = citations >= min_citations
    for w in contains_all:
        ok = ok & F.contains(low, F.lit(w.lower()))
    if contains_any:
        some = F.lit(False)
        for w in contains_any:
            some = some | F.contains(low, F.lit(w.lower()))
        ok = ok & some
    return ok


ITERATIONS = 3


def answered(question: str, tools: dict, route_of, missing_of, most: int = ITERATIONS) -> dict:
    """The agent's loop over one question: the route's tool, then whatever is missing, at most so often. tools: action -> evidence list; missing_of(route, evidence) -> (lacks, next action) or None."""
    route, evidence, actions = route_of(question), [], []
    action = {"sql": "sql_query", "code": "code_search"}.get(route, "retrieve")
    for _ in range(most):
        actions.append(action)
        evidence += tools[action](question)
        lacks = missing_of(route, evidence)
        if lacks is None:
            return {"route": route, "evidence": evidence, "actions": actions, "confidence": "high"}
        action = lacks[1]
    return {"route": route, "evidence": evidence, "actions": actions, "confidence": "low"}
