"""Golden sets: which hits are relevant to a case, how many there are, audits of the set.

A case has case_id, category, query, max_rank and the selectors of SELECTORS, arrays of text; a hit has case_id, rank,
chunk_id, doc_id, page, path and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspire.functions.text import canonical_identifier, identifier_matches, strip
from larkspire.session import bounded

# The selectors of a golden case; those of LASTING don't hang on the text.
SELECTORS = ("expected_chunk_ids", "doc_ids", "pages", "path_contains", "identifiers", "all_terms", "any_terms")
LASTING = ("expected_chunk_ids", "doc_ids", "pages", "path_contains")

_LIST = T.ArrayType(T.StringType())
CASE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "category", "query")] + [T.StructField("relevance", T.StructType([T.StructField(s, _LIST) for s in SELECTORS] + [T.StructField("max_rank", T.IntegerType()), T.StructField("relevant_total", T.IntegerType())]))] + [T.StructField("answer", T.StructType([T.StructField("contains_all", _LIST), T.StructField("contains_any", _LIST), T.StructField("min_citations", T.IntegerType())]))])


def golden(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON file {cases: [...]}; a case without id or query, and an id that comes twice, is an error."""
    rows = spark.read.schema(T.StructType([T.StructField("cases", T.ArrayType(CASE))])).json(path, multiLine=True).select(F.inline("cases"))
    rows = rows.select(F.trim("id").alias("case_id"), F.coalesce("category", F.lit("default")).alias("category"), F.trim("query").alias("query"), "relevance.*", "answer")
    checked = rows.agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("ids"), F.count(F.when(F.coalesce("case_id", F.lit("")).eqNullSafe("") | F.coalesce("query", F.lit("")).eqNullSafe(""), 1)).alias("bad")).first()
    if not checked["n"]:
        raise ValueError("a golden set has a list of cases")
    if checked["bad"] or checked["ids"] < checked["n"]:
        raise ValueError("a case needs an id of its own and a query")
    return rows


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Answer samples, one JSON object a line: question, ground_truth, contexts, answer."""
    return spark.read.schema("question string, ground_truth string, contexts array<string>, answer string").json(path)


def _given(c: str) -> Column:
    return F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))) > 0


def _values(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def normalized(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "(?U)\\s+", " "))


def labelled() -> Column:
    """Whether any selector is given."""
    return reduce(lambda a, b: a | b, map(_given, SELECTORS))


def lasting() -> Column:
    """Whether a selector is given that outlives a change of the texts."""
    return reduce(lambda a, b: a | b, map(_given, LASTING))


def matched(pairs: DataFrame, name: str = "relevant") -> DataFrame:
    """pairs of cases and hits with name: by chunk id alone where that is given, else every selector that is given must hold."""
    rows = pairs.withColumn("__text", normalized(F.col("text"))).withColumn("__path", normalized(F.col("path")))
    needs_identifiers = _given("identifiers")
    rows = rows.withColumn("__ident", canonical_identifier(F.when(needs_identifiers, F.col("text"))))
    ident = F.transform(_values("identifiers"), lambda i: F.lower(F.regexp_replace(i, "[\\s_-]", "")))
    terms = lambda c: F.transform(_values(c), normalized)
    checks = [
        ~_given("doc_ids") | F.coalesce(F.array_contains("doc_ids", F.col("doc_id").cast("string")), F.lit(False)),
        ~_given("pages") | F.coalesce(F.array_contains("pages", F.col("page").cast("string")), F.lit(False)),
        ~_given("path_contains") | F.exists(terms("path_contains"), lambda x: F.contains(F.col("__path"), x)),
        ~needs_identifiers | identifier_matches(F.col("__ident"), ident),
        F.forall(terms("all_terms"), lambda x: F.contains(F.col("__text"), x)),
        ~_given("any_terms") | F.exists(terms("any_terms"), lambda x: F.contains(F.col("__text"), x)),
    ]
    by_rest = reduce(lambda a, b: a & b, checks) & labelled()
    hit = F.when(_given("expected_chunk_ids"), F.array_contains("expected_chunk_ids", F.col("chunk_id").cast("string"))).otherwise(by_rest)
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__text", "__path", "__ident")


def entity() -> Column:
    """What counts once among a case's hits: a chunk, a page or a document."""
    chunk = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    page = F.concat_ws(":", F.lit("page"), F.col("doc_id").cast("string"), F.col("page").cast("string"))
    return F.when(_given("expected_chunk_ids"), chunk).when(_given("pages"), page).otherwise(F.concat(F.lit("doc:"), F.coalesce(F.col("doc_id").cast("string"), F.col("path"), F.lit(""))))


def known_total() -> Column:
    """How many relevant entities there are: of the first selector that is given; 1 for those by text; null where none is."""
    out = None
    for c in ("expected_chunk_ids", "pages", "doc_ids", "path_contains"):
        n = F.size(F.array_distinct(_values(c)))
        out = F.when(_given(c), n) if out is None else out.when(_given(c), n)
    return out.when(_given("identifiers") | _given("all_terms") | _given("any_terms"), F.lit(1))


def exact_recall(found_ids: Column, found_pages: Column) -> Column:
    """Share of the expected chunks, or else pages, among the first ten; null where neither is given."""
    part = lambda want, have: F.size(F.array_intersect(F.array_distinct(_values(want)), have)) / F.size(F.array_distinct(_values(want)))
    return F.when(_given("expected_chunk_ids"), part("expected_chunk_ids", found_ids)).when(_given("pages"), part("pages", found_pages))


def audit(cases: DataFrame, profile: str = "development") -> DataFrame:
    """A row a check (name, actual, expected, passed) of a golden set."""
    if profile not in ("development", "production"):
        raise ValueError(f"no profile {profile}")
    # The least number of cases and categories, and the least share of lasting labels, of a profile.
    least, kinds, share = (10, 2, 0.0) if profile == "development" else (50, 3, 0.8)
    stats = cases.agg(F.count("*").alias("n"), F.count(F.when(labelled(), 1)).alias("labelled"), F.count(F.when(lasting(), 1)).alias("lasting"), F.count_distinct("category").alias("kinds"))
    rate = F.round(F.coalesce(F.try_divide(F.col("lasting"), F.col("n")), F.lit(0.0)), 4)
    rows = [("case_count", F.col("n"), F.lit(least), F.col("n") >= least), ("all_cases_labeled", F.col("labelled"), F.col("n"), F.col("labelled") == F.col("n")), ("category_count", F.col("kinds"), F.lit(kinds), F.col("kinds") >= kinds)]
    rows += [("stable_label_rate", rate, F.lit(share), rate >= share)] if profile == "production" else []
    return stats.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), a.cast("double").alias("actual"), e.cast("double").alias("expected"), ok.alias("passed")) for n, a, e, ok in rows])))


def scope(one_document: Column) -> Column:
    """explicit, scoped (by text, within one document) or ambiguous: whether a case can be used to promote."""
    explicit = F.col("relevant_total").isNotNull() | _given("expected_chunk_ids") | _given("doc_ids")
    by_text = reduce(lambda a, b: a | b, map(_given, ("pages", "identifiers", "path_contains", "all_terms", "any_terms")))
    return F.when(explicit, "explicit").when(by_text & one_document, "scoped").otherwise("ambiguous")


def sampled_indexes(spark: SparkSession, n: int, k: int) -> DataFrame:
    """k indexes evenly spread over 0..n - 1, rounded half to even, each once."""
    if k >= n:
        return spark.range(n).select(F.col("id").alias("index"))
    return spark.range(k).select(F.bround(F.col("id") * (n - 1) / max(1, k - 1)).cast("long").alias("index")).distinct()


PASSAGES = 100_000


def _machine(known: list[tuple]):
    """An automaton over (id, passage) pairs; a passage may have several ids."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, p in known:
        if p:
            out.add_word(p, (*out.get(p, ()), i))
    out.make_automaton()
    return out


def _sliced(items: DataFrame, key: str, run) -> DataFrame:
    """run over slices of a stated set of passages, PASSAGES at most in each: an automaton travels to every task."""
    parts = max(1, -(-items.count() // PASSAGES))
    out = None
    for i in range(parts):
        known = [tuple(r) for r in items.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i).collect()]
        found = run(items.sparkSession.sparkContext.broadcast(known))
        out = found if out is None else out.unionByName(found)
    return out


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a document's body has an item's passage."""

    def run(spread) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = _machine(spread.value)
            for pdf in batches:
                rows = [(i, d) for d, t in zip(pdf["k"], pdf["body"], strict=True) if t for i in {i for _, found in machine.iter(t) for i in found}] if len(machine) else []
                yield pd.DataFrame(rows, columns=["item_id", "k"]).astype({"item_id": "int64", "k": "object"})

        # The key travels as text, so that a null one doesn't turn integers into floating point.
        found = bounded(docs.select(F.col("doc_id").cast("string").alias("k"), "body")).mapInPandas(find, "item_id long, k string")
        return found.select("item_id", F.col("k").cast("long").alias("doc_id"))

    return _sliced(items.select("item_id", "passage"), "item_id", run)


def standing(bodies: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms (term) that stand in one of the bodies (body): every task tells each term once."""

    def run(spread) -> DataFrame:
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine, seen = _machine([(t, t) for (t,) in spread.value]), set()
            for pdf in batches:
                if len(machine):
                    seen.update(i for t in pdf["body"] if t for _, found in machine.iter(t) for i in found)
            yield pd.DataFrame({"term": sorted(seen)}, dtype=object)

        return bounded(bodies.select("body")).mapInPandas(find, "term string").distinct()

    return _sliced(terms.select("term"), "term", run)


def label_coverage(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Share of the cases with terms whose terms (all of all_terms, one of any_terms) stand in one of the texts' documents. cases are a stated set."""
    asked = cases.where(_given("all_terms") | _given("any_terms")).select("case_id", _values("all_terms").alias("all_terms"), _values("any_terms").alias("any_terms"))
    words = asked.select("case_id", F.lit("all").alias("kind"), F.explode("all_terms").alias("term")).unionByName(asked.select("case_id", F.lit("any").alias("kind"), F.explode("any_terms").alias("term")))
    words = words.withColumn("term", normalized(F.col("term")))
    found = standing(texts.select(normalized(F.col("text")).alias("body")), words.select("term").distinct())
    empty = words.where("term = ''").select("term").distinct()  # stands in every text
    found = found.unionByName(empty).distinct()
    hit = words.join(found.withColumn("hit", F.lit(True)), "term", "left")
    per = hit.groupBy("case_id").agg(F.bool_and(F.coalesce("hit", F.lit(False)) | (F.col("kind") == "any")).alias("a"), F.coalesce(F.bool_or(F.when(F.col("kind") == "any", F.coalesce("hit", F.lit(False)))), F.lit(True)).alias("b"))
    return per.agg(F.coalesce(F.round(F.avg((F.col("a") & F.col("b")).cast("int")), 6), F.lit(1.0)).alias("label_text_coverage"))
