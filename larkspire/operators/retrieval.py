"""Retrieval of batches of queries: lexical, dense and sparse branches, fusion, ranking, materialisation.

Candidates have (query_id, chunk_id, score, rank). Ties go to the smaller chunk id, so every rank is fixed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.functions import text, vector
from larkspire.session import bounded, kept

DEFAULT_POOL, MAX_POOL = 40, 200
RRF_K = 60


def pool(top_k: int, requested: int | None = None) -> int:
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return max(top_k, min(MAX_POOL, requested if requested is not None else max(DEFAULT_POOL, 4 * top_k)))


def top(scored: DataFrame, k: int, score: str = "score", item: str = "chunk_id") -> DataFrame:
    """The k best of each query, ranked from 1; the limit reaches the map side."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inverted(chunks: DataFrame, chunk_id: str = "chunk_id", body: str = "text") -> DataFrame:
    """The inverted index as a table: (token, chunk_id, tf, length)."""
    tokens = chunks.select(F.col(chunk_id).alias("chunk_id"), text.search_terms(F.col(body)).alias("terms"))
    long = tokens.select("chunk_id", F.size("terms").alias("length"), F.explode("terms").alias("token"))
    return long.groupBy("token", "chunk_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


_ASCII, _RUN, _STOP = re.compile(text.ASCII_TOKEN), re.compile(f"{text.CJK}+"), frozenset(text.STOP_WORDS)


def counted_terms(body: str) -> tuple[Counter, int]:
    """text.search_terms() of one text with their counts, and how many they are."""
    if "\u0130" in body or "\u212a" in body:  # the two letters that are ASCII in lower case only
        found = Counter(t.lower() for t in _ASCII.findall(body))
    else:
        found = Counter(_ASCII.findall(body.lower()))
    if not body.isascii():
        for run in _RUN.findall(body):
            found.update([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])
    total = sum(found.values())
    stopped = sum(found[w] for w in _STOP if w in found)
    if stopped < total:
        for w in _STOP:
            found.pop(w, None)
        total -= stopped
    return found, total


class _Batch:
    """A stated batch of queries as count matrices, in slices of queries whose words times queries are at most CELLS."""

    CELLS = 4_000_000

    def __init__(self, ids: list, bodies: list):
        self.vocabulary: dict[str, int] = {}
        self.slices: list[tuple] = []
        held: list[tuple] = []
        for i, b in zip(ids, bodies, strict=True):
            held.append((i, counted_terms(b or "")[0]))
            words = {w for _, c in held for w in c}
            if len(words) * len(held) >= self.CELLS:
                self._add(held)
                held = []
        if held:
            self._add(held)

    def _add(self, held: list[tuple]) -> None:
        words = sorted({w for _, c in held for w in c})
        local = {w: i for i, w in enumerate(words)}
        q = np.zeros((len(words), len(held)))
        for j, (_, c) in enumerate(held):
            for w, n in c.items():
                q[local[w], j] = n
        for w in words:
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.slices.append((np.array([i for i, _ in held]), np.array([self.vocabulary[w] for w in words], np.int64), q))

    def counts(self, bodies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, word and count of the batch's words in texts, and the texts' lengths."""
        rows, words, counts, lengths = [], [], [], []
        get = self.vocabulary.get
        for i, b in enumerate(bodies):
            found, n = counted_terms(b) if b else ({}, 0)
            lengths.append(n)
            for w, c in found.items():
                j = get(w)
                if j is not None:
                    rows.append(i)
                    words.append(j)
                    counts.append(c)
        return np.array(rows, np.int64), np.array(words, np.int64), np.array(counts, float), np.array(lengths, float)


def _scored(queries: DataFrame, chunks: DataFrame, k: int, every: bool = False, idf: bool = False) -> DataFrame:
    """The k best chunks of each query, by one pass over the texts and a product of count matrices: no token is shuffled.

    The queries are a stated batch of at most MAX_QUERIES, sent to the tasks; each task keeps the k best of every batch of
    rows for each query. More queries go through in slices.
    """
    if queries.count() > MAX_QUERIES:
        return _sliced(queries, lambda q: _scored(q, chunks, k, every, idf))
    asked = queries.select("query_id", "query").toPandas()
    schema = "query_id long, chunk_id long, score double"
    spark = queries.sparkSession
    batch = _Batch(asked["query_id"].tolist(), asked["query"].tolist())
    if not batch.slices:
        return spark.createDataFrame([], schema + ", rank int")
    weights = np.ones(len(batch.vocabulary))
    spread = spark.sparkContext.broadcast(batch)
    if idf:
        n, df = chunks.count(), dict(_frequencies(chunks, spread).collect())  # a row a word of the queries
        weights = np.array([np.log((n + 1) / (df.get(j, 0) + 1)) + 1 for j in range(len(weights))])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = spread.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512].sort_values("chunk_id", kind="stable")
                item = pdf["chunk_id"].to_numpy()
                row, word, count, length = b.counts(pdf["text"])
                for ids, words, q in b.slices:
                    place = np.full(len(b.vocabulary), -1)
                    place[words] = np.arange(len(words))
                    mine = place[word] >= 0
                    x = np.zeros((len(pdf), len(words)))
                    x[row[mine], place[word[mine]]] = count[mine]
                    s = np.round((x @ (q * weights[words][:, None])), 6) if idf else (x @ q) / np.sqrt(np.maximum(length, 1.0))[:, None]
                    if every:
                        s = np.where((x > 0).astype(float) @ (q > 0) == (q > 0).sum(0)[None], s, 0.0)
                    best = np.argsort(-s, axis=0, kind="stable")[:k]
                    got = np.take_along_axis(s, best, 0)
                    r, c = np.nonzero(got > 0)
                    yield pd.DataFrame({"query_id": ids[c], "chunk_id": item[best[r, c]], "score": got[r, c]})

    return top(bounded(chunks.select("chunk_id", "text")).mapInPandas(score, schema), k)


def _frequencies(chunks: DataFrame, spread) -> DataFrame:
    """In how many chunks each word of a batch of queries stands."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = spread.value
        total = np.zeros(len(b.vocabulary), np.int64)
        for pdf in batches:
            total += np.bincount(b.counts(pdf["text"])[1], minlength=len(total))
        yield pd.DataFrame({"word": np.arange(len(total)), "n": total})

    return bounded(chunks.select("text")).mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sliced(queries: DataFrame, run) -> DataFrame:
    parts = -(-queries.count() // MAX_QUERIES)
    out = None
    for i in range(parts):
        found = run(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i))
        out = found if out is None else out.unionByName(found)
    return out


def lexical(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Term-frequency ranking: occurrences of the query's words, repeated ones as often as they come, over the root of the chunk's length."""
    return _scored(queries, chunks, k)


def lexical_and(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """As lexical(), for chunks that hold every token of the query."""
    return _scored(queries, chunks, k, every=True)


def sparse(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Dot product of term counts, weighted by the inverse document frequency ln((N + 1) / (df + 1)) + 1, to six places so that ties don't hang on the order of sums."""
    return _scored(queries, chunks, k, idf=True)


def dense(queries: DataFrame, points: DataFrame, k: int, condition: Column | None = None, block: int = 256) -> DataFrame:
    """Exact nearest vectors by dot product. The filter comes before the search.

    Queries are a stated batch, collected within MAX_QUERIES and sent to the tasks; each task keeps the k best of its
    batch of rows for each query, so what is shuffled is bounded by tasks, queries and k. A larger batch of queries goes
    through in slices.
    """
    points = points if condition is None else points.where(condition)
    if queries.count() > MAX_QUERIES:
        return _sliced(queries, lambda q: dense(q, points, k, None, block))
    asked = queries.select("query_id", "vector").toPandas()
    schema = f"query_id long, chunk_id {'string' if points.schema['chunk_id'].dataType.simpleString() == 'string' else 'long'}, score double"
    if not len(asked):
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    names = asked["query_id"].to_numpy()
    matrix = np.array(asked["vector"].tolist(), np.float64)
    known = queries.sparkSession.sparkContext.broadcast((names, matrix))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = known.value
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("chunk_id", kind="stable")
            x, item = np.array(pdf["vector"].tolist(), np.float64), pdf["chunk_id"].to_numpy()
            if x.shape[1] != q.shape[1]:
                raise ValueError("vectors of different lengths")
            for a in range(0, len(q), block):
                s = q[a : a + block] @ x.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(s)), best.shape[1])
                yield pd.DataFrame({"query_id": ids[a + rows], "chunk_id": item[best.ravel()], "score": s[rows, best.ravel()]})

    return top(bounded(points.select("chunk_id", "vector")).mapInPandas(score, schema), k)


MAX_QUERIES = 4096


def visible(hits: DataFrame, active: DataFrame) -> DataFrame:
    """Hits whose point is the active one of their chunk."""
    return hits.join(active.select("chunk_id", "point_id"), ["chunk_id", "point_id"])


def rrf(primary: DataFrame, secondary: DataFrame, k: int | None = None, weight_primary: Column | float = 0.5, weight_secondary: Column | float = 0.5, constant: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion by one union and one aggregate. Ties: primary rank, secondary rank, id."""
    lit = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    a = primary.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank"), (lit(weight_primary) / (F.lit(constant) + F.col("rank"))).alias("part"))
    b = secondary.select("query_id", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("lexical_rank"), (lit(weight_secondary) / (F.lit(constant) + F.col("rank"))).alias("part"))
    fused = a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def confidence(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of a query's distinct meaningful terms in its first three lexical hits, and whether it asks in CJK of a text without any."""
    first = chunks.select("chunk_id", "text").join(hits.where(F.col("rank") <= 3), "chunk_id")  # three rows a query; Spark broadcasts them if they are small
    joined = first.groupBy("query_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])).alias("body"))
    terms = F.array_distinct(text.meaningful(text.lexicalize(F.col("query"))))
    matched = F.size(F.array_intersect(terms, text.meaningful(text.lexicalize(F.col("body")))))
    ratio = F.when(F.col("body").isNotNull() & (F.size(terms) > 0), matched / F.size(terms)).otherwise(F.lit(0.0))
    cross = F.coalesce(text.contains_cjk(F.col("query")) & (F.col("body") != "") & ~text.contains_cjk(F.col("body")), F.lit(False))
    return queries.select("query_id", "query").join(joined, "query_id", "left").select("query_id", ratio.alias("confidence"), cross.alias("cross_language"))


def policy(told: DataFrame, hash_fallback: bool = False) -> DataFrame:
    """Fusion weights of each query from dense_hits, lexical_hits, confidence and cross_language."""
    d, x, c = F.col("dense_hits") > 0, F.col("lexical_hits") > 0, F.col("confidence")
    # Dense weight, lexical weight and name of each case, in the order in which they are tried.
    table = [
        (~d & x, 0.0, 1.0, "vector-unavailable"),
        (d & ~x, 1.0, 0.0, "lexical-unavailable"),
        (~d & ~x, 0.5, 0.5, "no-candidates"),
        (F.lit(hash_fallback), 0.2, 0.8, "hash-development-fallback"),
        (F.col("cross_language"), 0.9, 0.1, "cross-language-semantic-first"),
        (c >= 0.65, 0.5, 0.5, "strong-lexical-evidence"),
        (c >= 0.35, 0.65, 0.35, "moderate-lexical-evidence"),
    ]

    def pick(i: int, last):
        out = F.when(table[0][0], table[0][i])
        for row in table[1:]:
            out = out.when(row[0], row[i])
        return out.otherwise(last)

    return told.withColumns({"dense_weight": pick(1, 0.8), "lexical_weight": pick(2, 0.2), "policy": pick(3, "weak-lexical-evidence")})


def matched_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """confidence() of hits that an index has told the matched words of (matched, cjk): no text is read."""
    first = hits.where(F.col("rank") <= 3).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("matched"))).alias("held"), F.max("cjk").alias("cjk"))
    terms = F.array_distinct(text.meaningful(text.lexicalize(F.col("query"))))
    ratio = F.when(F.col("held").isNotNull() & (F.size(terms) > 0), F.size(F.array_intersect(terms, "held")) / F.size(terms)).otherwise(F.lit(0.0))
    cross = F.coalesce(text.contains_cjk(F.col("query")) & ~F.col("cjk"), F.lit(False))
    return queries.select("query_id", "query").join(first, "query_id", "left").select("query_id", ratio.alias("confidence"), cross.alias("cross_language"))


def told(queries: DataFrame, d: DataFrame, x: DataFrame, chunks: DataFrame) -> DataFrame:
    """What policy() asks for: confidence and the number of hits of each branch of each query. Hits of an index say themselves what they match."""
    counts = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    sure = matched_confidence(queries, x) if "matched" in x.columns else confidence(queries, x, chunks)
    both = sure.join(counts(d, "dense_hits"), "query_id", "left").join(counts(x, "lexical_hits"), "query_id", "left")
    return both.fillna(0, ["dense_hits", "lexical_hits"])


def hybrid(queries: DataFrame, chunks: DataFrame, points: DataFrame, k: int = 10, requested: int | None = None, index=None) -> DataFrame:
    """Both branches, the policy of each query, weighted fusion. queries: query_id, query, vector. With a lexindex.LexicalIndex of the chunks no text is read."""
    p = pool(k, requested)
    d, x = kept(dense(queries, points, p), "dense"), kept(index.search(queries, p) if index is not None else lexical(queries, chunks, p), "lexical")
    weights = policy(told(queries, d, x, chunks)).select("query_id", "dense_weight", "lexical_weight", "policy")
    fused = rrf(d.join(weights, "query_id"), x.join(weights, "query_id"), k, F.col("dense_weight"), F.col("lexical_weight"))
    return fused.join(weights, "query_id")


def citation(doc_id: Column, location: Column, page: Column, index: Column) -> Column:
    """doc:location:page:chunk, without what is null."""
    return F.concat_ws(":", doc_id.cast("string"), location, F.when(page.isNotNull(), F.concat(F.lit("page="), page.cast("string"))), F.concat(F.lit("chunk="), index.cast("string")))


def materialised(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked candidates with their chunks and citations; hits without a chunk go."""
    rows = chunks.join(ranked, "chunk_id")
    page = F.col("page") if "page" in chunks.columns else F.lit(None)
    return rows.withColumn("citation", citation(F.col("doc_id"), F.coalesce("path", "url"), page, F.col("chunk_index")))


def diversified(ranked: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Greedy suppression in rank order: a hit goes if its word set is as similar to a kept one. ranked: query_id, chunk_id, rank, text.

    A query's candidates are at most its pool, so a group is small by construction.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        rows = []
        for i, t in enumerate(pdf.sort_values("rank")["text"]):
            words = set((t or "").lower().split())
            if words and any(len(words & o) / len(words | o) >= threshold for o in kept):
                continue
            kept.append(words)
            rows.append(i)
        return pdf.sort_values("rank").iloc[rows]

    return ranked.groupBy("query_id").applyInPandas(keep, ranked.schema)


def embed(df: DataFrame, dim: int = 128, body: str = "text") -> DataFrame:
    return df.withColumn("vector", vector.hash_embedding(dim)(F.col(body)))
