"""Exact top-k search by inner product: a Voronoi kNN join.

Data vectors x become points (x, sqrt(M^2 - |x|^2)) and queries (q, 0), M the largest norm, so that larger inner
products are smaller distances. Data are grouped by their nearest pivot; of every group a summary is kept (count, range
of distances to the pivot, the k + 1 smallest of them). From summaries alone each query has an upper bound for the
distance of its k-th neighbour, hence for every data group an interval of pivot distances (and a hyperplane test) outside
which no neighbour can be. Query groups take the union of their queries' intervals, data rows are sent to those query
groups only, and each block of queries and data is solved by matrix products of slices. Blocks are bounded by bytes: a
group of many rows is dealt by a hash of the id, so one hot vector or pivot fills many blocks.

There are as many pivots as the root of the number of rows, up to what the driver holds; cells beyond that grow, blocks
don't. Summaries and intervals are bounded by the number of pivots and query groups, not by the data. Codes travel in the
narrowest integers that hold them all.

Vectors that are null or have null or non-finite components take no part, nor do rows without id; shorter vectors count
as padded with zeros; a zero or empty vector scores 0. Equal scores go to the smaller id. A query's own id is never its
neighbour. With fewer than k candidates all of them are returned; with none the query has no rows. Repeated rows count
once; of rows with one id and different vectors the one of the least codes takes part. Components beyond 2^20 in size are
multiplied as Python integers; scores must fit 64 bits. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspire.llm.common import bounded_batches, mapped, stored

K, SCALE = 5, 256
#: As many as a driver holds the distances of (the square of it), and the queries of a group.
PIVOTS, QUERIES_PER_GROUP = 4096, 2048
#: Bytes of a block as codes of 8 bytes, and the rows of a slice of it that are multiplied at once.
BLOCK_BYTES, SLICE = 16 << 20, 2048
EXACT = 1 << 20


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and codes = floor(scale * x) of the rows that take part."""
    e = F.col(embedding)
    good = F.col(vec_id).isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("codes"))


def _once(df: DataFrame) -> DataFrame:
    """A row for each vec_id. Only ids are shuffled where none is repeated."""
    df = df.select("vec_id", "codes")
    if df.groupBy("vec_id").count().where("count > 1").isEmpty():
        return df
    return df.groupBy("vec_id").agg(F.min("codes").alias("codes"))


def _matrix(codes: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(codes), dim), np.int64)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def _lifted(x: np.ndarray, m2: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))[:, None]])


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * a @ pivots.T))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: in floating point while every partial sum is below 2^53, else in Python's integers."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= EXACT and q.shape[1] <= 1 << 12:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def join(queries: DataFrame, data: DataFrame, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score; queries and data have vec_id and codes."""
    spark = data.sparkSession
    bounded_batches(spark)
    queries, data = _once(queries), _once(data)
    size = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    about = data.agg(F.count("*").alias("n"), F.max(size).alias("m2"), F.max(F.size("codes")).alias("dim"), F.max(F.coalesce(F.array_max(F.transform("codes", F.abs)), F.lit(0))).alias("widest")).first()
    nq, qdim, qwidest = queries.agg(F.count("*"), F.max(F.size("codes")), F.max(F.coalesce(F.array_max(F.transform("codes", F.abs)), F.lit(0)))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not about["n"] or not nq:
        return spark.createDataFrame([], empty)
    dim, m2 = max(about["dim"], qdim, 1), float(about["m2"])
    kind = next(np.dtype(t) for t in ("<i2", "<i4", "<i8") if max(about["widest"], qwidest) <= np.iinfo(t).max)
    block = max(SLICE, BLOCK_BYTES // (8 * dim))
    wanted = max(1, min(pivots, int(about["n"] ** 0.5)))
    least = F.min(F.struct(F.xxhash64(F.lit(7), "vec_id").alias("h"), "vec_id", "codes")).alias("least")
    chosen = data.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(wanted))).agg(least).select("least.*").orderBy("h", "vec_id").toPandas()
    P = _lifted(_matrix(chosen["codes"], dim), m2)
    slack = 1e-6 * (1.0 + float(np.sqrt(m2)))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["codes"], dim)
                d = _distances(_lifted(x, m2), P)
                cell = d.argmin(1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "codes": [r.tobytes() for r in x.astype(kind)], "cell": cell, "dist": d[np.arange(len(d)), cell]})

    dealt = stored(mapped(data, cells, "vec_id long, codes binary, cell int, dist double"), "cells")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple] = {}
        for pdf in batches:
            for c, g in pdf.groupby("cell")["dist"]:
                n, lo, hi, least = seen.get(c, (0, np.inf, -np.inf, []))
                seen[c] = (n + len(g), min(lo, g.min()), max(hi, g.max()), sorted([*least, *g.nsmallest(k + 1)])[: k + 1])
        yield pd.DataFrame([(int(c), *v) for c, v in seen.items()], columns=["cell", "n", "lo", "hi", "least"])

    merged = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least")]
    parts = mapped(dealt.select("cell", "dist"), partial, "cell int, n long, lo double, hi double, least array<double>")
    summary = parts.groupBy("cell", F.spark_partition_id() % 64).agg(*merged).groupBy("cell").agg(*merged).toPandas()  # a row a pivot
    at = summary["cell"].to_numpy()
    number, lo, hi = np.zeros(len(P), np.int64), np.full(len(P), np.inf), np.full(len(P), -np.inf)
    number[at], lo[at], hi[at] = summary["n"], summary["lo"], summary["hi"]
    near_cell = np.concatenate([np.full(len(x), c) for c, x in zip(at, summary["least"], strict=True)])
    near_dist = np.concatenate([np.asarray(x, float) for x in summary["least"]])
    between = _distances(P, P)

    def reach(x: np.ndarray):
        """Of each query: its cell, and for each data cell the interval of pivot distances that may hold neighbours."""
        a = np.hstack([x.astype(np.float64), np.zeros((len(x), 1))])
        d = _distances(a, P)
        own = d.argmin(1)
        bounds = d[:, near_cell] + near_dist[None]
        theta = (np.partition(bounds, k, axis=1)[:, k] if bounds.shape[1] > k else np.full(len(x), np.inf)) + slack
        low, high = np.maximum(d - theta[:, None], lo[None]), np.minimum(d + theta[:, None], hi[None])
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * between[own])
        plane[np.arange(len(d)), own] = 0.0
        far = (np.nan_to_num(plane, nan=0.0, posinf=0.0) > theta[:, None]) | (low > high + slack)
        return own, np.where(far, np.inf, low - slack), np.where(far, -np.inf, high + slack)

    groups = max(1, min(len(P), nq // QUERIES_PER_GROUP))
    order = np.lexsort((np.arange(len(P)), between[0]))
    group_of = np.empty(len(P), np.int64)
    group_of[order] = np.arange(len(P)) * groups // len(P)

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low, high = np.zeros(groups, np.int64), np.full((groups, len(P)), np.inf), np.full((groups, len(P)), -np.inf)
        for pdf in batches:
            if len(pdf):
                own, a, b = reach(_matrix(pdf["codes"], dim))
                g = group_of[own]
                np.minimum.at(low, g, a)
                np.maximum.at(high, g, b)
                n += np.bincount(g, minlength=groups)
        if n.any():
            yield pd.DataFrame({"g": np.arange(groups), "n": n, "low": low.tolist(), "high": high.tolist()})

    wide = mapped(queries, intervals, "g int, n long, low array<double>, high array<double>").select("g", "n", F.posexplode(F.arrays_zip("low", "high")))
    both = wide.groupBy("g", "pos").agg(F.sum("n").alias("n"), F.min("col.low").alias("low"), F.max("col.high").alias("high")).toPandas()  # groups * pivots rows
    low, high, asked = np.full((groups, len(P)), np.inf), np.full((groups, len(P)), -np.inf), np.zeros(groups, np.int64)
    low[both["g"], both["pos"]], high[both["g"], both["pos"]], asked[both["g"]] = both["low"], both["high"], both["n"]
    data_blocks = np.maximum(1, -(-((low <= high) * number[None]).sum(1) // block))
    query_blocks = np.maximum(1, -(-asked // block))

    def mixed(ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)

    def send(pdf: pd.DataFrame, rows: np.ndarray, g: np.ndarray, fixed: np.ndarray, others: np.ndarray, query: bool) -> pd.DataFrame:
        """A row for each block of the other side in its group."""
        again = others[g]
        rows, g, own = np.repeat(rows, again), np.repeat(g, again), np.repeat(fixed, again)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(again) - again, again)
        qb, sb = (own, other) if query else (other, own)
        return pd.DataFrame({"g": g, "qb": qb, "sb": sb, "vec_id": pdf["vec_id"].to_numpy()[rows], "codes": pdf["codes"].to_numpy()[rows]})

    def send_data(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c, d = pdf["cell"].to_numpy(), pdf["dist"].to_numpy()
            for g in range(groups):
                rows = np.flatnonzero((low[g][c] <= d) & (d <= high[g][c]))
                if len(rows) and asked[g]:
                    ids = pdf["vec_id"].to_numpy()[rows]
                    yield send(pdf, rows, np.full(len(rows), g), (mixed(ids) % np.uint64(data_blocks[g])).astype(np.int64), query_blocks, False)

    def send_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["codes"], dim)
                own = _distances(np.hstack([x.astype(np.float64), np.zeros((len(x), 1))]), P).argmin(1)
                g = group_of[own]
                fixed = (mixed(pdf["vec_id"].to_numpy()) % query_blocks[g].astype(np.uint64)).astype(np.int64)
                yield send(pdf.assign(codes=[r.tobytes() for r in x.astype(kind)]), np.arange(len(pdf)), g, fixed, data_blocks, True)

    def solve(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "vec_id", "score"]
        if not len(qs) or not len(xs):
            return pd.DataFrame(columns=cols).astype("int64")
        xs = xs.sort_values("vec_id", kind="stable")
        read = lambda s: np.frombuffer(b"".join(s), kind).reshape(len(s), dim).astype(np.int64)
        out = []
        for a in range(0, len(qs), SLICE):
            qids, q = qs["vec_id"].to_numpy()[a : a + SLICE], read(qs["codes"].iloc[a : a + SLICE])
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(qids)
            for b in range(0, len(xs), SLICE):
                ids = xs["vec_id"].to_numpy()[b : b + SLICE]
                score, n = _product(q, read(xs["codes"].iloc[b : b + SLICE])), len(ids)
                wide = np.abs(score).max() >= (1 << 62) // (n + k)
                for i, own in enumerate(qids):
                    mine = np.flatnonzero(ids != own)
                    s, names = np.concatenate([best[i][1], score[i][mine]]), np.concatenate([best[i][0], ids[mine]])
                    if wide:
                        keep = np.argsort(-s.astype(object), kind="stable")[:k]
                    else:  # what was kept has smaller ids: among equal scores the first goes first
                        order = s * (n + k) + (n + k - 1 - np.arange(len(s)))
                        keep = np.argpartition(order, len(s) - k)[len(s) - k :] if len(s) > k else np.arange(len(s))
                        keep = keep[np.argsort(-order[keep])]
                    keep.sort()
                    best[i] = (names[keep], s[keep])
            out += [np.column_stack([np.full(len(names), own), names, s]) for own, (names, s) in zip(qids, best, strict=True)]
        return pd.DataFrame(np.vstack(out), columns=cols)

    sent = "g int, qb int, sb int, vec_id long, codes binary"
    left = mapped(queries, send_queries, sent).groupBy("g", "qb", "sb")
    right = mapped(dealt, send_data, sent).groupBy("g", "qb", "sb")
    found = left.cogroup(right).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    rows = quantised(embeddings)
    return join(rows.where("vec_id % 50 = 0"), rows)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
