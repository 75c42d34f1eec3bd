"""Best-fit packing of documents into sequences, in bulk-synchronous supersteps over range-sorted documents and gaps.

Documents and gaps are whole numbers up to the capacity, so both sorted lists are held as runs: a length with its
documents by rank, a gap with its sequences. Lengths are taken in bands, the longest first. In a superstep the runs are
range-partitioned by size and each range is swept on its own, lengths and gaps from above: a length goes to its successor
in the gaps (the smallest that is large enough), conflicts are resolved by rank (the longer document first, then the
q-th document of the length to the q-th sequence of the gap, round again while the gap holds more), and the gaps that
are left are put back. What finds no gap in its range is swept again with the ranges joined, and what finds none at all
opens sequences. A range has as many runs as sizes, whatever the number of documents, and only the outcome (an interval
of ranks -> an interval of sequences) goes back to the rows, which find their place by their rank in their length.
Ranks are dealt by (length, salt); a length has a salt for every ROWS_PER_SALT of its documents, so one that a third of
all documents have is counted in many tasks.

Documents longer than the capacity are cut into pieces of the capacity; the last may be shorter. Null and empty texts are
documents of the end id alone, however long a text is, all its ids are packed. Repeated rows are packed as often as they
come, rows without doc_id too. Ties (equal lengths) go by doc_id, piece and content. An empty table gives an empty
result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspire.llm import fasttok
from larkspire.llm.common import discard, ints, key, keyed, mapped, stored

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Lengths above capacity / 2^i are a band, the last has all the others; ranges of a first sweep are so wide.
BANDS, RANGE = 6, 256
#: Pieces of one length that one task ranks, and how many such groups there are at most (they are widened beyond that).
ROWS_PER_SALT, MOST_SALTS = 1_000, 1_000_000


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's pieces; ids are made and dropped where the text is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = fasttok.encoder(fasttok.WordBpe, vocab), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["d"], pdf["t"], strict=True):
                ids = (enc.ids(t) if isinstance(t, str) else b"") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((keyed(d), k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=ints(r[0] for r in rows))

    return mapped(docs.select(key(F.col(doc_id)).alias("d"), F.col(text).alias("t")), run, PIECES, "fasttok")


def sweep(lengths: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, used: int | None = None):
    """Best fit of runs (length, first rank, documents) into runs (gap, first sequence, sequences).

    Returns steps (length, rank, a_turn, first, offset), the lengths and the gaps that are left, and used. The document of
    rank r of a length goes by its last step with rank <= r; with q = r - rank it gets the sequence first + q % a_turn and
    the offset offset + (q // a_turn) * length. With used, the number of sequences that there are, what finds no gap
    opens new ones.
    """
    held: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of the gaps that there are, ascending
    out, left = [], []

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in held:
                held[gap] = []
                bisect.insort(sizes, gap)
            held[gap].append((first, n))

    for g in sorted(gaps, reverse=True):
        put(*g)
    for length, rank, n in sorted(lengths, key=lambda x: (-x[0], x[1])):
        end = rank + n
        while rank < end:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                if used is None:
                    left.append((length, rank, end - rank))
                    break
                opened = -(-(end - rank) // (capacity // length))
                put(capacity, used, opened)
                used += opened
                continue
            gap = sizes[at]
            first, bins = held[gap].pop()
            if not held[gap]:
                del held[gap]
                sizes.pop(at)
            fit = gap // length
            full = min(bins, (end - rank) // fit)
            if full:
                out.append((length, rank, full, first, capacity - gap))
                rank += full * fit
                put(gap - fit * length, first, full)
                first, bins = first + full, bins - full
            if bins and rank < end and end - rank < fit:
                out.append((length, rank, 1, first, capacity - gap))
                put(gap - (end - rank) * length, first, 1)
                rank, first, bins = end, first + 1, bins - 1
            put(gap, first, bins)
    return out, left, [(g, *x) for g in sizes for x in held[g]], used


#: kind: d a run of documents (size: length, first: rank), g of gaps (size, first: sequence), u the number of sequences
#: (n), s a step (size: length, first: rank, n: documents a turn, seq, offset).
_RUNS = "kind string, size int, first long, n long, seq long, offset int"


def best_fit(counts: DataFrame, capacity: int = CAPACITY, bands: int = BANDS, width: int = RANGE) -> tuple[np.ndarray, int]:
    """Supersteps over counts (length, n): the steps, and the number of sequences."""
    spark = counts.sparkSession

    def swept(opens: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            of = {k: list(g[["size", "first", "n"]].itertuples(index=False, name=None)) for k, g in pdf.groupby("kind")}
            used = of["u"][0][2] if opens else None
            steps, left, gaps, used = sweep(of.get("d", []), of.get("g", []), capacity, used)
            rows = [("s", x, r, n, q, o) for x, r, n, q, o in steps] + [("d", *x, None, None) for x in left] + [("g", *x, None, None) for x in gaps]
            rows += [("u", 0, 0, used, None, None)] * opens
            return pd.DataFrame(rows, columns=["kind", "size", "first", "n", "seq", "offset"]).astype({"seq": "Int64", "offset": "Int32"})

        return run

    none = spark.range(1).selectExpr("'u' AS kind", "0 AS size", "0L AS first", "0L AS n", "CAST(NULL AS long) AS seq", "CAST(NULL AS int) AS offset")
    docs = counts.selectExpr("'d' AS kind", "CAST(length AS int) AS size", "0L AS first", "CAST(n AS long) AS n", "CAST(NULL AS long) AS seq", "CAST(NULL AS int) AS offset")
    now, done = stored(docs.unionByName(none).coalesce(1), "runs"), []
    for band in range(bands):
        low = capacity >> (band + 1) if band + 1 < bands else 0
        for opens in ((False, True) if band else (True,)):
            mine = ((F.col("kind") == "d") & (F.col("size") > low)) | ((F.col("kind") == "g") & (F.col("size") > low)) | ((F.col("kind") == "u") & F.lit(opens))
            runs = now.where("kind <> 's'")
            at = F.lit(0) if opens else F.floor(F.col("size") / width)
            new = runs.where(mine).withColumn("range", at).groupBy("range").applyInPandas(swept(opens), _RUNS)
            now = stored(new.unionByName(runs.where(~mine)).coalesce(1), "runs", () if done and now is done[-1] else (now,))
            done.append(now)
    steps = reduce(DataFrame.unionByName, [x.where("kind = 's'") for x in done]).select("size", "first", "n", "seq", "offset").toArrow()
    used = now.where("kind = 'u'").first()["n"]
    discard(*done)
    out = np.column_stack([steps.column(i).to_numpy().astype(np.int64) for i in range(5)]).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], -out[:, 0]))], used


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (with doc_id, piece and length), a stored table, with sequence_id and offset."""
    spark = found.sparkSession
    totals = stored(found.groupBy("length").agg(F.count("*").alias("n")).coalesce(1), "lengths")  # at most a row a length
    steps, _ = best_fit(totals, capacity)
    total = {r["length"]: r["n"] for r in totals.collect()}
    discard(totals)
    each = max(ROWS_PER_SALT, sum(total.values()) // MOST_SALTS)
    salts = np.ones(capacity + 1, np.int64)
    for length, n in total.items():
        salts[length] = -(-n // each)
    most = int(salts.max())
    split = F.create_map(*[F.lit(x) for length, n in total.items() if n > each for x in (length, int(salts[length]))]) if most > 1 else None
    of = F.coalesce(split[F.col("length")], F.lit(1)) if most > 1 else F.lit(1)
    salted_rows = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), of).cast("int"))
    by = salted_rows.groupBy("length", "__salt").count().toArrow()  # at most capacity + MOST_SALTS rows
    lengths, salted, n = (by.column(i).to_numpy() for i in range(3))
    order = np.lexsort((salted, lengths))
    before = np.cumsum(n[order]) - n[order]
    keys = lengths[order].astype(np.int64) * most + salted[order]
    firsts = before[np.searchsorted(keys, (keys // most) * most)] if len(keys) else before
    base = before - firsts
    # Rows of steps are in falling order of length and rising order of rank: one sorted key for both.
    big = int(max(total.values(), default=0)) + 1
    step_keys = (capacity - steps[:, 0]) * big + steps[:, 1]
    known = spark.sparkContext.broadcast((keys, base, steps, step_keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, base, steps, step_keys = known.value
        for pdf in batches:
            length = pdf["length"].to_numpy()
            rank = base[np.searchsorted(keys, length * most + pdf["__salt"].to_numpy())] + pdf["__rank"].to_numpy() - 1
            s = steps[np.searchsorted(step_keys, (capacity - length) * big + rank, side="right") - 1]
            q = rank - s[:, 1]
            yield pdf.drop(columns=["__salt", "__rank"]).assign(doc_id=ints(map(keyed, pdf["doc_id"])), sequence_id=s[:, 3] + q % s[:, 2], offset=s[:, 4] + (q // s[:, 2]) * length)

    window = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted_rows.withColumn("__rank", F.row_number().over(window))
    return mapped(ranked.withColumn("doc_id", key(F.col("doc_id"))), run, f"{PIECES}, sequence_id long, offset long", "fasttok")


def digest(docs: DataFrame, vocab: str) -> DataFrame:
    return pack(stored(pieces(docs, vocab), "pieces"))
