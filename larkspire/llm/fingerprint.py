"""Document fingerprints by improved consistent weighted sampling.

A document is a bag of lower-cased words (runs of letters, digits and underscores; in a text without any, what stands
between white space), a word's weight its count. For every word and every one of SAMPLES draws, r and
c are Gamma(2, 1) and beta uniform, made from a hash of the word, so that all documents see the same draws. With
t = floor(ln w / r + beta) and ln a = ln c - r (t - beta) - r, the word of least a and its t are the sample: two documents
agree in one with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima. The
fingerprint has 16 bits of a hash of (word, t) for each draw, in hex.

A word's draws for one weight are worked out once and kept in a bounded table of the worker. Null, empty and blank texts
have the empty fingerprint, which is like itself (1) and unlike all others (0). Equal texts have equal fingerprints.

Neighbours: documents are cut into ranges of doc_id, one to a task; each range gets, beside its own rows, a copy of the
first row after it, so one shuffle suffices whatever the order. The bounds of the ranges are a sorted array that travels
with the tasks; a row finds its range by bisection. Rows with one doc_id stand in falling order of a hash of the text; rows
without doc_id come last. Very long texts are read whole, a slice of their words at a time. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspire.llm.common import bounded_batches, ints, keeps, key, keyed, mapped, shuffle_partitions

SAMPLES = 64
TABLE_ROWS = 200_000

_WORD = re.compile(r"\w+")


def _uniform(seed: np.ndarray, draws: int) -> np.ndarray:
    """Splitmix64 of (seed, draw), two float32 in (0, 1) of each: shape (seeds, 2, draws)."""
    with np.errstate(over="ignore"):
        z = seed[:, None] + (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    out = np.empty((len(seed), 2, draws), np.float32)
    out[:, 0] = z >> np.uint64(41)
    out[:, 1] = (z & np.uint64(0xFFFFFFFF)) >> np.uint64(9)
    out += np.float32(0.5)
    out *= np.float32(1.0 / (1 << 23))
    return out


class Sampler:
    def __init__(self, samples: int = SAMPLES, table_rows: int = TABLE_ROWS):
        self.samples, self.rows = samples, table_rows
        self.table = np.empty((table_rows, samples), np.int64)
        self.place: dict[tuple[str, int], int] = {}

    def _fill(self, terms: list[tuple[str, int]], out: np.ndarray) -> None:
        """Of each term and draw ln a as 32 bits in order, then the 16 bits of the sample: the least number is the least a."""
        n = self.samples
        seed = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w, _ in terms], np.uint64)
        u = _uniform(seed, 3 * n)
        weight = np.log(np.array([c for _, c in terms], np.float32))[:, None]
        r = -np.log(u[:, 0, :n] * u[:, 1, :n])
        c = -np.log(u[:, 0, n : 2 * n] * u[:, 1, n : 2 * n])
        beta = u[:, 0, 2 * n :]
        t = np.floor(weight / r + beta)
        a = (np.log(c) - r * (t - beta) - r).view(np.int32).astype(np.int64)
        with np.errstate(over="ignore"):
            h = (seed[:, None] ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
        out[:] = (a ^ ((a >> 31) & 0x7FFFFFFF)) << 16 | (h >> np.uint64(48)).astype(np.int64)

    def bag(self, weights: dict[str, int]) -> np.ndarray | None:
        """The 16-bit samples of a weighted set; None if it is empty. Long documents are taken in slices of the table's size."""
        if not weights:
            return None
        items, step = list(weights.items()), self.rows // 2
        least = self._least(items[:step])
        for i in range(step, len(items), step):
            least = np.minimum(least, self._least(items[i : i + step]))
        return (least & 0xFFFF).astype(np.uint16)

    def _least(self, items: list[tuple[str, int]]) -> np.ndarray:
        place = self.place
        at = [place.get(x, -1) for x in items]
        if -1 in at:
            new = [x for x, i in zip(items, at, strict=True) if i < 0]
            if len(place) + len(new) > self.rows:
                place.clear()
                new = items
            start = len(place)
            for i in range(0, len(new), 256):
                self._fill(new[i : i + 256], self.table[start + i : start + min(len(new), i + 256)])
            place.update(zip(new, range(start, start + len(new)), strict=True))
            at = [place[x] for x in items]
        return np.minimum.reduce(self.table.take(at, axis=0), axis=0)

    def text(self, text: str) -> np.ndarray | None:
        low = text.lower()
        return self.bag(Counter(_WORD.findall(low) or low.split()))


_samplers: dict[int, Sampler] = {}


def sampler(samples: int = SAMPLES) -> Sampler:
    """One for each worker process, until another operator runs there: what a task has drawn serves the next."""
    keeps("fingerprint", _samplers.clear)
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    return float((a == b).mean())


def hexed(x: np.ndarray | None) -> str:
    return "" if x is None else x.astype(">u2").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """df with the fingerprint of each text."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = sampler(samples)
        for x in batches:
            yield x.map(lambda t: hexed(s.text(t) if isinstance(t, str) else None))

    return df.withColumn(out, made(F.col(text)))


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def ranges(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of (id, hash) begin. An id that takes several percentiles (or is missing in many rows) is cut by hash, evenly."""
    o, h = [], []
    for v, n in sorted(Counter(cuts).items()):
        o += [v] * n
        h += [-(1 << 63) + i * ((1 << 64) // n) for i in range(n)]
    return np.array(o, np.int64), np.array(h, np.int64)


def range_numbers(bounds: tuple[np.ndarray, np.ndarray], o: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many ranges begin at (o, h) or before."""
    first, last = np.searchsorted(bounds[0], o, side="left"), np.searchsorted(bounds[0], o, side="right")
    out = first.copy()
    for v in np.unique(o[last > first]):  # ids that are bounds
        mine = o == v
        a, b = np.searchsorted(bounds[0], [v, v + 1]) if v < (1 << 63) - 1 else (np.searchsorted(bounds[0], v), len(bounds[0]))
        out[mine] = a + np.searchsorted(bounds[1][a:b], h[mine], side="right")
    return out.astype(np.int32)


def digest(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    spark = docs.sparkSession
    buckets = max(2, shuffle_partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"o": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    cuts = rows.select(F.percentile_approx("o", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    bounds = ranges(cuts or [])
    bounded_batches(spark)

    @F.pandas_udf("int")
    def range_of(o: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(bounds, o.to_numpy(np.int64), h.to_numpy(np.int64)))

    slim = rows.select("o", "h").withColumn("bucket", range_of("o", "h"))
    firsts = slim.groupBy("bucket").agg(F.max(F.struct("o", "h")).alias("first")).orderBy(F.desc("bucket")).collect()  # a row a range
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return spark.createDataFrame([], schema)
    # The first row of a range is also read after the last row of the range before: a small table, joined to the rows.
    peeked = [(r["first"]["o"], r["first"]["h"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    known = spark.createDataFrame(peeked, "o long, h long, before int").dropDuplicates(["o", "h"])
    both = rows.withColumn("own", range_of("o", "h")).join(F.broadcast(known), ["o", "h"], "left")
    places = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("peek")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("peek")))))
    ordered = both.select("doc_id", "text", "o", "h", F.inline(places)).repartitionById(len(bounds[0]) + 1, F.col("bucket")).sortWithinPartitions(F.desc("bucket"), "peek", F.desc("o"), F.desc("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, held, at = sampler(samples), None, None
        for pdf in batches:
            out = []
            for doc_id, text, bucket, peek in zip(map(keyed, pdf["doc_id"]), pdf["text"], pdf["bucket"], pdf["peek"], strict=True):
                if bucket != at and held is not None:
                    raise ValueError("a range has no row after its last")
                at = bucket
                if peek and held is None:
                    continue  # a second copy of the same row
                mark = s.text(text)
                if held is not None:
                    before, mine, own = held
                    new = edited(mine, text)
                    other = s.text(new)
                    out.append((before, len(mine), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), hexed(own), hexed(other), likeness(own, other), likeness(own, mark)))
                held = None if peek else (doc_id, text, mark)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.assign(doc_id=ints(r[0] for r in out))

    return mapped(ordered.select(key(F.col("doc_id")).alias("doc_id"), "text", "bucket", "peek"), run, schema, "fingerprint")
