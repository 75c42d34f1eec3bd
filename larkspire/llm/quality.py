"""Quality classifier: supervised subword embeddings. Hashed vectors of words and their character n-grams, averaged per document, a softmax over two labels, all learned by stochastic gradient descent in numpy.

A word is a run of anything but white space, in its own case. Its vector is the mean of those of the word and of its
character n-grams, `<` and `>` at its ends. A document's vector is the mean over its words, plus the mean over its pairs of
neighbouring words of the vectors for `same word` and `another word`. Means and softmax input are linear, so scoring adds
up each word's difference of outputs instead of its vector; that gives the same score.

fit() learns from a bounded sample: for each label the row of least hash in each of rows_per_label buckets of a hash of the
text, piece characters of it from a hashed place at most. One task makes `steps` steps over it, drawing labels by their
share of all labelled rows (kept within LEAST_SHARE and put right in the bias afterwards). Neither ids nor labels, language
or source are seen when a text is scored. Scoring reads whole texts.

Labels other than 1 count as 0; null labels and rows without doc_id teach nothing; repeated labels of a document count
once, contradicting ones both. Null and empty texts and those of white space alone score by the bias. Without any labelled
row every score is 0.5. Equal texts get equal scores, an empty table gives an empty one. A text of any length is read
whole, PART characters of new words at a time at least. Extra columns are kept; those named like the outputs are replaced.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspire.llm.common import bounded_batches, in_worker, keeps, mapped
from larkspire.llm.langid import held_out

ROWS_PER_LABEL, PIECE, STEPS = 2048, 4000, 24_000
BUCKETS, DIMENSION, GRAMS = 1 << 16, 16, (2, 3, 4)
RATE, LEAST_SHARE, THRESHOLD = 0.5, 0.05, 0.3
PART, WORDS_KEPT = 1 << 18, 200_000
SAME, OTHER = BUCKETS, BUCKETS + 1  # two more rows of the table of vectors


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of word) of every feature of the words: a word itself and its character n-grams. Vectorised over all of them: one array of code points, a polynomial hash at each place that grows with n."""
    joined = f"<{'> <'.join(words)}>"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 3
    owner = np.repeat(np.arange(len(words), dtype=np.int32), length)[:-1]
    left = (np.cumsum(length) - 1).astype(np.int32)[owner] - np.arange(len(codes), dtype=np.int32)  # characters from here to the separator
    ids, owners = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) % np.uint32(BUCKETS)], [np.arange(len(words), dtype=np.int32)]
    h = codes * np.uint32(0x01000193)
    for n in range(2, GRAMS[-1] + 1):
        h[: 1 - n or None] = h[: 1 - n or None] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in GRAMS:
            starts = np.flatnonzero(left >= n)
            x = (h[starts] + np.uint32(n)) * np.uint32(0x2C1B3C6D)
            ids.append((x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS))
            owners.append(owner[starts])
    return np.concatenate(ids), np.concatenate(owners)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the table of vectors and their weights in a document's vector."""
    every = text.split()
    if not every:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = Counter(every)
    ids, owner = grams(list(counts))
    size = np.bincount(owner, minlength=len(counts))
    weights = (np.array(list(counts.values())) / len(every) / size)[owner]
    if len(every) > 1:
        same = sum(a == b for a, b in zip(every, every[1:], strict=False)) / (len(every) - 1)
        ids, weights = np.concatenate((ids, [SAME, OTHER])), np.concatenate((weights, [same, 1 - same]))
    rows, at = np.unique(ids, return_inverse=True)
    return rows.astype(np.int32), np.bincount(at, weights).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float, steps: int = STEPS, dimension: int = DIMENSION, rate: float = RATE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(outputs of each row of the table, bias), after stochastic gradient descent on the cross entropy. share: of label 1 among all rows."""
    r = np.random.default_rng(seed)
    vectors = (r.random((BUCKETS + 2, dimension), dtype=np.float32) - 0.5) / dimension
    out, bias = np.zeros((dimension, 2), np.float32), np.zeros(2, np.float32)
    by = [[i for i, y in enumerate(labels) if y == c] for c in (0, 1)]
    if not labels:
        return np.zeros((BUCKETS + 2, 2)), np.zeros(2)
    drawn = min(max(share, LEAST_SHARE), 1 - LEAST_SHARE) if by[0] and by[1] else float(bool(by[1]))
    decks: list[list[int]] = [[], []]
    for step in range(steps):
        y = int(r.random() < drawn)
        if not decks[y]:  # each row once before any comes again
            decks[y] = list(r.permutation(by[y]))
        ids, weights = bags[decks[y].pop()]
        hidden = weights @ vectors[ids]
        z = hidden @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        a = rate * (1 - step / steps)
        back = out @ p
        out -= a * np.outer(hidden, p)
        bias -= 0.1 * a * p
        vectors[ids] -= (a * weights)[:, None] * back[None]
    if 0 < drawn < 1:
        share = min(max(share, 1e-9), 1 - 1e-9)
        bias = bias + np.array([0.0, np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))], np.float32)
    return vectors.astype(np.float64) @ out, bias.astype(np.float64)


class Model:
    """Margins of words (output of label 1 less that of label 0), kept for the words seen last; scores of texts."""

    def __init__(self, outputs: np.ndarray, bias: np.ndarray):
        self.margins, self.bias = outputs[:, 1] - outputs[:, 0], float(bias[1] - bias[0])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known = np.zeros(1024)

    def _learn(self, words: list[str]) -> None:
        ids, owner = grams(words)
        while len(self.index) + len(words) > len(self.known):
            self.known = np.concatenate((self.known, np.zeros_like(self.known)))
        at = len(self.index)
        self.known[at : at + len(words)] = np.bincount(owner, self.margins[ids]) / np.bincount(owner)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def _part(self, parted: list[list[str]]) -> np.ndarray:
        new = set().union(*parted) - self.index.keys()
        if len(self.index) + len(new) > WORDS_KEPT:
            self._forget()
            new = set().union(*parted)
        part, chars = [], 0
        for w in new:
            part.append(w)
            chars += len(w)
            if chars >= PART:
                self._learn(part)
                part, chars = [], 0
        if part:
            self._learn(part)
        size = np.array([len(x) for x in parted])
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parted)), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(parted)), size)
        z = self.bias + np.bincount(doc, self.known[ids], len(parted)) / np.maximum(size, 1)
        same = np.bincount(doc[1:], (doc[1:] == doc[:-1]) & (ids[1:] == ids[:-1]), len(parted)) / np.maximum(size - 1, 1)
        z += np.where(size > 1, same * self.margins[SAME] + (1 - same) * self.margins[OTHER], 0.0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def scores(self, texts) -> np.ndarray:
        """The probability of label 1 of each text; the same however texts are put together."""
        out, part, chars = [], [], 0
        for t in texts:
            part.append(t.split() if isinstance(t, str) else [])
            chars += len(t) if isinstance(t, str) else 0
            if chars >= PART:
                out.append(self._part(part))
                part, chars = [], 0
        if part:
            out.append(self._part(part))
        return np.concatenate(out) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", rows_per_label: int = ROWS_PER_LABEL, piece: int = PIECE) -> DataFrame:
    """(y, n, h, doc_id, piece): the bounded sample, n being the rows of the whole table that each row stands for.

    Rows are chosen by narrow columns; a document that many rows share is aggregated before it is joined.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) == 1).cast("int").alias("y")).distinct()
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("text"), F.lit(rows_per_label)), "h": F.xxhash64(F.lit(7), "text")})
    narrow = rows.groupBy("doc_id", "bucket").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    chosen = narrow.join(marked, "doc_id").groupBy("y", "bucket").agg(F.min(F.struct("h", "doc_id")).alias("least"), F.sum("n").alias("n"))
    chosen = chosen.select("y", "n", "least.h", "least.doc_id")  # 2 * rows_per_label rows at most
    start = F.pmod(F.xxhash64(F.lit(9), "text"), F.greatest(F.length("text") - piece, F.lit(0)) + 1)
    return rows.join(F.broadcast(chosen), ["h", "doc_id"]).select("y", "n", "h", "doc_id", F.substring(F.col("text"), (start + 1).cast("int"), F.lit(piece)).alias("piece"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", steps: int = STEPS, rows_per_label: int = ROWS_PER_LABEL, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The model of the labelled rows: 1 MB, whatever the table. One task learns, from the bounded sample."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        every = pd.concat(held).drop_duplicates(["y", "h", "doc_id"]).sort_values(["h", "doc_id", "y"]) if held else pd.DataFrame({"y": [], "n": [], "piece": []})
        y, n = every["y"].astype(int).tolist(), every["n"].to_numpy(float)
        share = float(n[np.array(y) == 1].sum() / n.sum()) if y else 0.5
        outputs, bias = train([bag(t) for t in every["piece"]], y, share, steps)
        yield pd.DataFrame({"outputs": [outputs.astype("<f8").tobytes()], "bias": [bias.astype("<f8").tobytes()]})

    found = mapped(sample(docs, labels, label, text, rows_per_label, piece).repartition(1), learn, "outputs binary, bias binary").collect()  # one row
    if not found:
        return train([], [], 0.5)
    return np.frombuffer(found[0]["outputs"], "<f8").reshape(-1, 2), np.frombuffer(found[0]["bias"], "<f8")


_models: dict[str, Model] = {}


def scored(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score double and predicted int."""
    spark = df.sparkSession
    bounded_batches(spark)
    spread, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # 1 MB

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keeps("quality", _models.clear)
        if name not in _models:
            _models.clear()
            _models[name] = Model(*spread.value)
        m = _models[name]
        for texts in batches:
            score = np.round(m.scores(texts), 9)
            yield pd.DataFrame({"score": score, "predicted": (score >= threshold).astype(np.int32)})

    @F.pandas_udf("score double, predicted int")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from in_worker(told, "quality")(batches)

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("score", "predicted")]
    return df.select(*kept, marked(F.col(f"`{text}`")).alias("__told")).select(*kept, "__told.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.select("doc_id", "text").where(~held_out()), labels.select("doc_id", "quality").where(~held_out()))
    return scored(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model).drop("text")
