"""Language identification by compression: the language whose raw-content zstandard dictionary makes a text smallest.

fit() takes a bounded sample of labelled rows, BYTES_PER_LANGUAGE of text for each language, chosen by a hash of the row
so that it doesn't depend on order or partitions. Digits, punctuation and case say little: texts and dictionaries are
reduced to words of letters in lower case. A text is cut into blocks of BLOCK bytes and every block is
compressed, so the whole text counts and a long one does not become its own dictionary.

The margin is the share of bytes that the best language saves against the second. Margins below min_margin are rejected.
Null texts and texts without a letter (Unicode category L; fractions and Roman numerals are none) are `und` with score 0
and rejected. Ties go to the language with more rows, then by name. No labelled rows at all: everything is `und`. Repeated
rows get equal results, an empty table an empty one. A text of any length is read whole, a block at a time. Extra columns
are kept; those named like the outputs are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspire.llm.common import bounded_batches, in_worker

BYTES_PER_LANGUAGE = 112 * 1024
ROWS_PER_LANGUAGE = 1024
BYTES_PER_ROW = 600
BLOCK = 1024
LEVEL = 5
MIN_MARGIN = 0.002

_OTHER = re.compile(r"[\W\d_]+")
_UNSURE = re.compile(r"[^\W\d_A-Za-zÀ-ÖØ-öø-ʯ]")
_SURE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ʯ]")


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode category L is there; fractions, superscripts and Roman numerals are numbers."""
    return bool(_SURE.search(text)) or any(unicodedata.category(c)[0] == "L" for c in set(_UNSURE.findall(text)))


def letters(text: str) -> bytes:
    """What is compressed: the words of letters in lower case, one space around each."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", bytes_per_language: int = BYTES_PER_LANGUAGE, rows_per_language: int = ROWS_PER_LANGUAGE, bytes_per_row: int = BYTES_PER_ROW) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample: in each of rows_per_language hash buckets of a language the row of least hash.

    The first bytes_per_row bytes of those rows, in order of hash, fill the dictionary. The driver gets
    rows_per_language short rows for each language at most, and every task sends as many after its partial aggregate.
    Languages come back with the one of most rows first.
    """
    rows = (
        labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
        .select(F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(text), F.lit(rows_per_language)).alias("bucket"), F.xxhash64(F.lit(7), text).alias("h"), F.substring(text, 1, 2 * bytes_per_row).alias("t"))
        .groupBy("lang", "bucket")
        .agg(F.min(F.struct("h", "t")).alias("least"), F.count("*").alias("n"))
        .select("lang", "n", "least.h", "least.t")
        .collect()
    )
    by: dict[str, list] = {}
    total: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["t"])):
        by.setdefault(r["lang"], []).append(r["t"])
        total[r["lang"]] = total.get(r["lang"], 0) + r["n"]
    out = {}
    for name in sorted(by, key=lambda x: (-total[x], x)):
        raw = b"".join(letters(t)[:bytes_per_row] for t in by[name] if not t.isspace())[:bytes_per_language]
        out[name] = raw if len(raw) >= 8 else (raw or b" ") * 8  # a dictionary has 8 bytes at least
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.names, self.block, self.by = list(dictionaries), block, []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        b = letters(text)
        blocks = [b[i : i + self.block] for i in range(0, len(b), self.block)]
        return [sum(len(c.compress(x)) for x in blocks) for c in self.by]

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not text or not self.by or not has_letter(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.names[0], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        return self.names[order[0]], min(1.0, 0.5 + 2.0 * margin), margin < min_margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """df with lang_pred string, score double and rejected boolean. The dictionaries are bounded and travel with the task."""

    bounded_batches(df.sparkSession)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Classifier(dictionaries)
        for s in batches:
            yield pd.DataFrame([c.predict(x if isinstance(x, str) else None, min_margin) for x in s], columns=["lang_pred", "score", "rejected"])

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from in_worker(predicted)(batches)

    return df.drop("lang_pred", "score", "rejected").withColumn("__told", told(F.col(text))).select("*", "__told.*").drop("__told")


def kept(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of df that aren't rejected, with the columns that df has."""
    names = [f"__{i}" for i in range(len(df.columns))]  # so that no column clashes with what is added
    told = identify(df.toDF(*names), dictionaries, names[df.columns.index(text)], min_margin).where("NOT rejected")
    return told.select(*names).toDF(*df.columns)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
