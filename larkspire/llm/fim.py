"""Fill-in-middle: a text is cut at two places into prefix, middle and suffix, and the middle goes to the end.

A text becomes an array of its code points (UTF-32, numpy). Neighbours of different class have a boundary between them:
np.flatnonzero of the comparison gives all boundaries, two drawn ranks choose among them, and the pieces between are
sliced and encoded again. Classes by unit: `character` gives each code point a class of its own, so that every place is a
boundary; `word` tells white space from the rest; `line` counts the line feeds before.

The draws are hashes of seed and key, so a row gets the same cut in whatever partition it stands. Null texts count as
empty and empty ones are plain, as are those that hold a marker (restoring would be ambiguous) and plain_percent of the
others. A null key is drawn like an empty one. Equal rows get equal results, an empty table an empty one. A text of any
length is cut whole; a task needs some 30 bytes for each code point of the longest one. Extra columns are kept; those named
like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspire.llm.common import bounded_batches, in_worker, ints

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20
OUTPUTS = ["n", "form", "prefix_chars", "middle_chars", "output"]

# The code points of white space in Unicode.
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """The class of each code point; neighbours of one class are never parted."""
    if unit == "character":
        return np.arange(len(codes), dtype=np.int32)
    if unit == "word":
        return np.isin(codes, SPACES)
    if unit == "line":
        return np.concatenate(([0], np.cumsum(codes[:-1] == 10)))
    raise ValueError(f"no unit {unit}; there are character, word and line")


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """All places where a text may be cut, its start and end included: one more than it has units."""
    if not len(codes):
        return np.zeros(1, np.int64)
    c = classes(codes, unit)
    return np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(codes)]))


def transform(text: str | None, draws: tuple[int, int, int, int], unit: str = "character", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    codes = points(text)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= 100 - plain_percent:
        return len(codes), "plain", None, None, text
    at = boundaries(codes, unit)
    first, second = sorted((draws[0] % len(at), draws[1] % len(at)))
    a, b = int(at[first]), int(at[second])
    head, mid, tail = piece(codes[:a]), piece(codes[a:b]), piece(codes[b:])
    if draws[3] % 100 < spm_percent:
        return len(codes), "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}"
    return len(codes), "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}"


def restore(output: str, form: str) -> str:
    """The text of an output: its markers are those of its form, and the text has none."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, rest = output[len(PREFIX) :].split(second, 1)
    two, mid = rest.rsplit(MIDDLE, 1)
    return one + mid + two if form == "psm" else two + mid + one


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a row: the first four groups of the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, unit: str = "character", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """df with n, form (plain, psm or spm), prefix_chars, middle_chars and output."""
    bounded_batches(df.sparkSession)

    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *drawn in batches:
            rows = [transform(t if isinstance(t, str) else None, d, unit, plain_percent, spm_percent) for t, d in zip(texts, zip(*(x.tolist() for x in drawn), strict=True), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"n": ints(n), "form": pd.Series(form, dtype=object), "prefix_chars": ints(prefix), "middle_chars": ints(middle), "output": pd.Series(output, dtype=object)})

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def told(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from in_worker(cut, "fim")(batches)

    kept = [F.col(f"`{c}`") for c in df.columns if c not in OUTPUTS]
    return df.select(*kept, told(F.col(text), *draws(F.col(key), seed)).alias("__told")).select(*kept, "__told.*")


def restored(df: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """df with the text that an output was made of."""
    bounded_batches(df.sparkSession)

    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from in_worker(back, "fim")(batches)

    return df.withColumn(name, told(F.col(output), F.col(form)))


def digest(docs: DataFrame) -> DataFrame:
    both = restored(transformed(docs.select("doc_id", "text")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(t, 1, a) AS head, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS tail FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
