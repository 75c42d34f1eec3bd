"""Text functions as Column expressions: lexical tokens, scores, identifiers, versions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a lexical query or document loses, unless nothing else is left of it.
STOP_WORDS = (
    "a an and are as at be been being between by can could did do does for from had has have how i if in into is it its of on or our "
    "should that the their them there these this those to was were what when where which who why will with would you your"
).split()
# The three ranges that count as CJK, and an ASCII token.
CJK = "[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"
ASCII_TOKEN = "[A-Za-z0-9_\\-]+"
SENTENCE_END = ".!?。！？;；:："


def strip(c: Column) -> Column:
    """Without white space, any Unicode kind, at both ends."""
    return F.regexp_replace(F.regexp_replace(c, "(?U)^\\s+", ""), "(?U)\\s+$", "")


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def ascii_tokens(c: Column) -> Column:
    """Matched on the raw text and lower-cased after."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({ASCII_TOKEN})"), F.lit(1)), F.lower)


def cjk_bigrams(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"({CJK}+)"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))))
    return F.flatten(pairs)


def lexicalize(c: Column) -> Column:
    """ASCII tokens in lower case, then overlapping pairs of each CJK run; null text has none."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(ascii_tokens(c), cjk_bigrams(c))


def meaningful(tokens: Column) -> Column:
    """Tokens that are no stop words; none may be left."""
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def search_terms(c: Column) -> Column:
    """Tokens that are no stop words, or all of them where nothing else is left."""
    tokens = lexicalize(c)
    kept = meaningful(tokens)
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def or_query(c: Column) -> Column:
    """The distinct terms of a query, quoted and joined by bars."""
    return F.array_join(F.transform(F.array_distinct(lexicalize(c)), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), " | ")


def word_set(c: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "\\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the larger word set."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def token_estimate(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int")))


def next_version(c: Column) -> Column:
    """The rightmost number raised by one; null where there is none."""
    head, number, tail = (F.regexp_extract(c, "^(.*?)(\\d+)(\\D*)$", i) for i in (1, 2, 3))
    return F.when(c.rlike("\\d"), F.concat(head, (number.cast("decimal(38,0)") + 1).cast("string"), tail))


def version_parts(c: Column) -> Column:
    """Numbers between dots, 0 for what isn't one; a leading v doesn't count."""
    cleaned = F.trim(F.regexp_replace(c, "^[vV]+", ""))
    return F.transform(F.split(cleaned, "\\."), lambda p: F.coalesce(F.when(p.rlike("^\\s*[+-]?\\d+\\s*$"), F.trim(p).cast("long")), F.lit(0).cast("long")))


def is_newer(a: Column, b: Column) -> Column:
    """Whether version a comes after version b; of equal beginnings the longer one does."""
    return version_parts(a) > version_parts(b)


_DROPPED = re.compile("[\\s_\u00ad\u2212]")


def _folded(text: str | None) -> str:
    found = unicodedata.normalize("NFKC", text or "").casefold()
    return "".join(c for c in _DROPPED.sub("", found) if unicodedata.category(c) != "Pd")


def canonical_identifier(c: Column) -> Column:
    """Compatibility form with case folded, without white space, underscores, soft hyphens, minus signs and dashes. Texts of ASCII alone stay in the JVM."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(_folded)

    c = F.coalesce(c, F.lit(""))
    odd = c.rlike("[^\\x00-\\x7f]")
    return F.when(odd, folded(F.when(odd, c))).otherwise(F.regexp_replace(F.lower(c), "[\\s_\\x1c-\\x1f-]", ""))


def identifier_matches(text: Column, identifiers: Column) -> Column:
    """Whether one of the identifiers (an array in canonical form) stands in the canonical text."""
    return F.exists(F.filter(identifiers, lambda i: i != ""), lambda i: F.contains(text, i))


def normalized(c: Column) -> Column:
    """Lower case with one space for each run of white space."""
    return F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))


def ends_at_boundary(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+$", "").rlike(f"[{SENTENCE_END}]$")


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, "[。！？!?.;]"), strip)
    return F.filter(parts, lambda s: s != "")


def tf_score(query: Column, doc: Column) -> Column:
    """Occurrences of the query's tokens, each as often as the query has it, over the root of the document's length."""
    hits = F.aggregate(query, F.lit(0), lambda acc, q: acc + F.size(F.filter(doc, lambda d: d == q)))
    return F.when(F.size(doc) > 0, hits / F.sqrt(F.size(doc))).otherwise(F.lit(0.0))


def epoch(c: Column) -> Column:
    """Seconds since 1970 of a text: a number, or an ISO time with or without zone (UTC); null for anything else."""
    value = F.trim(c)
    number = value.rlike("^[+-]?[0-9]+([.][0-9]+)?$")
    return F.when(number, value.cast("double")).otherwise(F.unix_micros(F.try_to_timestamp(value)) / 1e6)


def document_marker(index: Column) -> Column:
    """Four identity terms of a generated document."""
    return F.array_join(F.transform(F.array(*map(F.lit, "ABCD")), lambda x: F.format_string("RB%06d%s", index.cast("long"), x)), " ")


def sampled(key: Column, rate: float) -> Column:
    """True for a share of the keys: the first 32 bits of their SHA-256 as a fraction are below it."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0 < rate
