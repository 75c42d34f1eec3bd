"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Kinds: the base kinds email, ip, card and phone, which are reported wherever pattern and validator agree, and iban
(mod-97) and ssn (only where context words raise the score), which the method adds. Each span is found in linear time:
no pattern can restart inside a run of digits or letters, so very long texts and runs cost no more than their length.

Nulls and empty texts have no spans. Repeated rows are scored row by row. An empty table gives an empty table. Extra
columns are kept as they are; columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspire.llm.common import bounded_batches, ints, key, keyed, mapped

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Words near a span that speak for a kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
# A span's score before its context is read, what a context word adds, and from where a span counts.
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_BONUS, THRESHOLD, CONTEXT_CHARS = 0.3, 0.5, 48

# The length of an IBAN by its country.
IBAN_CHARS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_CHAR = re.compile(r"\x20?[A-Z0-9]")
_WORD_CHAR = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A known country's IBAN ends at its length, another at the last end of a word where the check holds; each start looks ahead by 34 characters at most."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        ends, n, at = [], 4, m.end()
        want = IBAN_CHARS.get(m.group()[:2])
        while n < (want or 34) and (c := _IBAN_CHAR.match(text, at)):
            n, at = n + 1, c.end()
            if (n == want or not want and n >= 15) and not _WORD_CHAR.match(text, at):
                ends.append(at)
        for end in reversed(ends):
            if mod97(text[m.start() : end]):
                yield m.start(), end
                done = end
                break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, each @ looking back at most to the end of the match before it."""
    at, end, seen = text.find("@"), 0, 0
    while at >= 0:
        start = at
        floor = max(end, seen)
        while start > floor and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        seen = at + 1
        at = text.find("@", max(seen, end))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", near))
    return min(1.0, START_SCORE[kind] + CONTEXT_BONUS * any(w in words for w in CONTEXT[kind]))


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind; base spans stay whatever their score is."""
    if not text:
        return []
    found = [(k, a, b, _score(k, text, a, b)) for k, a, b in base_spans(text)]
    if _DIGIT.search(text):
        more = [("iban", a, b) for a, b in _ibans(text)]
        more += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        found += [(k, a, b, s) for k, a, b in more if (s := _score(k, text, a, b)) >= THRESHOLD]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None) -> str | None:
    """The text with each span (the union of those that overlap) replaced by its kind in angle brackets."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def detect(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the column out: the spans of the text as an array of (kind, start, end, score)."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf(SPAN)
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"kind": k, "start": a, "end": b, "score": p} for k, a, b, p in spans(x)])

    return df.withColumn(out, found(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of the text replaced; null stays null."""

    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def clean(s: pd.Series) -> pd.Series:
        return s.map(redacted, na_action="ignore")

    return df.withColumn(text, clean(F.col(text)))


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, the digest of the base spans, all spans and their scores."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = spans(text if isinstance(text, str) else None)
                base = [x[:3] for x in found if x[0] in BASE_KINDS]
                kinds = [x[0] for x in base]
                rows.append((keyed(doc_id), *(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined([x[:3] for x in found]), [x[3] for x in found]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])
            yield out.assign(doc_id=ints(r[0] for r in rows))

    return mapped(docs.select(key(F.col("doc_id")).alias("doc_id"), "text"), run, schema)
