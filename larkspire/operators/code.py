"""Source code: chunks by symbols, literal search with context lines, stack traces, patches."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspire.session import bounded

CHUNK_CHARS, CONTEXT = 1500, 2
# What starts a function or class in languages that aren't parsed.
STARTS = {
    "javascript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class)\s+\w+",
    "typescript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|enum)\s+\w+",
    "go": r"^func\s+(?:\([^)]*\)\s*)?\w+",
    "rust": r"^(?:pub\s+)?(?:fn|struct|enum|impl|trait)\s+\w+",
    "java": r"^\s*(?:public|private|protected)\s+[\w<>\[\], ]+\s+\w+\s*\(",
}
_NAME = re.compile(r"(?:function|class|def|func|fn|struct|enum|trait|interface|impl)\s+(?:\([^)]*\)\s*)?(\w+)|(\w+)\s*\(")


def packed(lines: list[str], size: int, first: int, label: str | None = None) -> list[tuple]:
    """(symbol, first line, last line, text) of runs of whole lines that reach size; parts of a symbol are numbered."""
    out, held, chars, begin = [], [], 0, 0
    for i, line in enumerate(lines):
        held.append(line)
        chars += len(line)
        if chars >= size or i == len(lines) - 1:
            text = "".join(held).strip()
            if text:
                out.append((begin, i, text))
            held, chars, begin = [], 0, i + 1
    several = len(out) > 1
    return [(f"{label} (part {n})" if label and several else label, first + a, first + b, t) for n, (a, b, t) in enumerate(out, 1)]


def symbols(text: str, language: str, size: int = CHUNK_CHARS) -> list[tuple]:
    """A chunk for each symbol (in Python nested ones as well), the lines before the first as <imports>; whole lines where there are none."""
    lines = text.splitlines(keepends=True)
    spans: list[tuple[str, int, int]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return packed(lines, size, 1)
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        spans = sorted((n.lineno - 1, n.end_lineno, n.name) for n in ast.walk(tree) if isinstance(n, kinds))
    elif language in STARTS:
        begins = [text.count("\n", 0, m.start()) for m in re.finditer(STARTS[language], text, re.M)]
        for a, b in zip(begins, [*begins[1:], len(lines)], strict=True):
            m = _NAME.search(lines[a])
            spans.append((a, b, (m[1] or m[2]) if m else "<anonymous>"))
    if not spans:
        return packed(lines, size, 1)
    out = []
    head = "".join(lines[: spans[0][0]]).strip()
    if head:
        out.append(("<imports>", 1, spans[0][0], head))
    for a, b, name in spans:
        body = "".join(lines[a:b]).strip()
        if len(body) > 2 * size:
            out += packed(lines[a:b], size, a + 1, name)
        elif body:
            out.append((name, a + 1, b, body))
    return out


def chunked(files: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """files (path, language, text) to path, chunk_index, symbol, line_start, line_end, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *c) for p, g, t in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) for i, c in enumerate(symbols(t or "", g, size))]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "symbol", "line_start", "line_end", "text"])

    return bounded(files.select("path", "language", "text")).mapInPandas(run, "path string, chunk_index int, symbol string, line_start int, line_end int, text string")


def lines(files: DataFrame, key: str = "path", body: str = "text") -> DataFrame:
    return files.select(key, F.posexplode(F.split(body, "\n")).alias("i", "line")).withColumn("line_number", F.col("i") + 1).drop("i")


def search(files: DataFrame, query: str, key: str = "path", body: str = "text", context: int = CONTEXT) -> DataFrame:
    """A row for each line that has the query in any case, with the lines around it."""
    split = F.split(body, "\n")
    hits = F.filter(F.transform(split, lambda x, i: F.when(F.contains(F.lower(x), F.lit(query.lower())), i)), lambda i: i.isNotNull())
    found = files.where(F.contains(F.lower(body), F.lit(query.lower()))).select(key, split.alias("s"), F.explode(hits).alias("i"))
    first, last = F.greatest(F.col("i") - context, F.lit(0)), F.least(F.col("i") + context, F.size("s") - 1)
    return found.select(key, (F.col("i") + 1).alias("line"), (first + 1).alias("line_start"), (last + 1).alias("line_end"), F.array_join(F.slice("s", first + 1, last - first + 1), "\n").alias("snippet"))


def glob(path: Column, pattern: str) -> Column:
    """Whether a path fits a pattern of * (within a folder), ** and ?."""
    out = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: ".*" if m[0].startswith("\\*\\*") else "[^/]*" if m[0] == "\\*" else "[^/]", re.escape(pattern))
    return path.rlike(f"^{out}$")


def locations(text: Column) -> Column:
    """(path, line) of the frames of a stack trace; file.ext:line where none of the four families fits."""
    # Python, JavaScript, Go, Java, and anything else.
    families = ["File [\"']([^\"']+)[\"'],\\s*line\\s+(\\d+)", "(?:at\\s+.*?\\(|at\\s+)([^\\s():]+):(\\d+):\\d+", "([^\\s]+\\.go):(\\d+)", "\\(([^)]+\\.java):(\\d+)\\)"]

    def pairs(p: str) -> Column:
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("path"), F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda x: x.cast("int")).alias("line"))

    named = F.concat(*map(pairs, families))
    return F.when(F.size(named) > 0, named).otherwise(pairs("([^\\s:]+\\.\\w+):(\\d+)"))


def explained(errors: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """error_id, path, line and the lines around each frame whose file is known. errors: error_id, text; files: path, text."""
    frames = errors.select("error_id", F.explode(locations(F.col("text"))).alias("f")).select("error_id", "f.path", "f.line")
    s = F.split("text", "\n")
    first = F.greatest(F.col("line") - around, F.lit(1))
    return frames.join(files.select("path", "text"), "path").where(F.col("line").between(1, F.size(s))).select("error_id", "path", "line", F.array_join(F.slice(s, first, F.col("line") + around - first + 1), "\n").alias("snippet"))


def reference(query: Column) -> Column:
    """path, first and last line of a reference like a.py:10-20; one line number stands for twenty more."""
    part = lambda i: F.nullif(F.regexp_extract(query, "([^\\s:]+\\.\\w+)(?::(\\d+))?(?:-(\\d+))?", i), F.lit(""))
    start = part(2).cast("int")
    return F.struct(F.coalesce(part(1), F.trim(query)).alias("path"), start.alias("line_start"), F.coalesce(part(3).cast("int"), start + 20).alias("line_end"))


def patch(path: str = "file"):
    """A pandas UDF (old, new): the unified diff."""

    @F.pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{path}", f"b/{path}")) for a, b in zip(old, new, strict=True)])

    return diff
