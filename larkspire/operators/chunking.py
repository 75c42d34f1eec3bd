"""From documents to chunks: fixed windows, coalescing of parser blocks, dedup, shape statistics."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspire.functions.text import ends_at_boundary, strip
from larkspire.session import bounded

SIZE, OVERLAP = 1000, 120
#: Places of a document that are coalesced in one task.
SLICE = 4096
# Kinds of blocks that are never merged.
STANDALONE = ("table", "code", "image", "figure")
BLOCK = "block_index int, text string, kind string, page int, section string"


def windows(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """(start, text) of windows of size characters, overlap of them shared; the window that reaches the end is the last; blank ones go."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.length(c)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), strip(c.substr(i * step + 1, F.lit(size))).alias("text")))
    return F.when(n > 0, F.filter(cut, lambda w: w["text"] != "")).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def chunked(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """A row a chunk: doc_id, chunk_index, start, text, checksum, chunk_id (by content, so that a repeated run gives the same ids)."""
    rest = [c for c in docs.columns if c not in (body, "chunk_index", "start", "checksum", "chunk_id")]
    rows = docs.select(*rest, F.posexplode(windows(F.coalesce(body, F.lit("")), size, overlap)).alias("chunk_index", "__w"))
    rows = rows.select(*rest, "chunk_index", "__w.start", "__w.text").withColumn("checksum", F.sha2("text", 256))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("\x00", F.col(doc_id).cast("string"), F.col("chunk_index").cast("string"), "checksum"), 256))


def deduplicated(chunks: DataFrame, *dealt: str) -> DataFrame:
    """The first chunk of each checksum of a document; those without checksum stay. dealt: columns that follow from both and by which chunks are dealt already."""
    w = Window.partitionBy(*dealt, "doc_id", "checksum").orderBy("chunk_index")
    return chunks.withColumn("__n", F.row_number().over(w)).where("__n = 1 OR checksum IS NULL").drop("__n")


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks with the last heading before them as section."""
    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w))


def _standing_alone(kind) -> bool:
    low = kind.casefold() if isinstance(kind, str) else ""
    return low in STANDALONE or "table" in low or "code" in low


def _cut(last: tuple, b: tuple, respect_page: bool, respect_section: bool) -> bool:
    """Whether two neighbours, as (alone, page, section), never merge, whatever their sizes."""
    page = respect_page and not (last[1] == b[1] or pd.isna(last[1]) and pd.isna(b[1]))
    section = respect_section and not (pd.isna(last[2]) or pd.isna(b[2]) or last[2] == b[2])
    return last[0] or b[0] or page or section


class _Slice:
    """Neighbouring blocks of one document: where greedy groups begin, for any group that is open before them."""

    def __init__(self, r, target: int, gap: int, respect_page: bool, respect_section: bool):
        self.index, self.sizes, self.target, self.gap = r.places.tolist(), r.sizes.tolist(), target, gap
        self.ends = [(_standing_alone(k), p, c) for k, p, c in zip(r.kinds, r.pages, r.sections, strict=True)]
        self.n = len(self.index)
        self.cuts = [True] + [_cut(x, y, respect_page, respect_section) for x, y in zip(self.ends, self.ends[1:], strict=False)]
        # filled[i]: characters with their gaps before block i; forced[i]: the first cut from i on, without i.
        self.filled, self.forced, cut = [0], [self.n] * self.n, self.n
        for x in self.sizes:
            self.filled.append(self.filled[-1] + gap + x)
        for i in range(self.n - 1, -1, -1):
            self.forced[i], cut = cut, i if self.cuts[i] else cut

    def after(self, i: int, size: int, end: int) -> int:
        """The first block from i on that a group of that size doesn't take."""
        return min(end, bisect_right(self.filled, self.filled[i] + self.target - size, i) - 1) if size <= self.target else i

    def next(self, i: int) -> int:
        return max(i + 1, self.after(i + 1, self.sizes[i], self.forced[i])) if i + 1 < self.n else self.n

    def exits(self) -> list[tuple[int, int]]:
        """(first block, size) of the group that is open at the end, by the block where the first group of this slice begins."""
        out = [(0, 0)] * self.n
        for i in range(self.n - 1, -1, -1):
            j = self.next(i)
            out[i] = out[j] if j < self.n else (self.index[i], self.filled[-1] - self.filled[i] - self.gap)
        return out

    def begins(self, first: int) -> list[int]:
        out = []
        while first < self.n:
            out.append(first)
            first = self.next(first)
        return out


def coalesced(blocks: DataFrame, key: str, target_chars: int, respect_page: bool = True, respect_section: bool = True, separator: str = "\n\n", slice_blocks: int = SLICE) -> DataFrame:
    """Greedy merging of a document's neighbouring blocks up to target_chars.

    Tables, code, images and figures stand alone; a change of page or section, or a block that doesn't fit, begins a new
    one; blocks that are too long are never split. block_index is unique in a document; null texts are empty.

    A document is folded in slices of slice_blocks places, in parallel: each slice tells which group is open at its end for
    every group that may be open before it (as many entries as blocks fit into target_chars), these functions are applied
    one after another, a short row a slice, and then each slice knows its groups. Groups are put together by their first
    block; target_chars bounds them, so no task holds a whole document. blocks is read three times, twice without its texts:
    give a stored table where parsing is dear.
    """
    if target_chars < 1 or not separator or slice_blocks < 1:
        raise ValueError("target_chars, separator and slice_blocks must not be empty")
    gap = len(separator)
    data = blocks.select(key, "block_index", F.coalesce("text", F.lit("")).alias("text"), "kind", "page", "section")
    # A key travels to Python as text, since a nullable integer would be floating point there.
    data = data.withColumns({"slice": F.floor(F.col("block_index") / slice_blocks), "__key": F.col(key).cast("string")})
    light = data.select(F.col("__key").alias("key"), "slice", F.struct("block_index", F.length("text").alias("n"), "kind", "page", "section").alias("b"))
    rows = light.groupBy("key", "slice").agg(F.sort_array(F.collect_list("b")).alias("b"))
    fields = [F.col("b")[f].alias(name) for f, name in (("block_index", "places"), ("n", "sizes"), ("kind", "kinds"), ("page", "pages"), ("section", "sections"))]
    rows = bounded(rows.select("key", "slice", *fields, F.count("*").over(Window.partitionBy("key")).alias("slices")))

    def made(r) -> _Slice:
        return _Slice(r, target_chars, gap, respect_page, respect_section)

    def function(r) -> tuple:
        s = made(r)
        end = s.forced[0]
        # A group of size x that is open before takes blocks while x + takes[i] <= target_chars, the first cut ends it.
        takes = [x for x in s.filled[1 : end + 1] if x <= target_chars]
        exits = s.exits()[: len(takes) + 1]
        edge = [x for e in (s.ends[0], s.ends[-1]) for x in (e[0], None if pd.isna(e[1]) else int(e[1]), None if pd.isna(e[2]) else e[2])]
        return (r.key, r.slice, *edge, takes, [e[0] for e in exits], [e[1] for e in exits], end == s.n and len(takes) == s.n)

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "slice", "alone", "page", "section", "alone_last", "page_last", "section_last", "takes", "opens", "sizes", "through"]
        for pdf in batches:
            yield pd.DataFrame([function(r) for r in pdf.itertuples()], columns=names).astype({"page": "Int32", "page_last": "Int32"})

    def entered(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, last, opened, size = [], None, None, 0
        for r in pdf.sort_values("slice").itertuples():
            free = last is None or _cut(last, (r.alone, r.page, r.section), respect_page, respect_section)
            at = 0 if free else bisect_right(r.takes, target_chars - size)
            out.append((*k, r.slice, at, None if free else opened))
            if at == len(r.takes) and r.through and not free:
                size += int(r.takes[-1])
            else:
                opened, size = int(r.opens[at]), int(r.sizes[at])
            last = (r.alone_last, r.page_last, r.section_last)
        return pd.DataFrame(out, columns=["key", "slice", "at", "opened"]).astype({"opened": "Int32"})

    def firsts(r) -> list[int]:
        s, first, out = made(r), None if pd.isna(r.opened) else int(r.opened), []
        begins = set(s.begins(int(r.at)))
        for i, place in enumerate(s.index):
            first = place if i in begins else first
            out.append(first)
        return out

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "places": pdf["places"], "firsts": [firsts(r) for r in pdf.itertuples()]})

    tables = "alone boolean, page int, section string, alone_last boolean, page_last int, section_last string, takes array<int>, opens array<int>, sizes array<int>, through boolean"
    functions = rows.where("slices > 1").mapInPandas(transfer, f"key string, slice long, {tables}")
    entries = functions.groupBy("key").applyInPandas(entered, "key string, slice long, at int, opened int").alias("e")
    met = rows.alias("r").join(entries, F.col("r.key").eqNullSafe(F.col("e.key")) & (F.col("r.slice") == F.col("e.slice")), "left")
    begun = met.select("r.*", F.coalesce("at", F.lit(0)).alias("at"), "opened").mapInPandas(grouped, "key string, places array<int>, firsts array<int>")
    begun = begun.select("key", F.explode(F.arrays_zip("places", "firsts")).alias("z")).select("key", "z.*").alias("g")
    same = F.col("d.__key").eqNullSafe(F.col("g.key")) & (F.col("d.block_index") == F.col("g.places"))
    whole = data.alias("d").join(begun, same).select("d.*", F.col("g.firsts").alias("first"))
    groups = whole.groupBy(key, "first").agg(F.sort_array(F.collect_list(F.struct("block_index", "text", "kind", "page", "section"))).alias("b"))
    one, head = F.size("b") == 1, F.col("b")[0]
    texts = F.filter(F.transform("b", lambda x: strip(x["text"])), lambda t: t != "")
    pages = F.array_distinct(F.filter(F.transform("b", lambda x: x["page"]), lambda p: p.isNotNull()))
    named = F.array_distinct(F.filter(F.transform("b", lambda x: x["section"]), lambda t: t.isNotNull() & (t != "")))
    return groups.select(
        key, F.col("first").alias("block_index"), F.when(one, head["text"]).otherwise(F.array_join(texts, separator)).alias("text"),
        F.when(one, head["kind"]).otherwise(F.lit("coalesced_text")).alias("kind"), F.when(F.size(pages) == 1, pages[0]).alias("page"),
        F.when(one | (F.size(named) != 1), head["section"]).otherwise(named[0]).alias("section"), F.transform("b", lambda x: x["block_index"]).alias("sources"),
    )


def shape(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean, median, 95th percentile and maximum of characters, and the share that ends within a sentence."""
    n = F.length("text")
    return chunks.groupBy(*by).agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.percentile(n, 0.5), 6).alias("p50_chars"), F.round(F.percentile(n, 0.95), 6).alias("p95_chars"),
        F.max(n).alias("max_chars"), F.round(F.avg((~ends_at_boundary(F.col("text"))).cast("int")), 6).alias("non_boundary"),
    )
