"""HTML pages to blocks, with kinds and the heading that each stands under."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspire.session import bounded

# What is dropped with all that it holds, and what makes a block of which kind.
DROPPED = frozenset("script style nav footer header".split())
KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "text", "li": "list_item", "pre": "code", "table": "table"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Blocks(HTMLParser):
    """Nested blocks are blocks of their own: a p in a li gives both, each with its whole text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.found = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in DROPPED:
            self.dropped.append(tag)
        elif not self.dropped and tag in KINDS:
            if tag in ("p", "li") or KINDS[tag] == "heading":
                self._close(tag if tag == "li" else "p")
            self.open.append((tag, len(self.found)))
            self.found.append([KINDS[tag], []])

    def _close(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_endtag(self, tag):
        if tag in self.dropped:
            while self.dropped and self.dropped.pop() != tag:
                pass
        else:
            self._close(tag)

    def handle_data(self, data):
        if not self.dropped and data.strip():
            for _, i in self.open:
                self.found[i][1].append(data.strip())


def parse(html: str | None) -> list[tuple[int, str, str, str | None]]:
    """(block_index, kind, text, section) of the blocks that have text."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    out, section = [], None
    for kind, parts in p.found:
        text = " ".join(" ".join(parts).split())
        if text:
            section = text if kind == "heading" else section
            out.append((len(out), kind, text, section))
    return out


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row a block: key, block_index, kind, text, section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *b) for k, h in zip(pdf["k"], pdf[html], strict=True) for b in parse(h)]
            yield pd.DataFrame(rows, columns=["k", "block_index", "kind", "text", "section"])

    # The key travels as text, so that a null one doesn't turn integers into floating point.
    kind = pages.schema[key].dataType.simpleString()
    found = bounded(pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias(html))).mapInPandas(run, "k string, block_index int, kind string, text string, section string")
    return found.select(F.col("k").cast(kind).alias(key), "block_index", "kind", "text", "section")
