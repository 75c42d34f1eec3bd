"""Reports of small metric tables: Markdown and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

MOST = 1000


def _rows(table: DataFrame) -> tuple[list[str], list[list[str]]]:
    """A report is for reading: a table of more than MOST rows is an error, not cut."""
    found = table.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"a report has at most {MOST} rows")
    return table.columns, [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in found]


def markdown(title: str, table: DataFrame) -> str:
    names, rows = _rows(table)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(names), line(["---"] * len(names)), *map(line, rows), ""])


def page(title: str, table: DataFrame) -> str:
    names, rows = _rows(table)
    tr = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{tr(names, 'th')}{''.join(tr(r, 'td') for r in rows)}</table>"
