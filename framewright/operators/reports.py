"""Small results as text."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: Rows of a report; larger results are to be written as tables.
MAX_ROWS = 1000


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """The first rows as a Markdown table; null as n/a."""
    rows = df.limit(min(limit, MAX_ROWS)).collect()
    cell = lambda v: "n/a" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def html_table(df: DataFrame, limit: int = 50) -> str:
    """The first rows as an HTML table; null as n/a."""
    rows = df.limit(min(limit, MAX_ROWS)).collect()
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape('n/a' if v is None else str(v))}</{tag}>" for v in cells) + "</tr>"
    return "\n".join(["<table>", row(df.columns, "th"), *(row(r, "td") for r in rows), "</table>"])
