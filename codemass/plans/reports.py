"""Bounded rows as one self-contained HTML page: everything is escaped, nothing is loaded from elsewhere."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame

ROWS = 180


def page(title: str, sections: list[tuple[str, DataFrame]], *, rows: int = ROWS) -> str:
    """A page with a table for each section: its first ``rows`` rows, and whether there are more."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in sections:
        found = df.limit(rows + 1).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in found[:rows])
        more = f"<p>Only the first {rows} rows are shown.</p>" if len(found) > rows else ""
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    style = "body{font:14px sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body>{"".join(parts)}</body></html>'


def write(path: str, title: str, sections: list[tuple[str, DataFrame]], **options) -> None:
    """Writes a page whole or not at all."""
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(page(title, sections, **options))
    os.replace(path + ".tmp", path)
