"""Small results for reading: text blocks and HTML pages. Rows are limited by the caller."""

from __future__ import annotations

from html import escape
from typing import Any

from pyspark.sql import DataFrame


def _cell(value: Any) -> str:
    return "" if value is None else escape(f"{value:.4f}" if isinstance(value, float) else str(value))


def html_table(df: DataFrame, title: str, rows: int = 500) -> str:
    """A table of the first ``rows`` rows, or a note if there are none."""
    found = df.limit(rows).collect()
    if not found:
        return f"<h2>{escape(title)}</h2><p>No data.</p>"
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in row) + "</tr>" for row in found)
    return f"<h2>{escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def table_rows(page: str, title: str) -> int:
    """The rows of the table under ``title`` in a page; none under a note."""
    return page.split(f"<h2>{escape(title)}</h2>")[1].split("<h2>")[0].count("<tr><td>")


def html_page(title: str, *tables: str) -> str:
    style = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{"".join(tables)}</body></html>'


def match_text(pattern: dict[str, Any]) -> str:
    """One matched pattern as a block of text."""
    name = f"{pattern['variable']}=={pattern['value']}" + (f"@{pattern['tf']}" if pattern.get("tf") else "")
    valid = pattern.get("wr_valid")
    return f"{name}  {pattern['direccion']}\n  n={pattern['n']}  win rate {pattern['winrate']:.3f}  validated {'pending' if valid is None else f'{valid:.3f}'}\n"
