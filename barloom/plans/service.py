"""Bar services for the paged source: one over the events table, and one that is made up by rule for tests."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pyarrow.dataset as ds

#: Bars of a page of the events service.
PAGE = 400


def events_page(url: str) -> str:
    """The answer for ``path of the table?symbol&start&stop&page``: each event of the range as a bar of one price."""
    path, _, query = url.partition("?")
    symbol, start, stop, page = query.split("&")
    start_at, stop_at = (datetime.fromtimestamp(int(ms) / 1000, UTC).replace(tzinfo=None) for ms in (start, stop))
    wanted = (ds.field("event_type") == symbol) & (ds.field("ts") >= start_at) & (ds.field("ts") < stop_at)
    rows = ds.dataset(path).to_table(["ts", "value", "event_id"], wanted).sort_by([("ts", "ascending"), ("event_id", "ascending")])
    here = rows.slice(int(page) * PAGE, PAGE)
    bars = [{"t": (t - datetime(1970, 1, 1)) // timedelta(milliseconds=1), **dict.fromkeys("ohlc", v), "v": 1} for t, v in zip(here["ts"].to_pylist(), here["value"].to_pylist())]
    more = (int(page) + 1) * PAGE < rows.num_rows
    return json.dumps({"results": bars, "next_url": f"{path}?{symbol}&{start}&{stop}&{int(page) + 1}" if more else None})


PAGES, BARS, START_MS = 3, 40, 1_704_067_200_000


def fetch(url: str) -> str:
    """The answer for ``symbol?page=k``."""
    symbol, _, page = url.partition("?page=")
    k = int(page or 0)
    numbers = range(k * BARS, (k + 1) * BARS)
    rows = [{"t": START_MS + 60_000 * i, "o": len(symbol) + i, "h": len(symbol) + i + 2, "l": len(symbol) + i - 1, "c": len(symbol) + i + 0.5, "v": 10 * i} for i in numbers]
    return json.dumps({"results": rows, "next_url": f"{symbol}?page={k + 1}" if k + 1 < PAGES else None})
