"""A Spark data source for paged answers of a bar service (``format("bar_pages")``), in batch and as a stream.

The service is any callable ``fetch(url) -> str`` named as ``module:function`` in the option ``fetch``,
so the source holds no address and no credentials.  What is asked for is cut into ranges of time, a partition for each
symbol and range; each follows ``next_url`` until it ends, retrying with doubling pauses and pausing between
pages.  A stream's offset is the time up to which bars have been fetched, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barloom.sources.bars import BAR_SCHEMA


def milliseconds(at: datetime) -> int:
    """Since 1970, of a UTC time with or without its zone."""
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def ranges_option(ranges: list[tuple[datetime, datetime]]) -> str:
    """The option ``ranges`` from what :func:`barloom.sources.bars.missing_ranges` plans."""
    return json.dumps([[milliseconds(a), milliseconds(b)] for a, b in ranges])


class BarPages(DataSource):
    """Options: ``fetch``, ``symbols`` (comma-separated), ``url`` (with {symbol}, {start} and {stop} in milliseconds), ``ranges`` (a JSON list of
    [start, stop], or ``start`` and ``stop`` for one; bars at a start count, at a stop not; without either the service gives all it has),
    ``width`` (milliseconds of a partition, a day), ``tries`` (4), ``pause`` (0.25 s).

    A stream needs ``start``; it fetches up to ``stop``, or to the present time, in whole widths.
    """

    @classmethod
    def name(cls) -> str:
        return "bar_pages"

    def schema(self) -> str:
        return BAR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, symbol: str, start: int | None = None, stop: int | None = None):
        self.symbol, self.start, self.stop = symbol, start, stop


class _Pages:
    """What batch and stream share."""

    def __init__(self, options: dict):
        self.options, self.width = options, int(options.get("width", 86_400_000))
        self.symbols = [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]

    def cut(self, ranges: list[tuple[int, int]]) -> list[InputPartition]:
        pieces = [(at, min(at + self.width, stop)) for start, stop in ranges for at in range(start, stop, self.width)]
        return [_Range(s, *piece) for s in self.symbols for piece in pieces]

    def read(self, partition: _Range) -> Iterator[tuple]:
        module, function = self.options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), function)
        tries, pause = int(self.options.get("tries", 4)), float(self.options.get("pause", 0.25))
        start, stop = partition.start, partition.stop
        url = self.options["url"].format(symbol=partition.symbol, start=start, stop=stop)
        while url:
            for k in range(tries):
                try:
                    page = json.loads(fetch(url))
                    break
                except Exception:
                    if k + 1 == tries:
                        raise
                    time.sleep(pause * 2**k)
            for r in page.get("results") or []:
                if start is None or start <= r["t"] < stop:  # services differ in whether they count the ends
                    yield (partition.symbol, datetime.fromtimestamp(r["t"] / 1000, UTC), *(float(r[k]) for k in "ohlcv"))
            url = page.get("next_url")
            if url:
                time.sleep(pause)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        if "ranges" in self.options:
            return self.cut([tuple(r) for r in json.loads(self.options["ranges"])])
        if "start" in self.options:
            return self.cut([(int(self.options["start"]), int(self.options["stop"]))])
        return [_Range(s) for s in self.symbols]


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"t": int(self.options["start"])}

    def latestOffset(self) -> dict:
        if "stop" in self.options:
            return {"t": int(self.options["stop"])}
        start = int(self.options["start"])
        return {"t": start + (milliseconds(datetime.now(UTC)) - start) // self.width * self.width}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.cut([(start["t"], end["t"])])

    def commit(self, end: dict) -> None:
        """Nothing to give back: a service keeps its bars."""
