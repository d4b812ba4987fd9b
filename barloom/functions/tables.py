"""Sequential operators as table functions for SQL: a partitioned, ordered table goes in, rows come out.

Each function names the columns it needs; ``analyze`` tells Spark how to deal and sort the table, so a query says only
``SELECT * FROM hop_select(TABLE(candidates), 'symbol', 'start', 'stop', 1)``.  A function sees one series at a time, row
by row; for a series that is too long for one task there are the chunked operators of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from barloom.catalogue import EXHAUSTION
from barloom.operators.movements import SCHEMA, Machine


def _split(keys: str) -> list[str]:
    return [k.strip() for k in keys.split(",") if k.strip()]


class HopSelect:
    """hop_select(TABLE(t), keys, start, end, gap): of each group the first row, then each that starts at ``end + gap`` of the last chosen or later.

    ``keys``, ``start`` and ``end`` name columns, ``keys`` several separated by commas.  Rows come out whole.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, start: AnalyzeArgument, end: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        named = [*_split(keys.value), start.value, end.value]
        missing = [n for n in named if n not in table.dataType.names]
        if missing:
            raise ValueError(f"hop_select: the table has no column {', '.join(missing)}")
        return AnalyzeResult(schema=table.dataType, partitionBy=[PartitioningColumn(k) for k in _split(keys.value)], orderBy=[OrderingColumn(start.value), OrderingColumn(end.value)])

    def __init__(self) -> None:
        self.free: Any = None

    def eval(self, row: Row, keys: str, start: str, end: str, gap: int) -> Iterator[tuple]:
        if self.free is None or row[start] >= self.free:
            self.free = row[end] + gap
            yield tuple(row)


class Movements:
    """movements(TABLE(bars), exhaustion): the movements of bars with ``bos_event`` and ``choch_event``; ``exhaustion`` null for the defaults."""

    @staticmethod
    def analyze(table: AnalyzeArgument, exhaustion: AnalyzeArgument) -> AnalyzeResult:
        kinds = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "{ts}": table.dataType["ts"].dataType}
        fields = [field.strip().split(" ") for field in SCHEMA.split(",")]
        return AnalyzeResult(schema=StructType([StructField(name, kinds[kind]) for name, kind in fields]), partitionBy=[PartitioningColumn("symbol"), PartitioningColumn("tf")], orderBy=[OrderingColumn("ts")])

    def __init__(self) -> None:
        self.machine: Machine | None = None
        self.waiting: Row | None = None

    def _step(self, following: float | None) -> tuple | None:
        r = self.waiting
        return self.machine.step(r.ts, r.high, r.low, r.close, r.close if following is None else following, r.bos_event, r.choch_event)

    def eval(self, row: Row, exhaustion: float | None) -> Iterator[tuple]:
        if row.close is None:
            return
        if self.machine is None:
            self.machine = Machine(row.tf, EXHAUSTION.get(row.tf, 1.5) if exhaustion is None else float(exhaustion))
        else:
            done = self._step(row.open)
            if done:
                yield (row.symbol, row.tf, *done)
        self.waiting = row

    def terminate(self) -> Iterator[tuple]:
        if self.machine is None:
            return
        last = self.waiting
        done = self._step(None)
        if done:
            yield (last.symbol, last.tf, *done)
        done = self.machine.close(last.ts, last.close, "FIN_DATOS") if self.machine.direction else None
        if done:
            yield (last.symbol, last.tf, *done)


FUNCTIONS = {"hop_select": HopSelect, "movements": Movements}


def register_tables(spark: SparkSession) -> list[str]:
    """The table functions under their names in ``spark``."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
    return list(FUNCTIONS)
