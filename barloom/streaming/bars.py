"""Structured Streaming: bars from ticks, upserts, stateful movements, and matching of live state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from barloom.catalogue import EXHAUSTION, MINUTES
from barloom.operators.movements import SCHEMA, Machine
from barloom.sources.bars import upsert
from barloom.stored import checkpoint as stored


def stream_bars(ticks: DataFrame, tf: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts as a timestamp, price, volume, seq); a bar is given out once the watermark passes its end.

    As in batch a bar labelled T covers (T - width, T].  Ticks later than ``delay`` are dropped, repeated ones count once.
    """
    shifted = ticks.withColumn("_w", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("_w", delay)
    unique = shifted.dropDuplicatesWithinWatermark(["symbol", "seq"])
    order = F.struct("ts", "seq")
    grouped = unique.groupBy("symbol", F.window("_w", f"{MINUTES[tf]} minutes").alias("_win"))
    bars = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.lit(tf).alias("tf"), F.col("_win.end").alias("ts"), "open", "high", "low", "close", "volume")


def stored_bars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that :func:`upsert_stream` keeps, with its column ``part``; no rows before the first batch."""
    whole = f"{schema}, part date"
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], whole)


def upsert_stream(bars: DataFrame, path: str, checkpoint: str, schema: str, width: str = "day") -> StreamingQuery:
    """Keeps the table at ``path``, in parts of a day (or a week, or a month), up to date with a stream of bars; a batch writes the parts that it touches.

    A batch that is run again after a failure leaves the same rows, for a bar replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("part", F.to_date(F.date_trunc(width, "ts")))
        parts = [r[0] for r in new.select("part").distinct().collect()]  # a batch of live bars spans few days
        old = stored_bars(batch.sparkSession, path, schema).where(F.col("part").isin(parts))
        merged = stored(upsert(old, new.select(*old.columns)))  # read before its parts are replaced
        merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


class MovementProcessor(StatefulProcessor):
    """The movement state machine over a stream of bars with structure events, in order for each (symbol, tf).

    A bar's successor gives the opening price, so each bar is worked on when the next one comes.
    """

    def __init__(self, thresholds: dict[str, float] | None = None):
        self.thresholds = thresholds or EXHAUSTION

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState(
            "machine",
            "opened int, direction string, start timestamp, price double, extreme double, bars int, waiting boolean, ts timestamp, high double, low double, close double, bos string, choch string",
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        symbol, tf = key
        found = pd.concat(list(rows)).sort_values("ts")
        machine, waiting = Machine(tf, self.thresholds.get(tf, 1.5)), None
        if self.machine.exists():
            opened, direction, start, price, extreme, bars, is_waiting, *bar = self.machine.get()
            machine = Machine(tf, machine.threshold, opened, direction, start, price or 0.0, extreme or 0.0, bars)
            waiting = tuple(bar) if is_waiting else None
        out = []
        for row in found.itertuples(index=False):
            if waiting and row.ts <= waiting[0]:
                continue  # a bar that has been seen
            if waiting:
                done = machine.step(waiting[0], waiting[1], waiting[2], waiting[3], row.open, waiting[4], waiting[5])
                if done:
                    out.append((symbol, tf, *done))
            waiting = (row.ts.to_pydatetime(), row.high, row.low, row.close, row.bos_event, row.choch_event)
        if waiting:
            self.machine.update((machine.opened, machine.direction, machine.start, machine.price, machine.extreme, machine.bars, True, *waiting))
        names = [f.strip().split(" ")[0] for f in SCHEMA.format(ts="timestamp").split(",")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def stream_movements(bars: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Finished movements of a stream of bars (with open and structure events)."""
    processor = MovementProcessor(thresholds)
    return bars.groupBy("symbol", "tf").transformWithStateInPandas(processor, SCHEMA.format(ts="timestamp"), "Append", "None")
