"""Downsampling of ticks or bars to the timeframes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.catalogue import MINUTES, ORDER


def label(tf: str, causal: bool = True, ts: str = "ts") -> Column:
    """The bar that a time falls into.

    A bar labelled T covers (T - width, T].  Weeks run from Monday on, [Monday, next Monday), and are
    labelled by their end if ``causal``, else by their start.
    """
    if tf == "1M":
        return F.col(ts)
    if tf == "1W":
        start = F.date_trunc("week", F.col(ts))
        return start + F.expr("interval 7 days") if causal else start
    return F.window(F.col(ts) - F.expr("interval 1 microsecond"), f"{MINUTES[tf]} minutes")["end"]


def ohlcv(rows: DataFrame, tf: str, causal: bool = True) -> DataFrame:
    """Bars of one timeframe from ticks (price, volume, seq) or finer bars; null values don't count, empty bars don't occur."""
    ticks = "price" in rows.columns
    order = F.struct("ts", "seq") if "seq" in rows.columns else F.col("ts")
    source = {v: F.col("price" if ticks else v) for v in ("open", "high", "low", "close")}
    when = lambda v: F.when(source[v].isNotNull(), order)
    aggregated = rows.groupBy("symbol", label(tf, causal).alias("ts")).agg(
        F.min_by(source["open"], when("open")).alias("open"), F.max(source["high"]).alias("high"), F.min(source["low"]).alias("low"), F.max_by(source["close"], when("close")).alias("close"), F.sum("volume").alias("volume")
    )
    # date_trunc gives a zoned time also for one without a zone
    kind = rows.schema["ts"].dataType.simpleString()
    return aggregated.where("close is not null").select("symbol", F.lit(tf).alias("tf"), F.col("ts").cast(kind).alias("ts"), "open", "high", "low", "close", "volume")


def all_timeframes(rows: DataFrame, tfs: list[str] = ORDER, causal: bool = True) -> DataFrame:
    """The bars of several timeframes in one frame, told apart by ``tf``.

    Bars are rolled up from the finest timeframe whose bars they hold whole, so ``rows`` are shuffled
    once (the plan has that exchange once and reuses it).  Weeks begin at the other edge of a day than
    days do, and come from ``rows``.
    """
    made: list[str] = []
    out: list[DataFrame] = []
    for tf in sorted(tfs, key=MINUTES.__getitem__):
        finer = next((f for f in made if MINUTES[tf] % MINUTES[f] == 0), None) if tf not in ("1W", "1M") else None
        out.append(ohlcv(rows if finer is None else ohlcv(rows, finer).drop("tf"), tf, causal))
        if tf not in ("1W", "1M"):
            made.append(tf)
    return reduce(DataFrame.unionByName, out)
