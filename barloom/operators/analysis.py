"""Histogram-driven moves, states at their ends, and statistics of state signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import KEYS
from barloom.operators.hop import hop_select


def histogram_moves(df: DataFrame, hist: str = "macd_hist", long_exit: Column | None = None, short_exit: Column | None = None, least_bars: int = 30, least_pct: float = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Moves from where ``hist`` crosses 0 to the first bar, ``least_bars`` later at the earliest, where it is back or an exit holds.

    ``df`` needs ``pos`` and ``close``.  The end of every possible start comes from one window in descending
    order, then starts are chosen so that the next is after the end; moves that turn out too small
    still take their bars.  A null histogram counts as 0.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    back = Window.partitionBy(*keys).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -least_bars)
    h = F.coalesce(F.col(hist), F.lit(0.0))
    df = df.withColumns({"_h": h, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    before = F.lag("_h").over(w)
    out = {"LONG": F.col("_h") <= 0, "SHORT": F.col("_h") >= 0}
    for side, extra in (("LONG", long_exit), ("SHORT", short_exit)):
        out[side] = out[side] | F.coalesce(extra, F.lit(False)) if extra is not None else out[side]
    first = {side: F.coalesce(F.min(F.when(c, F.col("pos"))).over(back), F.col("_n") - 1) for side, c in out.items()}
    direction = F.when((before <= 0) & (F.col("_h") > 0), "LONG").when((before >= 0) & (F.col("_h") < 0), "SHORT")
    df = df.withColumns({"direction": direction, "_el": first["LONG"], "_es": first["SHORT"]})
    starts = df.where(F.col("direction").isNotNull() & (F.col("pos") < F.col("_n") - least_bars) & (F.col("close") > 0))
    starts = starts.select(*keys, "direction", F.col("pos").alias("bar_start"), F.when(F.col("direction") == "LONG", F.col("_el")).otherwise(F.col("_es")).alias("bar_end"), F.col("ts").alias("ts_start"), F.col("close").alias("price_start"))
    chosen = hop_select(starts, list(keys), "bar_start", "bar_end", 1)
    ends = df.select(*keys, F.col("pos").alias("bar_end"), F.col("ts").alias("ts_end"), F.col("close").alias("price_end"))
    moves = chosen.join(ends, [*keys, "bar_end"]).withColumn("pct_move", (F.col("price_end") - F.col("price_start")) / F.col("price_start") * 100)
    moves = moves.where((F.abs("pct_move") >= least_pct) & (F.col("bar_end") - F.col("bar_start") >= least_bars))
    # the best price on the way: bars meet moves by buckets of positions
    laid = moves.select(*keys, "bar_start", "bar_end", F.explode(F.sequence(F.floor(F.col("bar_start") / 256), F.floor(F.col("bar_end") / 256))).alias("_b"))
    path = df.select(*keys, "pos", "close", F.floor(F.col("pos") / 256).alias("_b"))
    best = laid.join(path, [*keys, "_b"]).where(F.col("pos").between(F.col("bar_start"), F.col("bar_end"))).groupBy(*keys, "bar_start").agg(F.max("close").alias("_hi"), F.min("close").alias("_lo"))
    moves = moves.join(best, [*keys, "bar_start"])
    mfe = F.when(F.col("direction") == "LONG", F.col("_hi") - F.col("price_start")).otherwise(F.col("price_start") - F.col("_lo")) / F.col("price_start") * 100
    bars = F.col("bar_end") - F.col("bar_start")
    return moves.select(
        *keys, "direction", "bar_start", "bar_end", "ts_start", "ts_end", F.round("price_start", 4).alias("price_start"), F.round("price_end", 4).alias("price_end"),
        F.round("pct_move", 3).alias("pct_move"), F.round(mfe, 3).alias("mfe_pct"), bars.alias("duration_bars"), F.round(bars / 60, 1).alias("duration_hrs"),
    )


def state_at(moves: DataFrame, df: DataFrame, columns: list[str], position: str = "bar_start", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The moves with ``columns`` of the bar at ``position``: an equality join."""
    return moves.join(df.select(*keys, F.col("pos").alias(position), *columns), [*keys, position], "left")


def distance_bucket(x: Column) -> Column:
    return F.when(x < -3, "FAR_BELOW").when(x < -0.5, "NEAR_BELOW").when(x < 0.5, "AT").when(x < 3, "NEAR_ABOVE").when(x.isNotNull(), "FAR_ABOVE")


def pattern_key(df: DataFrame, columns: list[str]) -> Column:
    """``name=value`` of each column that says something: whole numbers but 0, distances by bucket; NO_SIGNAL if none does."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = []
    for name in columns:
        x = F.col(name)
        if kinds[name] == "boolean":
            parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{name}="), x.cast("int").cast("string"))))
        elif kinds[name] in ("int", "bigint"):
            parts.append(F.when(x != 0, F.concat(F.lit(f"{name}="), x.cast("string"))))
        elif "dist_" in name:
            parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{name}="), distance_bucket(x))))
    return F.coalesce(F.nullif(F.concat_ws("|", *parts), F.lit("")), F.lit("NO_SIGNAL"))


def pattern_stats(rows: DataFrame, key: str = "pattern_key", least: int = 3) -> DataFrame:
    """Size, dominant direction, medians and means of each signature with ``least`` moves; keys cut to 150 characters."""
    longs, n = F.count_if(F.col("direction") == "LONG"), F.count(F.lit(1))
    size = F.abs("pct_move")
    found = rows.groupBy(key).agg(n.alias("n"), longs.alias("_l"), F.median(size).alias("_med"), F.avg(size).alias("_mean"), F.median("mfe_pct").alias("_mfe"), F.median("duration_hrs").alias("_dur")).where(F.col("n") >= least)
    shorts = F.col("n") - F.col("_l")
    return found.select(
        F.substring(key, 1, 150).alias("pattern"), "n", F.when(F.col("_l") >= shorts, "LONG").otherwise("SHORT").alias("dominant_dir"), F.round(F.greatest("_l", shorts) / F.col("n") * 100, 1).alias("pct_aligned"),
        F.round("_med", 3).alias("pct_move_med"), F.round("_mean", 3).alias("pct_move_mean"), F.round("_mfe", 3).alias("mfe_med"), F.round("_dur", 1).alias("dur_hrs_med"),
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Each value with its count and share of the rows that have one."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))  # one row


def direction_balance(rows: DataFrame) -> DataFrame:
    longs, shorts = F.count_if(F.col("direccion") == "LONG"), F.count_if(F.col("direccion") == "SHORT")
    counts = rows.groupBy("tf").agg(longs.alias("n_long"), shorts.alias("n_short"))
    return counts.withColumn("ratio", F.round(F.col("n_long") / F.coalesce(F.nullif(F.col("n_short"), F.lit(0)), F.lit(1)), 4))
