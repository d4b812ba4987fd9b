"""What became of movements: excursions, retracements, continuation, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.catalogue import FIB_RATIOS
from barloom.operators.asof import asof, in_range
from barloom.operators.movements import aligned, continuation

ID = ["symbol", "tf", "mov_id"]


def nearest_level(x: Column, ratios: tuple[float, ...] = FIB_RATIOS) -> Column:
    """The ratio nearest to ``x`` cut to [0, 1]; of two equally near ones the lower; null for null."""
    cut = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    near = F.array_min(F.array(*[F.struct(F.abs(cut - r).alias("d"), F.lit(r).alias("r")) for r in ratios]))
    return F.when(x.isNotNull(), near["r"])


def excursions(moves: DataFrame, bars: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """``mfe_pct``, ``mae_pct`` and ``fib_agotamiento`` from the highest and lowest price during each movement; one range join for all three."""
    range_of = in_range(moves, bars.select("symbol", "ts", "high", "low"), "symbol", "timestamp_inicio", "timestamp_fin", "ts", bucket_seconds, {"_hi": (F.max, "high"), "_lo": (F.min, "low")}, ID)
    found = moves.join(range_of, ID, "left")
    long, start, extreme = F.col("direccion") == "LONG", F.nullif(F.col("precio_inicio"), F.lit(0.0)), F.col("precio_extremo")
    up, down = (F.col("_hi") - start) / start * 100, (start - F.col("_lo")) / start * 100
    floor = lambda x: F.when(x.isNotNull(), F.bround(F.greatest(x, F.lit(0.0)), 4))
    span = F.nullif(F.abs(extreme - F.col("precio_inicio")), F.lit(0.0))
    back = F.when(long, extreme - F.col("_lo")).otherwise(F.col("_hi") - extreme) / span
    return found.withColumns({"mfe_pct": floor(F.when(long, up).otherwise(down)), "mae_pct": floor(F.when(long, down).otherwise(up)), "fib_agotamiento": nearest_level(back)}).drop("_hi", "_lo")


def rebound(moves: DataFrame) -> DataFrame:
    """``rebote_fib``: where the end price lies in the range of the last movement of the timeframe that ended at or before the start."""
    previous = moves.select("symbol", "tf", F.col("mov_id").alias("_pid"), F.col("timestamp_inicio").alias("_ps"), F.col("timestamp_fin").alias("_pe"), F.col("precio_inicio").alias("_pi"), F.col("precio_extremo").alias("_px"))
    previous = previous.where("_ps < _pe")  # a movement never is its own previous one
    found = asof(moves, previous, ["symbol", "tf"], "timestamp_inicio", "_pe", ["_pid", "_pi", "_px"], "_prev")
    low, high = F.least("_prev._pi", "_prev._px"), F.greatest("_prev._pi", "_prev._px")
    return found.withColumn("rebote_fib", nearest_level((F.col("precio_fin") - low) / F.nullif(high - low, F.lit(0.0)))).drop("_prev")


def outcomes(moves: DataFrame, bars: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """One row for each finished movement (with ``tf_parent_id``), with all measures and ``ratio_mfe_mae``."""
    done = moves.where("timestamp_fin is not null")
    done = aligned(continuation(rebound(excursions(done, bars, bucket_seconds))))
    return done.withColumn("ratio_mfe_mae", F.when(F.col("mae_pct") > 0, F.col("mfe_pct") / F.col("mae_pct")))


def by_timeframe(rows: DataFrame, digits: int = 4) -> DataFrame:
    return rows.groupBy("tf", "direccion").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("magnitud_pct"), digits).alias("magnitud_media"), F.round(F.avg("mfe_pct"), digits).alias("mfe_media"), F.round(F.avg("mae_pct"), digits).alias("mae_media")
    )


def mismatches(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcomes whose ``fib_agotamiento`` differs from one computed afresh; none if all is well."""
    again = excursions(rows.drop("mfe_pct", "mae_pct", "fib_agotamiento"), bars).select(*ID, F.col("fib_agotamiento").alias("_again"))
    return rows.join(again, ID).where(~F.col("fib_agotamiento").eqNullSafe(F.col("_again"))).drop("_again")
