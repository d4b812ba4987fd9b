"""Indicator families over bars: MACD, stochastic, moving averages, Fibonacci levels.

Flags are 0 or 1, never null: a comparison with a missing value is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.catalogue import FIB_BARS, FIB_RATIOS, MA_SPANS, MACD_SPANS, NEAR_PCT, STOCH_BARS, STOCH_HIGH, STOCH_LOW, STOCH_SMOOTH, ratio_name
from barloom.functions.windows import ewm, flag, in_blocks, rolling, series, with_position, with_runs
from barloom.stored import checkpoint

c = F.col


def previous(name: str, k: int = 1) -> Column:
    return F.lag(name, k).over(series())


def rises(name: str) -> Column:
    """The flag turns from 0 to 1; nothing before the first row counts as 0."""
    return (c(name) == 1) & (F.coalesce(previous(name), F.lit(0)) == 0)


def falls(name: str) -> Column:
    return (c(name) == 0) & (F.coalesce(previous(name), F.lit(0)) == 1)


def _positioned(df: DataFrame) -> DataFrame:
    return df if "pos" in df.columns else with_position(df)


#: Earlier rows that any bounded indicator of a row depends on: the spread of distances from a 200-bar mean reaches furthest.
REACH = 2 * max(MA_SPANS.values()) + 8


def _lines(df: DataFrame, more: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """``macd_line`` and ``macd_signal_line``; ``more`` exponential means come in the same pass."""
    fast, slow, signal = MACD_SPANS
    df = ewm(_positioned(df), {"_fast": ("close", fast), "_slow": ("close", slow), **(more or {})}).withColumn("macd_line", c("_fast") - c("_slow")).drop("_fast", "_slow")
    return ewm(df, {"macd_signal_line": ("macd_line", signal)})


def _macd_flags(df: DataFrame) -> DataFrame:
    df = df.withColumn("macd_hist", c("macd_line") - c("macd_signal_line"))
    df = df.withColumn("macd_hist_delta", c("macd_hist") - previous("macd_hist"))
    d, before = c("macd_hist_delta"), previous("macd_hist_delta")
    df = df.withColumns(
        {
            "macd_above_zero": flag(c("macd_hist") > 0),
            "macd_line_above_zero": flag(c("macd_line") > 0),
            "macd_above_sig": flag(c("macd_line") > c("macd_signal_line")),
            "macd_e1_bull": flag((d > 0) & (before <= 0)),
            "macd_e1_bear": flag((d < 0) & (before >= 0)),
            "macd_line_dist": c("macd_line") - c("macd_signal_line"),
        }
    )
    return df.withColumns({"macd_e2_bull": flag(rises("macd_above_sig")), "macd_e2_bear": flag(falls("macd_above_sig"))})


def _macd_runs() -> dict[str, Column]:
    return {"macd_hist_bars_rising": c("macd_hist_delta") > 0, "macd_hist_bars_falling": c("macd_hist_delta") < 0}


def macd(df: DataFrame) -> DataFrame:
    return with_runs(_macd_flags(_lines(df)), _macd_runs())


def _stoch_flags(df: DataFrame) -> DataFrame:
    low, high = rolling(F.min, c("low"), STOCH_BARS), rolling(F.max, c("high"), STOCH_BARS)
    df = df.withColumns({"_low": low, "_high": high})
    df = df.withColumn("_raw", 100 * (c("close") - c("_low")) / F.nullif(c("_high") - c("_low"), F.lit(0.0)))
    df = df.withColumn("stoch_K", rolling(F.avg, c("_raw"), STOCH_SMOOTH))
    df = df.withColumn("stoch_D", rolling(F.avg, c("stoch_K"), STOCH_SMOOTH))
    df = df.withColumns(
        {
            "stoch_K_delta": c("stoch_K") - previous("stoch_K"),
            "stoch_KD_dist": c("stoch_K") - c("stoch_D"),
            "stoch_KD_above": flag(c("stoch_K") > c("stoch_D")),
            "stoch_ob": flag(c("stoch_K") > STOCH_HIGH),
            "stoch_os": flag(c("stoch_K") < STOCH_LOW),
        }
    )
    recent = [c("stoch_K"), previous("stoch_K"), previous("stoch_K", 2)]
    some = lambda test: reduce(lambda a, b: a | b, [F.coalesce(test(k), F.lit(False)) for k in recent])
    up, down, middle = rises("stoch_KD_above"), falls("stoch_KD_above"), c("stoch_K").between(30, 70)
    df = df.withColumns(
        {
            "stoch_A_bull": flag(up & some(lambda k: k < STOCH_LOW)),
            "stoch_A_bear": flag(down & some(lambda k: k > STOCH_HIGH)),
            "stoch_B_bull": flag(up & middle),
            "stoch_B_bear": flag(down & middle),
        }
    )
    return df.drop("_low", "_high", "_raw")


def _stoch_runs() -> dict[str, Column]:
    return {"stoch_bars_extreme": (c("stoch_K") > STOCH_HIGH) | (c("stoch_K") < STOCH_LOW)}


def stochastic(df: DataFrame) -> DataFrame:
    return with_runs(_stoch_flags(df), _stoch_runs())


EXPONENTIAL = {n: ("close", span) for n, span in MA_SPANS.items() if n.startswith("ema")}


def _simple(df: DataFrame) -> DataFrame:
    return df.withColumns({n: rolling(F.avg, c("close"), span) for n, span in MA_SPANS.items() if n not in EXPONENTIAL})


def averages(df: DataFrame) -> DataFrame:
    """ema8, ema21, sma50, sma200 as columns, if they aren't there yet."""
    return df if "ema8" in df.columns else _simple(ewm(_positioned(df), EXPONENTIAL))


def _percent(x: Column, base: Column) -> Column:
    """How far ``x`` is from ``base`` in percent of it; null where that is zero."""
    return (x - base) / F.nullif(base, F.lit(0.0)) * 100


def _ma_flags(df: DataFrame, names: tuple[str, ...] = tuple(MA_SPANS)) -> DataFrame:
    df = df.withColumns({k: v for ma in names for k, v in {f"dist_{ma}_pct": _percent(c("close"), c(ma)), f"above_{ma}": flag(c("close") > c(ma))}.items()})
    found = {}
    for ma in names:
        dist = c(f"dist_{ma}_pct")
        spread = rolling(F.stddev_samp, dist, 200, 50)
        found |= {
            f"near_{ma}": flag(F.abs(dist) < NEAR_PCT),
            f"cross_bull_{ma}": flag(rises(f"above_{ma}")),
            f"cross_bear_{ma}": flag(falls(f"above_{ma}")),
            f"reject_bull_{ma}": flag((c("low") <= c(ma)) & (c("close") > c(ma))),
            f"reject_bear_{ma}": flag((c("high") >= c(ma)) & (c("close") < c(ma))),
            f"extreme_bull_{ma}": flag(dist > 2 * spread),
            f"extreme_bear_{ma}": flag(dist < -2 * spread),
        }
    chain = ["close", "ema8", "ema21", "sma50", "sma200"]
    ordered = lambda op: reduce(lambda a, b: a & b, [op(c(x), c(y)) for x, y in zip(chain, chain[1:])])
    return df.withColumns(found | {"align_full_bull": flag(ordered(lambda a, b: a > b)), "align_full_bear": flag(ordered(lambda a, b: a < b))})


def _ma_runs(names: tuple[str, ...]) -> dict[str, Column]:
    return {f"_{side}_{ma}": c(f"above_{ma}") == held for ma in names for side, held in (("over", 1), ("under", 0))}


def _sides(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``bars_side``: rows since the side of the average last changed."""
    return df.withColumns({f"bars_side_{ma}": c(f"_over_{ma}") + c(f"_under_{ma}") for ma in names}).drop(*_ma_runs(names))


def ma_family(df: DataFrame, names: tuple[str, ...] = tuple(MA_SPANS)) -> DataFrame:
    return _sides(with_runs(_ma_flags(averages(df), names), _ma_runs(names)), names)


def fib_levels(df: DataFrame, bars: int | None = None, mas: tuple[str, ...] = tuple(MA_SPANS)) -> DataFrame:
    """Levels of the last bars' range, as many bars as the timeframe has by default (one value: ``bars``).

    A level of zero has no distances, and nothing is near it.
    """
    df = averages(df) if mas else df
    if bars:
        low, high = rolling(F.min, c("low"), bars, 5), rolling(F.max, c("high"), bars, 5)
    else:
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
        for n in sorted(set(FIB_BARS.values())):
            here = c("tf").isin([tf for tf, k in FIB_BARS.items() if k == n])
            low, high = F.when(here, rolling(F.min, c("low"), n, 5)).otherwise(low), F.when(here, rolling(F.max, c("high"), n, 5)).otherwise(high)
    df = df.withColumns({"_lo": low, "_hi": high})
    for ratio in FIB_RATIOS:
        f = f"fib{ratio_name(ratio)}"
        level = c(f"{f}_level")
        df = df.withColumn(f"{f}_level", F.when(c("_hi") != c("_lo"), c("_lo") + (c("_hi") - c("_lo")) * ratio))
        df = df.withColumn(f"{f}_dist_pct", _percent(c("close"), level))
        df = df.withColumns(
            {
                f"{f}_in_zone": flag(F.abs(f"{f}_dist_pct") < NEAR_PCT),
                f"{f}_reject_bull": flag((c("low") <= level * (1 + NEAR_PCT / 100)) & (c("close") > level)),
                f"{f}_reject_bear": flag((c("high") >= level * (1 - NEAR_PCT / 100)) & (c("close") < level)),
                f"{f}_above": flag(c("close") > level),
            }
        )
        near = lambda ma: F.abs(c(ma) - level) / F.nullif(level, F.lit(0.0)) * 100 < NEAR_PCT  # noqa: B023, E731
        df = df.withColumns({f"{f}_conf_{ma}": flag((c(f"{f}_in_zone") == 1) & near(ma)) for ma in mas})
    return df.drop("_lo", "_hi")


def all_indicators(df: DataFrame, block: int = 1 << 14) -> DataFrame:
    """All 142 indicator columns, with ``pos``; no task holds a series.

    Exponential means are block scans, everything bounded is computed in one pass over blocks of ``block``
    rows that overlap, and all run lengths are carried over chunks together.
    """
    names = tuple(MA_SPANS)
    df = checkpoint(_lines(df, EXPONENTIAL))
    df = in_blocks(df, lambda d: fib_levels(_ma_flags(_simple(_stoch_flags(_macd_flags(d))), names)), before=REACH, block=block)
    return _sides(with_runs(df, _macd_runs() | _stoch_runs() | _ma_runs(names)), names)


def flag_columns(df: DataFrame) -> list[str]:
    """The 0/1 columns of an indicator frame; run lengths are not among them."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "int" and not f.name.startswith(("bars_", "macd_hist_bars", "stoch_bars")) and f.name != "pos"]
