"""Swings, market structure and break events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.catalogue import SWING_BARS
from barloom.functions.windows import KEYS, carried, in_blocks, series, with_position
from barloom.operators.hop import hop_select


def _by_tf(values: dict[str, int], make) -> Column:
    return reduce(lambda a, tf: F.when(F.col("tf") == tf, make(values[tf])).otherwise(a), values, F.lit(None))


def swing_candidates(bars: DataFrame, sizes: dict[str, int] = SWING_BARS, block: int = 1 << 16) -> DataFrame:
    """Bars with ``pos``, ``n``, ``is_high`` and ``is_low``: no later of the next n - 1 bars is higher (lower), and n bars follow.

    Worked on in blocks of ``block`` rows with copies of the rows after them.
    """
    w = series()
    df = (bars if "pos" in bars.columns else with_position(bars)).withColumn("n", _by_tf(sizes, F.lit))
    ahead = lambda agg, x: _by_tf(sizes, lambda n: agg(x).over(w.rowsBetween(0, n - 1)))
    room = _by_tf(sizes, lambda n: F.lead("pos", n).over(w).isNotNull())
    known = _by_tf(sizes, lambda n: F.lead("ts", n - 1).over(w))
    step = lambda d: d.withColumns({"is_high": room & (F.col("high") == ahead(F.max, "high")), "is_low": room & (F.col("low") == ahead(F.min, "low")), "_known": known})
    return in_blocks(df, step, after=max(sizes.values()), block=block)


def swings(bars: DataFrame, sizes: dict[str, int] = SWING_BARS) -> DataFrame:
    """Bars with ``swing_type`` (NONE, SH, SL), ``swing_price`` and ``confirmed_ts``, the bar at which a swing is known.

    Of candidates of one kind closer than n bars the first stays.  A bar that is both is a low, but also
    counts for the spacing of highs.
    """
    df = swing_candidates(bars, sizes)
    chosen = []
    for kind, side in (("SH", "is_high"), ("SL", "is_low")):
        near = df.where(side).select(*KEYS, "pos", (F.col("pos") + F.col("n")).alias("_to"), F.lit(kind).alias("_kind"))
        chosen.append(near)
    picked = hop_select(chosen[0].unionByName(chosen[1]), [*KEYS, "_kind"], "pos", "_to")
    picked = picked.groupBy(*KEYS, "pos").agg(F.max("_kind").alias("_kind"))  # SL is the larger name
    df = df.join(picked, [*KEYS, "pos"], "left")
    price = F.when(F.col("_kind") == "SH", F.col("high")).when(F.col("_kind") == "SL", F.col("low"))
    known = F.when(F.col("_kind").isNotNull(), F.col("_known"))
    return df.withColumns({"swing_type": F.coalesce("_kind", F.lit("NONE")), "swing_price": price, "confirmed_ts": known}).drop("_kind", "_known", "is_high", "is_low", "n")


def structure(bars: DataFrame, sizes: dict[str, int] = SWING_BARS) -> DataFrame:
    """:func:`swings` with ``estructura``, ``bos_event`` and ``choch_event``.

    The last two swings of each kind are carried over chunks of time.
    """
    df = bars if "swing_type" in bars.columns else swings(bars, sizes)
    df = df.withColumns({f"_{kind}": F.when(F.col("swing_type") == kind, F.col("swing_price")) for kind in ("SH", "SL")})
    df = carried(df, {f"_b{kind}": F.col(f"_{kind}") for kind in ("SH", "SL")}, strict=True)
    pair = lambda kind: F.when(F.col(f"_{kind}").isNotNull(), F.struct(F.col(f"_{kind}").alias("last"), F.col(f"_b{kind}").alias("prev")))
    df = carried(df, {f"_p{kind}": pair(kind) for kind in ("SH", "SL")})
    sh, psh, sl, psl = F.col("_pSH.last"), F.col("_pSH.prev"), F.col("_pSL.last"), F.col("_pSL.prev")
    kind = F.when((sh > psh) & (sl > psl), "ALCISTA").when((sh < psh) & (sl < psl), "BAJISTA").otherwise("RANGO")
    df = df.withColumn("estructura", kind)
    up, down, close = F.col("estructura") == "ALCISTA", F.col("estructura") == "BAJISTA", F.col("close")
    return df.withColumns(
        {
            "bos_event": F.when(up & (close > psh), "BOS_BULL").when(down & (close < psl), "BOS_BEAR").otherwise("NONE"),
            "choch_event": F.when(up & (close < sl), "CHOCH_BAJISTA").when(down & (close > sh), "CHOCH_ALCISTA").otherwise("NONE"),
        }
    ).drop("_SH", "_SL", "_bSH", "_bSL", "_pSH", "_pSL")


def structure_summary(df: DataFrame) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v)
    other = lambda c: F.count_if(F.col(c) != "NONE")
    return df.groupBy("symbol", "tf").agg(
        count("swing_type", "SH").alias("n_sh"), count("swing_type", "SL").alias("n_sl"), other("bos_event").alias("n_bos"), other("choch_event").alias("n_choch")
    )
