"""Earlier states like the present one: k nearest neighbours by Hamming distance over flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.catalogue import HORIZONS, KNN_EXCLUDED, KNN_MIN, KNN_SIMILARITY
from barloom.functions.windows import KEYS
from barloom.operators.signals import forward


def mask_of(flags: list[str]) -> Column:
    """Up to 63 flags as bits of one number; null is 0."""
    if len(flags) > 63:
        raise ValueError("at most 63 flags fit into one number")
    bits = [F.when(F.coalesce(F.col(f), F.lit(0)) == 1, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def knn(df: DataFrame, flags: list[str], horizons: tuple[int, ...] = HORIZONS, similarity: float = KNN_SIMILARITY, least: int = KNN_MIN, excluded: int = KNN_EXCLUDED, candidates: Column | None = None) -> DataFrame:
    """For each bar: ``n_neighbors`` at least ``excluded`` + 1 bars earlier, and what followed them at each horizon.

    ``df`` needs ``pos``.  Rows of equal flags are one state.  Only pairs of distinct states are compared,
    and each bar of a state that occurs reads running sums over the timeline of each state near its
    own, so work grows with bars times near states, not with bars squared.
    """
    n = len(flags)
    most = int(n * (1 - similarity) + 1e-9)
    rows = forward(df, horizons).withColumn("_mask", mask_of(flags))
    sums = {"n": F.lit(1)}
    for h in horizons:
        r = F.col(f"ret_{h}")
        ok = r.isNotNull()
        sums |= {f"v{h}": ok.cast("int"), f"up{h}": F.coalesce((r > 0).cast("int"), F.lit(0)), f"down{h}": F.coalesce((r < 0).cast("int"), F.lit(0)), f"sum{h}": F.coalesce(r, F.lit(0.0)), f"mae{h}": F.coalesce(f"mae_{h}", F.lit(0.0)), f"mfe{h}": F.coalesce(f"mfe_{h}", F.lit(0.0))}
    timeline = rows.select(*KEYS, "_mask", "pos", *[c.alias(f"_{k}") for k, c in sums.items()])
    states = rows.select(*KEYS, "_mask").distinct()
    other = states.select(*KEYS, F.col("_mask").alias("_near"))
    # pairs of states, not of bars: neither side grows with the series once all its states have occurred
    near = states.join(other, list(KEYS)).where(F.bit_count(F.col("_mask").bitwiseXOR(F.col("_near"))) <= most)
    probes = rows if candidates is None else rows.where(candidates)
    probes = probes.select(*KEYS, "ts", "pos", "_mask").join(near, [*KEYS, "_mask"]).select(*KEYS, F.col("_near").alias("_mask"), (F.col("pos") - excluded - 1).alias("_at"), F.col("ts").alias("_probe"), F.col("pos").alias("_pos"))
    # a running sum of each state's timeline, read at each probe's position
    both = timeline.withColumnRenamed("pos", "_at").withColumn("_side", F.lit(0)).unionByName(probes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*KEYS, "_mask").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    read = both.select(*KEYS, "_probe", "_pos", "_side", *[F.sum(f"_{k}").over(w).alias(k) for k in sums]).where("_side = 1")
    total = read.groupBy(*KEYS, F.col("_probe").alias("ts"), F.col("_pos").alias("pos")).agg(*[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in sums]).where(F.col("n") >= least)
    out = [F.col("n").alias("n_neighbors")]
    for h in horizons:
        v = F.col(f"v{h}")
        # neighbours are early enough that a horizon of up to the excluded bars has always passed
        share = lambda c, scale=1: F.when(v >= least, F.round(F.col(c) / v * scale, 4))  # noqa: E731, B023
        out += [share(f"up{h}").alias(f"wr_long_{h}"), share(f"down{h}").alias(f"wr_short_{h}"), share(f"sum{h}", 100).alias(f"pnl_long_{h}"), share(f"mae{h}").alias(f"mae_mean_{h}"), share(f"mfe{h}").alias(f"mfe_mean_{h}")]
    return total.select(*KEYS, "ts", "pos", *out)
