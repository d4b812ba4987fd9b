"""As-of and range joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the chunks of time that carried rows are cut into.
CHUNK_SECONDS = 86_400 * 32


def _chunk(chunk_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col("_ts").cast("timestamp")) / chunk_seconds)


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str], name: str = "right", strict: bool = False, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``left`` with the struct ``name``: the last row of ``right`` at or before the left time (before it if ``strict``).

    Both sides are put in one frame and the last right struct is carried forward: no range comparison.
    Each key is cut into chunks of time that are carried on their own, and each chunk gets the last right
    row of earlier chunks, so one long key is not one task.  Of right rows at one time that with the
    largest payload, column by column, counts.  A matched row with null columns stays matched.
    """
    extra = [c for c in left.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in [right_ts, *[p for p in payload if p != right_ts]]])
    one = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(0 if strict else 1).alias("_side"), F.struct(*extra).alias("_l"))
    two = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_ts"), F.lit(1 if strict else 0).alias("_side"), row.alias("_r"))
    both = one.unionByName(two, allowMissingColumns=True).withColumn("_chunk", _chunk(chunk_seconds))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_ts", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    ends = two.withColumn("_chunk", _chunk(chunk_seconds)).groupBy(*keys, "_chunk").agg(F.max(F.struct("_ts", "_r")).alias("_last"))
    # a chunk without right rows carries on, too: it is looked up in the chunks that have some
    chunks = both.groupBy(*keys, "_chunk").agg(F.lit(1).alias("_any")).join(ends, [*keys, "_chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(before)["_r"].alias("_last"))
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    found = found.join(chunks, [*keys, "_chunk"], "left")
    return found.select(*keys, "_l.*", F.coalesce("_m", "_last").alias(name))


def state_matrix(spine: DataFrame, states: DataFrame, tfs: list[str], columns: list[str], chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """The spine (symbol, ts, ...) with one struct of ``columns`` for each timeframe, as of each row's time.

    ``states`` has all timeframes in one frame; they are carried side by side in one pass, so the
    whole matrix takes one shuffle of the spine.  Chunks of time are carried as in :func:`asof`.
    """
    extra = [c for c in spine.columns if c != "symbol"]
    row = F.struct("ts", *columns)
    one = spine.select("symbol", F.col("ts").alias("_ts"), F.lit(1).alias("_side"), F.struct(*extra).alias("_l")).withColumn("_chunk", _chunk(chunk_seconds))
    two = states.where(F.col("tf").isin(tfs)).select("symbol", F.col("ts").alias("_ts"), F.lit(0).alias("_side"), *[F.when(F.col("tf") == tf, row).alias(f"_s{tf}") for tf in tfs])
    two = two.withColumn("_chunk", _chunk(chunk_seconds))
    both = one.unionByName(two, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "_chunk").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = two.groupBy("symbol", "_chunk").agg(*[F.max(f"_s{tf}").alias(f"_e{tf}") for tf in tfs])
    chunks = both.groupBy("symbol", "_chunk").agg(F.lit(1).alias("_any")).join(ends, ["symbol", "_chunk"], "left")
    before = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("symbol", "_chunk", *[F.last(f"_e{tf}", ignorenulls=True).over(before).alias(f"_e{tf}") for tf in tfs])
    both = both.select("symbol", "_chunk", "_l", *[F.last(f"_s{tf}", ignorenulls=True).over(w).alias(f"_s{tf}") for tf in tfs]).where("_l is not null")
    return both.join(chunks, ["symbol", "_chunk"], "left").select("symbol", "_l.*", *[F.coalesce(f"_s{tf}", f"_e{tf}").alias(f"s_{tf}") for tf in tfs])


def in_range(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, ts: str, bucket_seconds: int, measures: dict[str, tuple[Callable, str]], ids: list[str]) -> DataFrame:
    """``measures`` over the points with start <= ts <= end, for each interval (named by ``ids``) that has any.

    ``measures``: name -> (aggregate, column), aggregates of which parts can be aggregated again (max, min, sum).
    Points are summed up by buckets of time.  An interval takes the buckets strictly inside from those
    sums and meets single points only in its first and last bucket; joins are on (key, bucket), never
    on the range alone.
    """
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
    laid = intervals.where(F.col(start) <= F.col(end)).select(*ids, F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), number(start).alias("_b0"), number(end).alias("_b1"))
    dots = points.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), number(ts).alias("_b"), *[F.col(c).alias(n) for n, (_, c) in measures.items()])
    sums = dots.groupBy("_k", "_b").agg(*[f(n).alias(n) for n, (f, _) in measures.items()])
    edges = laid.withColumn("_b", F.explode(F.array_distinct(F.array("_b0", "_b1")))).join(dots, ["_k", "_b"]).where(F.col("_t").between(F.col("_s"), F.col("_e")))
    inner = laid.where("_b1 > _b0 + 1").withColumn("_b", F.explode(F.sequence(F.col("_b0") + 1, F.col("_b1") - 1))).join(sums, ["_k", "_b"])
    both = edges.select(*ids, *measures).unionByName(inner.select(*ids, *measures))
    return both.groupBy(*ids).agg(*[f(n).alias(n) for n, (f, _) in measures.items()])
