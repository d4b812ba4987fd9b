"""Ordered-window building blocks over bars keyed by (symbol, tf) and ordered by ts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.stored import checkpoint

KEYS = ("symbol", "tf")
#: Width of the chunks of time that scans over a series are cut into.
CHUNK_SECONDS = 86_400 * 64


def series(keys: tuple[str, ...] = KEYS, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(agg, x: Column, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows; null until ``least`` (``n`` if not given) of them have a value."""
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (least or n), agg(x).over(frame))


def flag(condition: Column) -> Column:
    """1 or 0; a null condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def chunk(seconds: int, ts: str = "ts") -> Column:
    """Number of the stretch of time that a row is in."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def carried(df: DataFrame, values: dict[str, Column], strict: bool = False, keys: tuple[str, ...] = KEYS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Each new column has the last value that is not null of its expression, up to the row (before it if ``strict``).

    A segmented scan: rows are scanned within chunks of time, the last values of chunks are combined by a
    short window over chunks, and each chunk gets what was carried into it.  No task holds a series.
    """
    names = list(values)
    cut = checkpoint(df.withColumns({"_chunk": chunk(chunk_seconds), **{f"_v_{n}": values[n] for n in names}}))  # it is read twice
    own = Window.partitionBy(*keys, "_chunk").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    last = lambda n: F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct("ts", F.col(f"_v_{n}").alias("v"))))
    ends = cut.groupBy(*keys, "_chunk").agg(*[last(n).alias(f"_e_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_chunk", *[F.last(f"_e_{n}", ignorenulls=True).over(before)["v"].alias(f"_c_{n}") for n in names])
    scanned = cut.withColumns({f"_o_{n}": F.last(f"_v_{n}", ignorenulls=True).over(own) for n in names}).join(ends, [*keys, "_chunk"])
    return scanned.withColumns({n: F.coalesce(f"_o_{n}", f"_c_{n}") for n in names}).drop("_chunk", *[f"_{x}_{n}" for x in "voc" for n in names])


def with_runs(df: DataFrame, conditions: dict[str, Column], keys: tuple[str, ...] = KEYS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """For each name the rows since its condition became true, the row counted; 0 where it is false or null.

    A run is the distance from the last row on which the condition did not hold, which is carried over chunks.
    """
    at = "pos" if "pos" in df.columns else "_pos"
    df = df if at == "pos" else with_position(df, at, keys, chunk_seconds)
    df = carried(df, {f"_r_{n}": F.when(~F.coalesce(held, F.lit(False)), F.col(at)) for n, held in conditions.items()}, keys=keys, chunk_seconds=chunk_seconds)
    out = df.withColumns({n: (F.col(at) - F.coalesce(f"_r_{n}", F.lit(-1))).cast("int") for n in conditions})
    return out.drop("_pos", *[f"_r_{n}" for n in conditions])


def with_run(df: DataFrame, name: str, condition: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """:func:`with_runs` of one condition."""
    return with_runs(df, {name: condition}, keys)


def with_position(df: DataFrame, name: str = "pos", keys: tuple[str, ...] = KEYS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Number of each row in its series, from 0.

    Rows are numbered within chunks of time and shifted by the counts of earlier chunks, so a long
    series is not sorted in one task.
    """
    cut = df.withColumn("_chunk", chunk(chunk_seconds))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_chunk").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("ts")) - 1
    return cut.withColumn("_own", own).join(counts, [*keys, "_chunk"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_chunk")


def in_blocks(df: DataFrame, step: Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0, block: int = 1 << 16) -> DataFrame:
    """``step(df)``, where a row depends on at most ``before`` earlier and ``after`` later rows of its series.

    A series is cut into blocks of ``block`` rows, each with copies of the rows next to it that it needs, so
    no task holds a whole series.  ``df`` needs ``pos``; within ``step`` a block has a symbol of its own.
    """
    if max(before, after) > block:
        raise ValueError("a block must hold as many rows as the frame reaches")
    own, place = F.floor(F.col("pos") / block), F.col("pos") % block
    blocks = F.array_compact(F.array(own, F.when(place >= block - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    cut = df.withColumn("_blk", F.explode(blocks)).withColumn("symbol", F.struct("symbol", F.col("_blk").alias("block"))).drop("_blk")
    out = step(cut).where(F.floor(F.col("pos") / block) == F.col("symbol.block"))
    return out.withColumn("symbol", F.col("symbol.symbol"))


def ewm(df: DataFrame, columns: dict[str, tuple[str, int]], keys: tuple[str, ...] = KEYS, block: int = 256, position: str = "pos") -> DataFrame:
    """Exponential means y = (1 - a) y_before + a x, a = 2 / (span + 1), begun with the first value.

    ``columns``: new name -> (column, span).  The recursion is an affine scan: each block of rows is
    summed on its own, block ends are carried over by a short window over blocks, and both are added.
    ``df`` needs ``position``, the row's number in its series; columns must not be null.
    """
    df = df.withColumns({"_blk": F.floor(F.col(position) / block), "_p": F.col(position) % block})
    own = Window.partitionBy(*keys, "_blk").orderBy("_p")
    locals_, carries = {}, {}
    for name, (x, span) in columns.items():
        a = 2.0 / (span + 1)
        q = 1 - a
        u = F.when(F.col(position) == 0, F.col(x)).otherwise(a * F.col(x))
        locals_[f"_l_{name}"] = F.sum(u * F.pow(F.lit(q), -F.col("_p"))).over(own) * F.pow(F.lit(q), F.col("_p"))
    df = df.withColumns(locals_)
    ends = df.where(F.col("_p") == block - 1).select(*keys, "_blk", *locals_)
    w = Window.partitionBy(*keys).orderBy("_blk")
    for name, (_, span) in columns.items():
        decay = (1 - 2.0 / (span + 1)) ** block
        depth = 1
        while decay**depth > 1e-18 and depth < 400:
            depth += 1
        terms = [F.coalesce(F.lag(f"_l_{name}", k).over(w), F.lit(0.0)) * decay**k for k in range(depth)]
        carries[f"_c_{name}"] = sum(terms[1:], terms[0])
    carried = ends.select(*keys, (F.col("_blk") + 1).alias("_blk"), *[c.alias(n) for n, c in carries.items()])
    df = df.join(carried, [*keys, "_blk"], "left")
    for name, (_, span) in columns.items():
        q = 1 - 2.0 / (span + 1)
        df = df.withColumn(name, F.col(f"_l_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) * F.pow(F.lit(q), F.col("_p") + 1))
    return df.drop("_blk", "_p", *locals_, *carries)
