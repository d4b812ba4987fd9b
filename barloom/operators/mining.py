"""One-variable patterns: mining with least support, temporal hold-out, robustness over windows, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.catalogue import HOLDOUT_GAP, HOLDOUT_QUANTILE, HOLDOUT_WR, MAX_WR_STD, MIN_COUNT, MIN_COUNT_GLOBAL, MIN_EDGE_SHARE, OVERLAP, WINDOWS, WR_EDGE

PATTERN = ["variable", "value", "tf", "direccion"]
#: Means over training rows only.
TRAIN = {"mag_media_train": "magnitud_pct", "dur_media_train": "duracion_min", "mfe_media_train": "mfe_pct", "mae_media_train": "mae_pct"}


def classify(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(flags, categories) by data: numbers that are only 0, 1 or null are flags, strings are categories; one pass."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numbers = [c for c in columns if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    if numbers:
        row = df.agg(*[F.bool_and(F.col(c).isin(0, 1) | F.col(c).isNull()).alias(c) for c in numbers]).first()
        numbers = [c for c in numbers if row[c] is not False]
    return numbers, [c for c in columns if kinds[c] == "string"]


def long_form(rows: DataFrame, flags: list[str], categories: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """(variable, value) of each flag that is set and each category that says something, beside ``keep``."""
    active = [F.when(F.col(c) == 1, F.struct(F.lit(c).alias("variable"), F.lit("1").alias("value"))) for c in flags]
    active += [F.when(F.col(c).isNotNull() & ~F.col(c).isin("NONE", "ULTIMO"), F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"))) for c in categories]
    return rows.select(*keep, F.explode(F.array_compact(F.array(*active))).alias("_v")).select(*keep, "_v.variable", "_v.value")


def _wins(where: Column | None = None) -> Column:
    win = (F.col("continuacion") == "CONTINUACION").cast("double")
    return F.avg(win if where is None else F.when(where, win))


def least_count() -> Column:
    out = F.lit(MIN_COUNT_GLOBAL)
    for tf, n in MIN_COUNT.items():
        out = F.when(F.col("tf") == tf, n).otherwise(out)
    return out


def nth_values(rows: DataFrame, column: str, ranks: list[int], bins: int = 1 << 15) -> list[int]:
    """The values at some places (from 0) of the sorted whole numbers in ``column``, which has no nulls.

    Selection by histograms: each pass counts the values in equal parts of the range that holds a place and goes on
    in one part, so the driver sees at most ``bins`` counts for each place, and no task more than its own rows.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    spans = {k: (low, high, k) for k in ranks}  # place -> range and its place in there
    while any(a < z for a, z, _ in spans.values()):
        for a, z in sorted({(a, z) for a, z, _ in spans.values() if a < z}):
            width = (z - a) // bins + 1
            part = F.expr(f"({column} - ({a}L)) div {width}L")
            counts = rows.where(F.col(column).between(a, z)).groupBy(part.alias("part")).count().orderBy("part").collect()
            for k in [k for k, span in spans.items() if span[:2] == (a, z)]:
                left = spans[k][2]
                for number, count in counts:
                    if left < count:
                        break
                    left -= count
                spans[k] = (a + number * width, min(z, a + (number + 1) * width - 1), left)
    return [spans[k][0] for k in ranks]


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The interpolated quantile of the whole numbers in ``column``; None without any."""
    values = rows.where(F.col(column).isNotNull()).select(column)
    n = values.count()
    if not n:
        return None
    place = q * (n - 1)
    lower, upper = int(place), -int(-place // 1)
    a, b = nth_values(values, column, [lower, upper])
    return float(a) if lower == upper or a == b else (upper - place) * a + (place - lower) * b


def cutoff(rows: DataFrame, ts: str = "timestamp_inicio", q: float = HOLDOUT_QUANTILE) -> float | None:
    """The interpolated quantile of a time, in microseconds."""
    return quantile(rows.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("us")), "us", q)


def mine(rows: DataFrame, flags: list[str], categories: list[str] = (), minimum: Column | None = None, holdout: bool = True) -> DataFrame:
    """Patterns over all timeframes (tf null) and each one, from outcomes with their state at the start.

    All patterns are counted in one pass over grouping sets.  With ``holdout`` rows up to the 75 %
    quantile of start times train and later ones validate: patterns with too few training rows go,
    those with too few later ones are PENDIENTE_VALIDACION, those whose win rate is below 0.55 or
    more than 0.10 below that of training go.  Beside the means over all rows there are those of the training rows
    alone (``n_train`` and the names that end in _train), which know nothing of what validates.
    """
    keep = ["tf", "direccion", "timestamp_inicio", "continuacion", "magnitud_pct", "duracion_min", "mfe_pct", "mae_pct", "rebote_fib", "fib_agotamiento"]
    judged = rows.where("continuacion != 'ULTIMO'")
    cut = cutoff(judged) if holdout else None
    early = F.unix_micros(F.col("timestamp_inicio").cast("timestamp")) <= F.lit(cut)
    facts = long_form(judged, flags, categories, keep).withColumn("_early", early)
    measures = [
        F.count(F.lit(1)).alias("n"), _wins().alias("winrate"), F.avg("magnitud_pct").alias("mag_media"), F.stddev_samp("magnitud_pct").alias("mag_std"), F.avg("duracion_min").alias("dur_media"),
        F.avg("mfe_pct").alias("mfe_media"), F.avg("mae_pct").alias("mae_media"), F.mode("rebote_fib", True).alias("rebote_fib_frecuente"), F.mode("fib_agotamiento", True).alias("fib_agot_frecuente"),
        F.count_if("_early").alias("n_train"), _wins(F.col("_early")).alias("wr_train"), _wins(~F.col("_early")).alias("wr_valid"),
        *[F.avg(F.when(F.col("_early"), F.col(x))).alias(name) for name, x in TRAIN.items()],
    ]
    sets = facts.groupingSets([["variable", "value", "direccion"], PATTERN], *PATTERN).agg(*measures)
    found = sets.withColumn("_min", least_count() if minimum is None else minimum).where("n >= _min")
    if not holdout:
        return found.drop("_min", "n_train", "wr_train", "wr_valid", *TRAIN)
    n_valid = F.col("n") - F.col("n_train")
    pending = n_valid < F.greatest(F.lit(3), F.floor(F.col("_min") / 5))
    good = (F.col("wr_valid") >= HOLDOUT_WR) & (F.col("wr_train") - F.col("wr_valid") <= HOLDOUT_GAP)
    found = found.where((F.col("n_train") >= F.col("_min")) & (pending | good))
    found = found.withColumns({"estado": F.when(pending, "PENDIENTE_VALIDACION").otherwise("VALIDADO"), "wr_valid": F.when(~pending, F.col("wr_valid"))})
    return found.drop("_min")


def windows_of(total: int, n: int = WINDOWS, overlap: float = OVERLAP, rolling: bool = False) -> list[tuple[int, int, int]]:
    """(number, first, last) positions of the validation part of each window.

    As the fixed sizes have it, each window trains on 60 % and validates on what follows, so the later
    parts are suffixes of each other; ``rolling`` gives windows of equal length that move on instead.
    Windows with an empty validation part are left out, so very few rows have none.
    """
    step, size, tail = int(total * (1 - overlap) / max(n - 1, 1)), int(total * 0.6), int(total * 0.4)
    if rolling:
        size, tail = int(total * 0.3), int(total * 0.2)
    out = []
    for i in range(n):
        middle = i * step + size
        if middle >= total or tail == 0:
            break
        out.append((i, middle, min(middle + tail, total) - 1))
    return out


def robustness(rows: DataFrame, flags: list[str], patterns: DataFrame, n: int = WINDOWS, least: int = 3, rolling: bool = False, categories: list[str] = ()) -> DataFrame:
    """``patterns`` with their win rate in each window (``wr_ventanas``), its spread, the share of windows with an edge, and ``robusto``."""
    total = rows.count()
    spans = windows_of(total, n, rolling=rolling)
    # window borders are times at positions: exact quantiles of the sorted times, from one distributed sort
    place = F.row_number().over(Window.partitionBy("_day").orderBy("_us", "tf", "mov_id", "symbol"))
    timed = rows.withColumn("_us", F.unix_micros(F.col("timestamp_inicio").cast("timestamp"))).withColumn("_day", F.floor(F.col("_us") / 86_400_000_000))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = timed.groupBy("_day").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = timed.withColumn("_own", place).join(days, "_day").withColumn("_pos", F.col("_own") + F.col("_before") - 1)
    borders = {r[0]: r[1] for r in placed.where(F.col("_pos").isin([p for _, a, b in spans for p in (a, b)])).select("_pos", "_us").collect()}
    limits = [F.struct(F.lit(i).alias("w"), F.lit(borders[a]).alias("a"), F.lit(borders[b]).alias("b")) for i, a, b in spans]
    facts = long_form(timed, flags, categories, keep=["tf", "direccion", "_us", "continuacion"])
    facts = facts.withColumn("_w", F.explode(F.filter(F.array(*limits).cast("array<struct<w:int,a:bigint,b:bigint>>"), lambda s: F.col("_us").between(s["a"], s["b"]))))
    rates = facts.groupBy("variable", "value", "direccion", F.col("_w.w").alias("w")).agg(F.count(F.lit(1)).alias("_n"), _wins().alias("wr")).where(F.col("_n") >= least)
    per = rates.groupBy("variable", "value", "direccion").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("w", "wr"))), lambda s: s["wr"]).alias("wr_ventanas"), F.stddev_pop("wr").alias("wr_std"), F.avg((F.col("wr") >= WR_EDGE).cast("double")).alias("pct_ventanas_edge")
    )
    joined = patterns.join(per, ["variable", "value", "direccion"], "left")
    return joined.withColumn("robusto", F.coalesce((F.col("pct_ventanas_edge") >= MIN_EDGE_SHARE) & (F.col("wr_std") <= MAX_WR_STD), F.lit(False)))


def match(patterns: DataFrame, state: DataFrame, flags: list[str], categories: list[str] = ()) -> DataFrame:
    """The patterns whose predicate holds in ``state`` (one row, or one for each symbol)."""
    keep = [c for c in ("symbol",) if c in state.columns]
    active = long_form(state, flags, categories, keep)
    return patterns.join(active, ["variable", "value"])  # Spark sends the smaller side if it is small enough


def overlap(patterns: DataFrame, state: DataFrame, flags: list[str], first: int = 5) -> DataFrame:
    """What to say when nothing matches: how many variables are active, how many of them patterns use, the first few."""
    active = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags])))
    used = [r[0] for r in patterns.select("variable").where(F.col("variable").isin(flags)).distinct().collect()]  # at most the flags
    both = F.array_sort(F.array_intersect(active, F.lit(used) if used else F.array().cast("array<string>")))
    return state.select(*[c for c in ("symbol",) if c in state.columns], F.size(active).alias("n_active"), F.size(both).alias("n_overlap"), F.slice(both, 1, first).alias("first"))


def summary(patterns: DataFrame) -> DataFrame:
    """Patterns for reading, the best validated first."""
    tie = [F.col(c) for c in PATTERN]
    return patterns.orderBy(F.col("wr_valid").desc_nulls_last(), F.col("n").desc(), *tie)


def describe(patterns: DataFrame) -> DataFrame:
    """The predicate of each pattern as one text, ``variable==value@tf``."""
    return patterns.withColumn("patron", F.concat(F.col("variable"), F.lit("=="), F.col("value"), F.coalesce(F.concat(F.lit("@"), F.col("tf")), F.lit(""))))


def parse_predicate(text: Column) -> Column:
    """struct(variable, value, tf) of such a text."""
    left = F.split(text, "==")
    right = F.split(F.element_at(left, 2), "@")
    return F.struct(F.element_at(left, 1).alias("variable"), F.element_at(right, 1).alias("value"), F.try_element_at(right, F.lit(2)).alias("tf"))
