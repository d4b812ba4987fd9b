"""The registered queries of the bar operators, each over whole tables; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.catalogue import FIB_RATIOS, ratio_name
from barloom.functions import indicators as ind
from barloom.functions.windows import KEYS, ewm, flag, in_blocks, rolling, series, with_position, with_run
from barloom.operators import analysis, asof, hop, knn, mining, movements, outcomes, resample, signals, structure
from barloom.sources import bars as sources
from barloom.stored import checkpoint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Thresholds and sizes that suit the values of the events and orders tables.
THRESHOLDS = {"1H": 95.0, "4H": 95.0, "1D": 60.0}
SWINGS = {"1H": 5, "4H": 3, "1D": 3}
RATIOS = [ratio_name(r) for r in FIB_RATIOS]
TAKE, STOP, HOLD = 0.5, 0.4, 24


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def events(spark: SparkSession, sf_dir: str, *tfs: str) -> DataFrame:
    return resample.all_timeframes(sources.from_events(spark, sf_dir), list(tfs))


def orders(spark: SparkSession, sf_dir: str, tf: str = "1D") -> DataFrame:
    return resample.ohlcv(sources.from_orders(spark, sf_dir), tf)


def legs(bars: DataFrame) -> DataFrame:
    """Runs of bars in one direction as movements: a simple source of intervals for the interval operators."""
    up = F.col("close") > F.col("open")
    w = series()
    df = bars.withColumn("direccion", F.when(up, "LONG").otherwise("SHORT"))
    df = df.withColumn("_g", F.sum(flag(F.col("direccion") != F.lag("direccion").over(w))).over(w))
    edge = F.when(F.col("direccion") == "LONG", F.col("high"))
    found = df.groupBy(*KEYS, "direccion", "_g").agg(
        F.min("ts").alias("timestamp_inicio"), F.max("ts").alias("timestamp_fin"), F.min_by("open", "ts").alias("precio_inicio"), F.max_by("close", "ts").alias("precio_fin"),
        F.coalesce(F.max(edge), F.min("low")).alias("precio_extremo"), F.count(F.lit(1)).cast("int").alias("duracion_barras"),
    )
    size = F.when(F.col("direccion") == "LONG", F.col("precio_extremo") - F.col("precio_inicio")).otherwise(F.col("precio_inicio") - F.col("precio_extremo"))
    found = found.withColumns({"mov_id": F.concat("symbol", F.lit("_"), "tf", F.lit("_"), F.col("_g").cast("string")), "magnitud_pct": size / F.col("precio_inicio") * 100})
    minutes = F.when(F.col("tf") == "1D", 1440).when(F.col("tf") == "4H", 240).otherwise(60)
    return found.withColumn("duracion_min", F.col("duracion_barras") * minutes).drop("_g")


def linked_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # several joins read these; they are computed once
    return checkpoint(movements.link_parents(checkpoint(legs(events(spark, sf_dir, "1H", "4H", "1D")))))


def leg_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcomes(linked_legs(spark, sf_dir), events(spark, sf_dir, "1H"))


@query
def resample_right(spark, sf_dir):
    return events(spark, sf_dir, "15M")


@query
def resample_week(spark, sf_dir):
    return orders(spark, sf_dir, "1W")


@query
def ohlcv_multi_tf(spark, sf_dir):
    return events(spark, sf_dir, "5M", "30M", "1H", "4H", "1D")


@query
def upsert_dedup(spark, sf_dir):
    rows = sources.from_orders(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), "o_orderstatus"), "seq")
    final = F.col("o_orderstatus") == "F"
    return sources.upsert(rows.where(final), rows.where(~final)).select("symbol", "ts", "price", "seq")


@query
def latest_row(spark, sf_dir):
    return sources.latest(events(spark, sf_dir, "1H"))


@query
def time_range_filter(spark, sf_dir):
    return sources.time_range(sources.from_orders(spark, sf_dir), "1996-02-01", "1996-02-29").select("symbol", "ts", "price", "seq")


@query
def rolling_mean(spark, sf_dir):
    df = events(spark, sf_dir, "4H")
    df = df.withColumn("sma50", rolling(F.avg, F.col("close"), 50))
    return df.select("symbol", "ts", F.round("sma50", 4).alias("sma50"), flag(F.col("close") > F.col("sma50")).alias("above"))


@query
def rolling_minmax(spark, sf_dir):
    df = in_blocks(with_position(events(spark, sf_dir, "1H")), lambda d: d.select("*", rolling(F.min, F.col("low"), 14).alias("low14"), rolling(F.max, F.col("high"), 14).alias("high14"), rolling(F.max, F.col("high"), 50, 5).alias("high50")), before=49, block=4096)
    return df.select("symbol", "ts", "low14", "high14", "high50")


@query
def rolling_std(spark, sf_dir):
    return orders(spark, sf_dir).select("symbol", "ts", F.round(rolling(F.stddev_samp, F.col("close"), 200, 50), 2).alias("std200"))


@query
def lag_diff(spark, sf_dir):
    w = series()
    return events(spark, sf_dir, "1H").select("symbol", "ts", F.lag("close", 1).over(w).alias("lag1"), F.lag("close", 2).over(w).alias("lag2"), F.round(F.col("close") - F.lag("close").over(w), 4).alias("diff"))


@query
def run_length(spark, sf_dir):
    df = with_run(events(spark, sf_dir, "1H"), "run", F.col("close") > F.col("open"))
    return df.select("symbol", "ts", F.col("run").cast("long").alias("run"))


@query
def series_position(spark, sf_dir):
    return with_position(events(spark, sf_dir, "15M"), chunk_seconds=86_400 * 3).select("symbol", "ts", "pos")


@query
def ewm_mean(spark, sf_dir):
    df = ewm(with_position(orders(spark, sf_dir)), {"ema8": ("close", 8), "ema26": ("close", 26)})
    return df.select("symbol", "ts", F.round("ema8", 2).alias("ema8"), F.round("ema26", 2).alias("ema26"))


@query
def macd(spark, sf_dir):
    df = ind.macd(orders(spark, sf_dir))
    return df.select("symbol", "ts", *[F.round(c, 2).alias(c) for c in ("macd_line", "macd_signal_line", "macd_hist", "macd_hist_delta", "macd_line_dist")])


@query
def macd_events(spark, sf_dir):
    df = ind.macd(orders(spark, sf_dir))
    flags = ["macd_above_zero", "macd_line_above_zero", "macd_above_sig", "macd_e1_bull", "macd_e1_bear", "macd_e2_bull", "macd_e2_bear", "macd_hist_bars_rising", "macd_hist_bars_falling"]
    return df.select("symbol", "ts", *[F.col(c).cast("int").alias(c) for c in flags])


@query
def stochastic(spark, sf_dir):
    df = ind.stochastic(events(spark, sf_dir, "1H"))
    return df.select("symbol", "ts", *[F.round(c, 4).alias(c) for c in ("stoch_K", "stoch_D", "stoch_K_delta", "stoch_KD_dist")])


@query
def stoch_signals(spark, sf_dir):
    df = ind.stochastic(events(spark, sf_dir, "1H"))
    return df.select("symbol", "ts", *[F.col(c).cast("int").alias(c) for c in ("stoch_KD_above", "stoch_ob", "stoch_os", "stoch_A_bull", "stoch_A_bear", "stoch_B_bull", "stoch_B_bear", "stoch_bars_extreme")])


@query
def ma_family(spark, sf_dir):
    df = ind.ma_family(orders(spark, sf_dir))
    names = [f"{p}_{m}" for m in ind.MA_SPANS for p in ("above", "near", "reject_bull", "reject_bear")]
    return df.select("symbol", "ts", *[F.round(f"dist_{m}_pct", 4).alias(f"dist_{m}_pct") for m in ind.MA_SPANS], *names, "align_full_bull", "align_full_bear")


@query
def ma_cross(spark, sf_dir):
    df = ind.ma_family(orders(spark, sf_dir), ("ema21", "sma50"))
    return df.select("symbol", "ts", *[F.col(f"{p}_{m}").cast("int").alias(f"{p}_{m}") for m in ("ema21", "sma50") for p in ("cross_bull", "cross_bear", "bars_side")])


@query
def ma_extreme(spark, sf_dir):
    df = ind.ma_family(orders(spark, sf_dir), ("sma50", "sma200"))
    return df.select("symbol", "ts", *[f"extreme_{s}_{m}" for m in ("sma50", "sma200") for s in ("bull", "bear")])


@query
def fib_levels(spark, sf_dir):
    df = in_blocks(with_position(events(spark, sf_dir, "1H", "1D")), lambda d: ind.fib_levels(d, mas=()), before=50, block=4096)
    names = [f"fib{r}_{p}" for r in RATIOS for p in ("in_zone", "reject_bull", "reject_bear", "above")]
    return df.select("symbol", "tf", "ts", *[F.round(f"fib{r}_{p}", 4).alias(f"fib{r}_{p}") for r in RATIOS for p in ("level", "dist_pct")], *names)


@query
def fib_confluence(spark, sf_dir):
    df = ind.fib_levels(orders(spark, sf_dir))
    return df.select("symbol", "ts", *[f"fib{r}_conf_{m}" for r in ("0382", "05", "0618") for m in ("ema8", "sma50")])


@query
def indicator_census(spark, sf_dir):
    """All 142 indicator columns: the sum of each flag and run length, the mean of each other one, for each series."""
    df = ind.all_indicators(orders(spark, sf_dir), block=1 << 10)
    whole = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in ("symbol", "tf", "ts", "open", "high", "low", "close", "volume", "pos", *ind.MA_SPANS)}
    return df.groupBy("symbol").agg(*[F.sum(c).alias(c) if kind in ("int", "bigint") else F.round(F.avg(c), 2).alias(c) for c, kind in whole.items()])


@query
def asof_state(spark, sf_dir):
    states = events(spark, sf_dir, "15M", "1H", "4H", "1D").withColumn("up", flag(F.col("close") > F.col("open")))
    spine = sources.from_events(spark, sf_dir).select("symbol", "ts", "seq", "price")
    df = asof.state_matrix(spine, states, ["15M", "1H", "4H", "1D"], ["close", "up"])
    return df.select("seq", *[F.col(f"s_{tf}.{c}").alias(f"{c}_{tf}") for tf in ("15M", "1H", "4H", "1D") for c in ("close", "up")])


@query
def asof_bars(spark, sf_dir):
    """Ticks with the close of the last 15-minute bar."""
    right = events(spark, sf_dir, "15M").select("symbol", F.col("ts").alias("bar_ts"), "close")
    df = asof.asof(sources.from_events(spark, sf_dir).select("symbol", "ts", "seq"), right, ["symbol"], "ts", "bar_ts", ["close"], "bar")
    return df.select("seq", F.col("bar.close").alias("close"))


@query
def asof_chunked(spark, sf_dir):
    right = events(spark, sf_dir, "4H").select("symbol", F.col("ts").alias("bar_ts"), "close")
    df = asof.asof(sources.from_events(spark, sf_dir).select("symbol", "ts", "seq"), right, ["symbol"], "ts", "bar_ts", ["close"], "bar", strict=True, chunk_seconds=86_400 * 2)
    return df.select("seq", F.col("bar.bar_ts").alias("bar_ts"), F.col("bar.close").alias("close"))


@query
def asof_parent(spark, sf_dir):
    return linked_legs(spark, sf_dir).select("mov_id", "tf", "tf_parent_id")


@query
def asof_snapshot(spark, sf_dir):
    states = events(spark, sf_dir, "15M").select("symbol", "ts", "close")
    df = movements.snapshots(legs(events(spark, sf_dir, "4H", "1D")), states, ["close"])
    return df.select("mov_id", F.col("at_start.close").alias("close_start"), F.col("at_end.ts").alias("ts_end"), F.col("at_end.close").alias("close_end"))


@query
def asof_prev_swing(spark, sf_dir):
    return outcomes.rebound(legs(events(spark, sf_dir, "1H", "4H", "1D"))).select("mov_id", "rebote_fib")


@query
def range_join_mfe_mae(spark, sf_dir):
    df = outcomes.excursions(legs(events(spark, sf_dir, "4H", "1D")), events(spark, sf_dir, "15M"))
    return df.select("mov_id", "mfe_pct", "mae_pct", "fib_agotamiento")


@query
def two_hop_align(spark, sf_dir):
    return movements.aligned(linked_legs(spark, sf_dir)).select("mov_id", "alineamiento_3tf")


@query
def continuation(spark, sf_dir):
    # legs alternate, so the machine's movements of daily bars are asked as well
    daily = movements.movements(structure.structure(orders(spark, sf_dir), {"1D": 3}), {"1D": 60.0})
    return movements.continuation(daily).select("symbol", "mov_id", "continuacion")


@query
def nearest_level(spark, sf_dir):
    df = events(spark, sf_dir, "1H")
    x = (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return df.select("symbol", "ts", outcomes.nearest_level(x).alias("level"))


@query
def swing_candidates(spark, sf_dir):
    df = structure.swing_candidates(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS)
    return df.select("symbol", "tf", "ts", "is_high", "is_low")


@query
def swings(spark, sf_dir):
    return structure.swings(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS).select("symbol", "tf", "ts", "swing_type", "swing_price", "confirmed_ts")


@query
def structure_class(spark, sf_dir):
    return structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS).select("symbol", "tf", "ts", "estructura")


@query
def bos_choch(spark, sf_dir):
    return structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS).select("symbol", "tf", "ts", "bos_event", "choch_event")


@query
def structure_summary(spark, sf_dir):
    return structure.structure_summary(structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS))


@query
def movement_machine(spark, sf_dir):
    df = movements.movements(structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS), THRESHOLDS)
    return df.withColumn("magnitud_pct", F.round("magnitud_pct", 2))


@query
def outcomes_by_tf_dir(spark, sf_dir):
    return outcomes.by_timeframe(leg_outcomes(spark, sf_dir), 7)


@query
def outcome_mismatches(spark, sf_dir):
    """Stored outcomes of which one in three legs has been spoilt: exactly those differ from outcomes computed afresh."""
    rows = leg_outcomes(spark, sf_dir)
    spoilt = rows.withColumn("fib_agotamiento", F.when(F.col("duracion_barras") % 3 == 0, -1.0).otherwise(F.col("fib_agotamiento")))
    return outcomes.mismatches(checkpoint(spoilt), events(spark, sf_dir, "1H")).select("mov_id", "fib_agotamiento")


@query
def outcome_rows(spark, sf_dir):
    return leg_outcomes(spark, sf_dir).select("mov_id", "mfe_pct", "mae_pct", "fib_agotamiento", "rebote_fib", "alineamiento_3tf", F.round("ratio_mfe_mae", 4).alias("ratio_mfe_mae"))


FLAGS = ["above_open", "above_prev", "long_range", "upper_half"]


def flagged(bars: DataFrame) -> DataFrame:
    """Four simple flags of each bar, for the mining and signal operators."""
    before = F.lag("close").over(series())
    return bars.withColumns(
        {
            "above_open": flag(F.col("close") > F.col("open")), "above_prev": flag(F.col("close") > before), "long_range": flag(F.col("high") > 3 * F.col("low")),
            "upper_half": flag(F.col("close") > (F.col("high") + F.col("low")) / 2),
        }
    )


def stated_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of legs with the flags of the bar before each; whether the next leg is longer stands for continuation (legs alternate)."""
    rows = leg_outcomes(spark, sf_dir)
    w = Window.partitionBy(*KEYS).orderBy("timestamp_inicio", "mov_id")
    longer = F.lead("duracion_barras").over(w) >= F.col("duracion_barras")
    rows = rows.withColumn("continuacion", F.when(longer.isNull(), "ULTIMO").when(longer, "CONTINUACION").otherwise("REVERSION"))
    states = flagged(events(spark, sf_dir, "1H")).select("symbol", "ts", *FLAGS)
    return checkpoint(asof.asof(rows, states, ["symbol"], "timestamp_inicio", "ts", FLAGS, "_s", strict=True).select("*", "_s.*").drop("_s", "ts"))


def rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query
def mine_patterns(spark, sf_dir):
    df = mining.mine(stated_legs(spark, sf_dir), FLAGS, holdout=False)
    return rounded(df, ["winrate", "mag_media", "mag_std", "dur_media", "mfe_media", "mae_media"], 3)


@query
def temporal_holdout(spark, sf_dir):
    df = mining.mine(stated_legs(spark, sf_dir), FLAGS)
    return rounded(df.select(*mining.PATTERN, "n", "winrate", "wr_train", "wr_valid", "estado"), ["winrate", "wr_train", "wr_valid"])


@query
def train_statistics(spark, sf_dir):
    """Means of validated patterns over their training rows alone."""
    df = mining.mine(stated_legs(spark, sf_dir), FLAGS)
    return rounded(df.select(*mining.PATTERN, "n", "n_train", *mining.TRAIN), list(mining.TRAIN), 3)


def four_digits(x: Column) -> Column:
    """As text, halves to even, as the reference rounds the win rates of windows."""
    return F.format_string("%.4f", F.bround(x, 4))


@query
def robust_windows(spark, sf_dir):
    """Patterns with their win rates in each window, to four digits, halves to even."""
    rows = stated_legs(spark, sf_dir)
    df = mining.robustness(rows, FLAGS, mining.mine(rows, FLAGS, holdout=False))
    wr = F.array_join(F.transform("wr_ventanas", four_digits), ",")
    return df.select(*mining.PATTERN, "n", wr.alias("wr_ventanas"), F.round("wr_std", 4).alias("wr_std"), F.round("pct_ventanas_edge", 4).alias("pct_ventanas_edge"), "robusto")


@query
def match_current(spark, sf_dir):
    rows = stated_legs(spark, sf_dir)
    state = sources.latest(flagged(events(spark, sf_dir, "1H")))
    found = mining.match(mining.mine(rows, FLAGS, holdout=False).drop("symbol"), state, FLAGS)
    return mining.describe(found).select("symbol", "patron", "direccion", "n")


@query
def match_overlap(spark, sf_dir):
    patterns = mining.mine(stated_legs(spark, sf_dir), FLAGS, holdout=False)
    state = sources.latest(flagged(events(spark, sf_dir, "1D")))
    df = mining.overlap(patterns, state, [*FLAGS])
    return df.select("symbol", "n_active", "n_overlap", F.array_join("first", ",").alias("first"))


@query
def predicate_parse(spark, sf_dir):
    text = mining.describe(mining.mine(stated_legs(spark, sf_dir), FLAGS, holdout=False)).select("patron", "direccion")
    return text.select("patron", "direccion", mining.parse_predicate(F.col("patron")).alias("p")).select("patron", "direccion", "p.*")


@query
def summary_table(spark, sf_dir):
    df = mining.summary(mining.mine(stated_legs(spark, sf_dir), FLAGS))
    return rounded(mining.describe(df).select("patron", "direccion", "n", "winrate", "wr_valid", "estado"), ["winrate", "wr_valid"])


@query
def top_k_patterns(spark, sf_dir):
    df = mining.mine(stated_legs(spark, sf_dir), FLAGS, holdout=False)
    return mining.describe(df).orderBy(F.desc("n"), "patron", "direccion").limit(20).select("patron", "direccion", "n")


@query
def histogram_moves(spark, sf_dir):
    df = checkpoint(ind.macd(orders(spark, sf_dir)))
    df = analysis.histogram_moves(df, long_exit=F.col("macd_hist_bars_falling") >= 5, short_exit=F.col("macd_hist_bars_rising") >= 5, least_bars=5, least_pct=10.0)
    return df.drop("tf")


@query
def pattern_key_stats(spark, sf_dir):
    df = flagged(with_position(events(spark, sf_dir, "1H"))).withColumn("dist_mid", (F.col("close") - F.col("open")) / F.col("open"))
    moves = df.select(*KEYS, F.col("pos").alias("bar_start"), F.when(F.col("above_open") == 1, "LONG").otherwise("SHORT").alias("direction"), (F.lead("close").over(series()) - F.col("close")).alias("pct_move"), F.col("volume").alias("mfe_pct"), (F.col("high") - F.col("low")).alias("duration_hrs"))
    moves = analysis.state_at(moves.where("pct_move is not null"), df, ["above_prev", "long_range", "upper_half", "dist_mid"])
    moves = moves.withColumn("pattern_key", analysis.pattern_key(moves, ["above_prev", "long_range", "upper_half", "dist_mid"]))
    return rounded(analysis.pattern_stats(moves), ["pct_move_med", "pct_move_mean", "dur_hrs_med"], 1)


@query
def forward_returns(spark, sf_dir):
    df = in_blocks(with_position(events(spark, sf_dir, "1H")), signals.forward, after=120, block=4096)
    return df.select("symbol", "ts", *[f"{p}_{h}" for h in (30, 60, 120) for p in ("ret", "mae", "mfe")])


@query
def univariate_edge(spark, sf_dir):
    return rounded(signals.univariate(flagged(events(spark, sf_dir, "1H")), FLAGS), [f"{p}_{h}" for h in (30, 60, 120) for p in ("wr_long", "wr_short")] + ["best_wr"], 3)


@query
def chosen_signals(spark, sf_dir):
    """The variables that trade: none has the first win rate, so the lower one chooses."""
    table = checkpoint(signals.univariate(flagged(events(spark, sf_dir, "1H")), FLAGS))
    long, short = signals.chosen_signals(table, least=50, win_rate=0.9, otherwise=0.5)
    return spark.createDataFrame([(v, "LONG") for v in long] + [(v, "SHORT") for v in short], "variable string, side string")


@query
def chosen_trades(spark, sf_dir):
    """Trades on the variables that the univariate table chooses."""
    df = checkpoint(flagged(with_position(events(spark, sf_dir, "1H"))))
    long, short = signals.chosen_signals(signals.univariate(df, FLAGS), least=50, win_rate=0.9, otherwise=0.5)
    return rounded(signals.trade_cycle(df, signals.any_of(long), signals.any_of(short), TAKE, STOP, HOLD).drop("tf"), ["entry_price", "exit_price", "pnl_pct"])


@query
def univariate_next(spark, sf_dir):
    return rounded(signals.univariate_next(flagged(events(spark, sf_dir, "1H")), FLAGS), ["winrate", "edge"], 3).drop("tf")


@query
def alignment_regime(spark, sf_dir):
    tfs = ["15M", "30M", "1H", "4H", "1D"]
    states = events(spark, sf_dir, *tfs).withColumn("up", flag(F.col("close") > F.col("open")))
    df = asof.state_matrix(sources.from_events(spark, sf_dir).select("symbol", "ts", "seq"), states, tfs, ["up"])
    df = signals.alignment(df.select("seq", *[F.col(f"s_{tf}.up").alias(f"up_{tf}") for tf in tfs]), [f"up_{tf}" for tf in tfs], 4, 3)
    return df.select("seq", "n_bull", "n_bear", "regime", "thesis_long", "thesis_short")


@query
def event_flags(spark, sf_dir):
    df = signals.event_flags(flagged(events(spark, sf_dir, "1H")), ["above_open", "long_range"], ["upper_half", "above_prev"])
    return df.select("symbol", "ts", "event_bull", "event_bear")


@query
def first_hit(spark, sf_dir):
    df = signals.first_hit(with_position(events(spark, sf_dir, "1H")), TAKE, STOP, HOLD)
    return df.select("symbol", "ts", *[F.col(f"{s}.exit").alias(f"exit_{s}") for s in ("long", "short")], *[F.col(f"{s}.reason").alias(f"reason_{s}") for s in ("long", "short")], *[F.round(f"{s}.{p}", 4).alias(f"{p}_{s}") for s in ("long", "short") for p in ("pnl", "price")])


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flagged(with_position(events(spark, sf_dir, "1H")))
    return signals.trade_cycle(df, signals.all_of(["above_open", "above_prev"]), signals.any_of(["long_range"]), TAKE, STOP, HOLD)


@query
def trade_cycle(spark, sf_dir):
    return rounded(trades(spark, sf_dir).drop("tf", "entry_price"), ["exit_price", "pnl_pct"])


@query
def trade_stats(spark, sf_dir):
    return rounded(signals.trade_stats(trades(spark, sf_dir), ("symbol", "direction")), ["win_rate", "total_pnl", "avg_pnl"], 3)


@query
def combo_search(spark, sf_dir):
    df = flagged(with_position(events(spark, sf_dir, "1H")))
    return rounded(signals.combo_search(df, FLAGS, TAKE, STOP, HOLD).drop("tf"), ["win_rate", "avg_pnl", "total_pnl", "tp_rate", "edge"], 3)


@query
def knn_hamming(spark, sf_dir):
    df = flagged(with_position(orders(spark, sf_dir)))
    df = knn.knn(df, FLAGS)
    names = [f"{p}_{h}" for h in (30, 60, 120) for p in ("wr_long", "wr_short")]
    return df.select("symbol", "ts", "n_neighbors", *names, *[f"{p}_{h}" for h in (30, 60, 120) for p in ("pnl_long", "mae_mean", "mfe_mean")])


@query
def value_counts_norm(spark, sf_dir):
    return rounded(analysis.value_shares(structure.structure(events(spark, sf_dir, "1H"), SWINGS), "estructura"), ["share"])


@query
def direction_balance(spark, sf_dir):
    return analysis.direction_balance(legs(events(spark, sf_dir, "1H", "4H", "1D")))


@query
def group_aggregate(spark, sf_dir):
    """The flagship: right-closed bars, their 50-bar mean and how often they close above it."""
    df = reduce(lambda a, f: f(a), [lambda d: d.withColumn("sma50", rolling(F.avg, F.col("close"), 50))], events(spark, sf_dir, "1H", "4H"))
    return df.groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("n_bars"), F.sum(flag(F.col("close") > F.col("sma50"))).alias("n_above"), F.round(F.avg("close"), 4).alias("avg_close"))


@query
def hop_intervals(spark, sf_dir):
    df = with_position(events(spark, sf_dir, "15M")).withColumn("stop", F.col("pos") + 1 + F.floor(F.col("close") / 20).cast("long"))
    return hop.hop_select(df.select("symbol", "pos", "stop"), ["symbol"], "pos", "stop", 1)
