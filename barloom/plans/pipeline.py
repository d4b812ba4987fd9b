"""The whole chain from base bars to validated patterns, and its live form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from barloom.catalogue import EXHAUSTION, ORDER, SWING_BARS
from barloom.functions.indicators import all_indicators, flag_columns
from barloom.operators import analysis, mining, movements, outcomes, resample, structure
from barloom.operators.asof import state_matrix
from barloom.sources.bars import latest
from barloom.sources.report import html_page, html_table
from barloom.stored import checkpoint
from barloom.streaming.live import CATEGORIES, KEEP, live_states
from barloom.streaming.live import names as live_names


@dataclass
class Result:
    """The frame of each stage; those that later stages read are stored, the others are computed when asked for."""

    bars: DataFrame
    structure: DataFrame
    movements: DataFrame
    outcomes: DataFrame
    patterns: DataFrame
    robust: DataFrame
    matches: DataFrame



def states_of(bars: DataFrame, formed: DataFrame) -> tuple[DataFrame, list[str]]:
    """Indicator flags and structure of every bar of every timeframe, and the flags' names."""
    df = checkpoint(all_indicators(bars))
    flags = flag_columns(df)
    return df.select("symbol", "tf", "ts", *flags).join(formed.select("symbol", "tf", "ts", *CATEGORIES), ["symbol", "tf", "ts"], "left"), flags


def matrix(spine: DataFrame, states: DataFrame, tfs: list[str], columns: list[str]) -> DataFrame:
    """``spine`` with every column of every timeframe's state as of its time, named timeframe_column."""
    wide = state_matrix(spine, states, tfs, columns)
    return wide.select(*spine.columns, *[F.col(f"s_{tf}.{c}").alias(f"{tf}_{c}") for tf in tfs for c in columns])


def analyse(base: DataFrame, tfs: list[str] = ORDER, state_tf: str | None = None, swings: dict[str, int] = SWING_BARS, exhaustion: dict[str, float] = EXHAUSTION) -> Result:
    """Everything from ``base`` (ticks, or bars of the lowest timeframe).

    Patterns are mined from the state matrix as of each movement's start: the indicator flags and the
    structure of all timeframes.  Excursions are taken over the bars of ``state_tf`` (the lowest by default).
    """
    bars = checkpoint(resample.all_timeframes(base, tfs))
    formed = checkpoint(structure.structure(bars, {tf: swings[tf] for tf in tfs}))
    moves = checkpoint(movements.link_parents(checkpoint(movements.movements(formed, exhaustion)), tfs))
    facts = outcomes.outcomes(moves, bars.where(F.col("tf") == (state_tf or tfs[-1])))
    states, flags = states_of(bars, formed)
    states = checkpoint(states)
    columns = [*flags, *CATEGORIES]
    names, kinds = ([f"{tf}_{c}" for tf in tfs for c in x] for x in (flags, CATEGORIES))
    stated = checkpoint(matrix(facts.withColumn("ts", F.col("timestamp_inicio")), states, tfs, columns))
    now = checkpoint(matrix(latest(states).select("symbol", "ts"), states, tfs, columns))
    patterns = checkpoint(mining.mine(stated, names, kinds))
    robust = mining.robustness(stated, names, patterns, categories=kinds)
    return Result(bars, formed, moves, facts, patterns, robust, mining.match(patterns, now, names, kinds))


def live(bars: DataFrame, patterns: DataFrame, history: DataFrame, out: str, checkpoint_dir: str, tfs: list[str] = ORDER, swings: dict[str, int] = SWING_BARS, keep: int = KEEP) -> StreamingQuery:
    """Matches of a stream of bars (of all timeframes) against ``patterns``, written to ``out``/matches/batch=k for each micro-batch.

    The state is kept by symbol (:func:`barloom.streaming.live.live_states`): ``history`` is read before the first batch
    and never again, and a batch gives the matches of the symbols that it has bars of.  A batch that is run again after
    a failure writes the same again.
    """
    names, kinds = ([f"{tf}_{c}" for tf in tfs for c in x] for x in (live_names(), CATEGORIES))

    def work(batch: DataFrame, number: int) -> None:
        mining.match(patterns, batch, names, kinds).write.mode("overwrite").parquet(f"{out}/matches/batch={number}")

    return live_states(bars, history, tfs, swings, keep).writeStream.foreachBatch(work).outputMode("update").option("checkpointLocation", checkpoint_dir).start()


def report(found: Result, rows: int = 500) -> str:
    """The whole result as one HTML page: counts by timeframe, outcomes, patterns, robust ones, what matches now."""
    counts = found.movements.groupBy("tf", "direccion").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("magnitud_pct"), 4).alias("magnitud_media")).orderBy("tf", "direccion")
    robust = found.robust.where("robusto").select(*mining.PATTERN, "n", "winrate", "wr_std", "pct_ventanas_edge")
    parts = [("Movements", counts), ("Outcomes", outcomes.by_timeframe(found.outcomes).orderBy("tf", "direccion")), ("Patterns", mining.describe(mining.summary(found.patterns)).select("patron", "direccion", "n", "winrate", "wr_valid", "estado")), ("Robust patterns", robust), ("Matching now", mining.describe(found.matches).select("symbol", "patron", "direccion", "n", "winrate"))]
    return html_page("Movements and patterns", *[html_table(df, title, rows) for title, df in parts])


@dataclass
class Moves:
    """Histogram-driven moves, and statistics of the state signatures at their starts and ends."""

    moves: DataFrame
    entry: DataFrame
    exit: DataFrame


def exhaustion(high: str = "stoch_ob", low: str = "stoch_os", context_high: str = "context_ob", context_low: str = "context_os") -> dict[str, Column]:
    """Exits of moves: an extreme stochastic after five bars of a shrinking histogram, or after three where a higher timeframe has one, too."""
    shrinks = lambda extreme, context, bars: ((F.col(extreme) == 1) & (F.col(bars) >= 5)) | ((F.col(context) == 1) & (F.col(bars) >= 3))
    return {"long_exit": shrinks(high, context_high, "macd_hist_bars_falling"), "short_exit": shrinks(low, context_low, "macd_hist_bars_rising")}


def analyse_moves(df: DataFrame, columns: list[str], **options) -> Moves:
    """Moves of bars with ``pos``, a MACD histogram and the state ``columns`` of which signatures are made."""
    moves = checkpoint(analysis.histogram_moves(df, **options))

    def stats(position: str) -> DataFrame:
        stated = analysis.state_at(moves, df, columns, position)
        return analysis.pattern_stats(stated.withColumn("pattern_key", analysis.pattern_key(stated, columns)))

    return Moves(moves, stats("bar_start"), stats("bar_end"))
