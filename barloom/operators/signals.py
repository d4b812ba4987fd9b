"""Signals, forward returns and simulated trades."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.catalogue import COMBO_N, COMBO_SIZE, COMBO_TRADES, COMBO_WR, HOLD, HORIZONS, STOP_LOSS, TAKE_PROFIT, WR_EDGE
from barloom.functions.windows import KEYS, flag, series
from barloom.operators.hop import hop_select
from barloom.stored import checkpoint


def any_of(columns: list[str]) -> Column:
    """One flag at least is set; a null flag is not."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) == 1 for c in columns], F.lit(False))


def all_of(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) == 1 for c in columns])


def chosen_signals(table: DataFrame, least: int = COMBO_N, win_rate: float = COMBO_WR, otherwise: float = WR_EDGE, horizon: int = max(HORIZONS)) -> tuple[list[str], list[str]]:
    """(long, short) variables of a :func:`univariate` table that trade: those of ``least`` rows and ``win_rate`` at the horizon, by the lower rate ``otherwise`` if neither side has any.

    The table has one row for each variable, so it is small.
    """
    rows = table.where(F.col("n") >= least).select("variable", f"wr_long_{horizon}", f"wr_short_{horizon}").collect()
    pick = lambda k, rate: sorted(r[0] for r in rows if r[k] is not None and r[k] >= rate)
    first = pick(1, win_rate), pick(2, win_rate)
    return first if any(first) else (pick(1, otherwise), pick(2, otherwise))


def event_flags(df: DataFrame, bull: list[str], bear: list[str]) -> DataFrame:
    return df.withColumns({"event_bull": flag(any_of(bull)), "event_bear": flag(any_of(bear))})


def alignment(df: DataFrame, above: list[str], least: int = 5, thesis: int = 4) -> DataFrame:
    """``n_bull``, ``n_bear``, ``regime`` (BULL, BEAR, NEUTRO), ``thesis_long``, ``thesis_short`` from one above-average flag for each timeframe; a null counts for neither."""
    bull = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in above])
    bear = reduce(lambda a, b: a + b, [1 - F.coalesce(F.col(c), F.lit(1)) for c in above])
    df = df.withColumns({"n_bull": bull, "n_bear": bear})
    regime = F.when(F.col("n_bull") >= least, "BULL").when(F.col("n_bear") >= least, "BEAR").otherwise("NEUTRO")
    return df.withColumns({"regime": regime, "thesis_long": flag(F.col("n_bull") >= thesis), "thesis_short": flag(F.col("n_bear") >= thesis)})


def forward(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, w: WindowSpec | None = None) -> DataFrame:
    """For each horizon: ``ret_h``, and ``mae_h`` and ``mfe_h`` in percent of the path up to it; null without the full path and for a close of zero."""
    w = w or series()
    base = F.nullif(F.col("close"), F.lit(0.0))
    out = {}
    for h in horizons:
        later = F.lead("close", h).over(w)
        path = w.rowsBetween(0, h)
        out[f"ret_{h}"] = (later - F.col("close")) / base
        out[f"mae_{h}"] = F.when(later.isNotNull(), (F.min("close").over(path) - F.col("close")) / base * 100)
        out[f"mfe_{h}"] = F.when(later.isNotNull(), (F.max("close").over(path) - F.col("close")) / base * 100)
    return df.withColumns(out)


def unpivot_flags(df: DataFrame, flags: list[str], keep: list[str]) -> DataFrame:
    """One row for each flag that is set: ``variable`` beside ``keep``."""
    names = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags]))
    return df.select(*keep, F.explode(names).alias("variable"))


def univariate(df: DataFrame, flags: list[str], horizons: tuple[int, ...] = HORIZONS, by: tuple[str, ...] = (), least_edge: float = WR_EDGE) -> DataFrame:
    """Win rates and mean returns of each variable at each horizon, ``best_wr`` and ``has_edge``."""
    rows = unpivot_flags(forward(df, horizons), flags, [*by, *[f"ret_{h}" for h in horizons]])
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    measures = [F.count(F.lit(1)).alias("n")]
    for h in horizons:
        r = F.col(f"ret_{h}")
        measures += [share(r > 0).alias(f"wr_long_{h}"), share(r < 0).alias(f"wr_short_{h}"), F.round(F.avg(r) * 100, 4).alias(f"pnl_mean_{h}")]
    found = rows.groupBy(*by, "variable").agg(*measures)
    best = F.greatest(*[F.col(f"wr_{side}_{h}") for h in horizons for side in ("long", "short")])
    return found.withColumn("best_wr", best).withColumn("has_edge", F.coalesce(F.col("best_wr") >= least_edge, F.lit(False)))


def univariate_next(df: DataFrame, flags: list[str], least: int = 30, least_edge: float = 0.02) -> DataFrame:
    """Share of a variable's rows after which the next row of the same variable closes higher; the last row counts as not."""
    rows = unpivot_flags(df, flags, ["symbol", "tf", "ts", "close"])
    later = F.lead("close").over(Window.partitionBy("symbol", "tf", "variable").orderBy("ts"))
    rows = rows.withColumn("_win", flag(later > F.col("close")))
    found = rows.groupBy("symbol", "tf", "variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_win"), 4).alias("winrate")).where(F.col("n") >= least)
    return found.withColumn("edge", F.round(F.abs(F.col("winrate") - 0.5), 4)).where(F.col("edge") >= least_edge)


def first_reaching(values: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each query the first place from ``start`` on whose value is ``level`` or more; the number of values if there is none.

    A tree of maxima over blocks of 2, 4, 8 ... values: queries climb past blocks that stay below their level, then descend.
    """
    tree = [values]
    while len(tree[-1]) > 1:
        top = tree[-1]
        top = np.append(top, -np.inf) if len(top) % 2 else top
        tree.append(np.maximum(top[0::2], top[1::2]))
    place, depth = start.copy(), np.full(len(start), -1)
    climbing = np.flatnonzero(start < len(values))
    for k, top in enumerate(tree):
        b = place[climbing]
        looks = (b % 2 == 1) | (k == len(tree) - 1)  # an even block is judged with its pair, one level up
        hit = looks & (b < len(top)) & (top[np.minimum(b, len(top) - 1)] >= level[climbing])
        depth[climbing[hit]] = k
        climbing, b = climbing[~hit], b[~hit]
        place[climbing] = (b + b % 2) >> 1
    place[depth < 0] = len(values)
    for k in range(len(tree) - 2, -1, -1):
        on = np.flatnonzero(depth > k)
        left = 2 * place[on]
        place[on] = np.where(tree[k][left] >= level[on], left, left + 1)
    return place


#: The four barriers of a bar: the first crossing upwards and downwards, by profit and by loss.
_BARRIERS = (("up", "take"), ("up", "stop"), ("down", "take"), ("down", "stop"))


def _crossings(df: DataFrame, take: float, stop: float, hold: int, chunk: int) -> DataFrame:
    """(symbol, tf, pos, four positions): where each bar's barriers are first reached within ``hold`` bars, null if they aren't.

    A chunk of ``chunk`` bars is one tree.  A barrier not reached in its bar's chunk goes to the first later chunk whose
    extremes reach it, and is answered there.
    """
    rows = df.where("close is not null").select(*KEYS, F.floor(F.col("pos") / chunk).alias("_chunk"), "pos", F.col("close").cast("double").alias("close"))
    schema = "symbol string, tf string, pos long, side int, level double, found long"

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            at = 0
            own = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for i in [*(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)] if own else []:
                if held and own[at] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = own[at]
                held.append(batch.slice(at, i - at))
                at = i
        if held:
            yield pa.Table.from_batches(held)

    def answer(pos: np.ndarray, close: np.ndarray, side: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1)
        for sign, mine in ((1.0, side < 2), (-1.0, side >= 2)):
            at = first_reaching(sign * close, start[mine], sign * level[mine])
            out[mine] = np.append(pos, -1)[at]
        return out

    def given(table: pa.Table, side: np.ndarray, asked: np.ndarray, level: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        symbol, tf = (pa.array([table[k][0].as_py()] * len(asked), pa.string()) for k in (0, 1))
        reached = pa.array(found, pa.int64(), mask=(found < 0) | (found > asked + hold))
        return pa.RecordBatch.from_arrays([symbol, tf, pa.array(asked), pa.array(side.astype(np.int32)), pa.array(level), reached], ["symbol", "tf", "pos", "side", "level", "found"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            pos, close = table["pos"].to_numpy(), table["close"].to_numpy()
            n = len(pos)
            side = np.repeat(np.arange(4), n)
            level = np.concatenate([close * (1 + take), close * (1 + stop), close * (1 - take), close * (1 - stop)])
            found = answer(pos, close, side, np.tile(np.arange(1, n + 1), 4), level)
            yield given(table, side, np.tile(pos, 4), level, found)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            ask = table["side"].is_valid()
            asks, bars = table.filter(ask), table.filter(pc.invert(ask))
            if len(asks):
                side = asks["side"].to_numpy()
                found = answer(bars["pos"].to_numpy(), bars["close"].to_numpy(), side, np.zeros(len(side), np.int64), asks["close"].to_numpy())
                yield given(asks, side, asks["pos"].to_numpy(), asks["close"].to_numpy(), found)

    own = checkpoint(rows.repartition(*KEYS, "_chunk").sortWithinPartitions(*KEYS, "_chunk", "pos").mapInArrow(within, schema))
    # the chunks after a barrier's own that its holding time reaches into, and the first of them that reaches it
    last = F.floor((F.col("pos") + hold) / chunk)
    here = F.floor(F.col("pos") / chunk)
    open_ = own.where("found is null").where(last > here).withColumn("_chunk", F.explode(F.sequence(here + 1, last)))
    extremes = rows.groupBy(*KEYS, "_chunk").agg(F.max("close").alias("_top"), F.min("close").alias("_bottom"))
    reaches = F.when(F.col("side") < 2, F.col("_top") >= F.col("level")).otherwise(F.col("_bottom") <= F.col("level"))
    sent = open_.join(extremes, [*KEYS, "_chunk"]).where(reaches).groupBy(*KEYS, "pos", "side", "level").agg(F.min("_chunk").alias("_chunk"))
    asks = sent.select(*KEYS, "_chunk", "pos", F.col("level").alias("close"), "side")
    both = rows.join(sent.select(*KEYS, "_chunk").distinct(), [*KEYS, "_chunk"], "left_semi").withColumn("side", F.lit(None).cast("int")).unionByName(asks)
    later = both.repartition(*KEYS, "_chunk").sortWithinPartitions(*KEYS, "_chunk", F.col("side").isNotNull(), "pos").mapInArrow(beyond, schema)
    found = own.where("found is not null").unionByName(later.where("found is not null"))
    names = ["_".join(b) for b in _BARRIERS]
    return found.groupBy(*KEYS, "pos").agg(*[F.min(F.when(F.col("side") == k, F.col("found"))).alias(f"_{n}") for k, n in enumerate(names)])


def first_hit(df: DataFrame, take: float = TAKE_PROFIT, stop: float = STOP_LOSS, hold: int = HOLD, chunk: int = 1 << 16) -> DataFrame:
    """Exit of a trade entered at each bar, for both directions: structs ``long`` and ``short`` of (exit, price, reason, pnl).

    ``df`` needs ``pos``.  The first of the next ``hold`` closes at or beyond the profit or loss barrier
    decides, at the barrier's price; else the close after ``hold`` bars.  Bars without so many
    followers have null.  A task holds ``chunk`` bars, whatever ``hold`` is.
    """
    met = _crossings(df, take, stop, hold, chunk)
    ends = df.select(*KEYS, (F.col("pos") - hold).alias("pos"), F.col("close").alias("_end"))
    out = df.join(ends, [*KEYS, "pos"], "left").join(met, [*KEYS, "pos"], "left")
    close = F.col("close")
    usable = F.col("_end").isNotNull() & (close > 0)

    def side(sign: int) -> Column:
        win, lose = close * (1 + sign * take), close * (1 - sign * stop)
        never = F.lit(1 << 62)
        at_win = F.coalesce("_up_take" if sign > 0 else "_down_take", never)
        at_lose = F.coalesce("_down_stop" if sign > 0 else "_up_stop", never)
        reason = F.when(at_win < at_lose, "TP").when(at_lose < at_win, "SL").otherwise("TIME")
        price = F.when(at_win < at_lose, win).when(at_lose < at_win, lose).otherwise(F.col("_end"))
        pnl = sign * (price - close) / F.nullif(close, F.lit(0.0))
        return F.when(usable, F.struct(F.least(at_win, at_lose, F.col("pos") + hold).alias("exit"), price.alias("price"), reason.alias("reason"), pnl.alias("pnl")))

    return out.withColumns({"long": side(1), "short": side(-1)}).drop("_end", *[f"_{a}_{b}" for a, b in _BARRIERS])


def trade_cycle(df: DataFrame, long: Column, short: Column, take: float = TAKE_PROFIT, stop: float = STOP_LOSS, hold: int = HOLD) -> DataFrame:
    """One trade at a time for each series: enter where a signal is and nothing is held (long before short), next entry at the exit bar at the earliest."""
    marked = first_hit(df, take, stop, hold).withColumn("direction", F.when(long, "LONG").when(short, "SHORT"))
    taken = F.when(F.col("direction") == "LONG", F.col("long")).otherwise(F.col("short"))
    entries = marked.where(F.col("direction").isNotNull() & taken.isNotNull()).select(*KEYS, F.col("pos").alias("bar_entry"), "direction", F.col("close").alias("entry_price"), taken.alias("_t"))
    entries = entries.select(*KEYS, "bar_entry", F.col("_t.exit").alias("bar_exit"), "direction", "entry_price", F.col("_t.price").alias("exit_price"), F.col("_t.pnl").alias("pnl_pct"), F.col("_t.reason").alias("exit_reason"))
    return hop_select(entries, list(KEYS), "bar_entry", "bar_exit", 0)


def trade_stats(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    reason = lambda r: F.count_if(F.col("exit_reason") == r)
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.round(F.avg((F.col("pnl_pct") > 0).cast("double")), 4).alias("win_rate"), F.round(F.sum("pnl_pct"), 5).alias("total_pnl"), F.round(F.avg("pnl_pct"), 6).alias("avg_pnl"),
        reason("TP").alias("n_tp"), reason("SL").alias("n_sl"), reason("TIME").alias("n_time"),
    )


def combo_search(df: DataFrame, signals: list[str], take: float = TAKE_PROFIT, stop: float = STOP_LOSS, hold: int = HOLD, size: int = COMBO_SIZE, least: int = COMBO_TRADES) -> DataFrame:
    """All combinations of up to ``size`` signals as long trades where all are set: one row for each with ``least`` trades.

    Exits are computed once for each bar and shared by all combinations; a bar meets exactly the
    combinations of its own set signals.  The next entry is strictly after the exit.
    """
    names = sorted(signals)
    if len(names) > 62:
        raise ValueError("a set of signals is held in 62 bits")
    hits = first_hit(df, take, stop, hold).where("long is not null and close > 0")
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(F.col(n), F.lit(0)) == 1, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, n in enumerate(names)], F.lit(0).cast("long"))
    bars = hits.select(*KEYS, "pos", mask.alias("_mask"), F.col("long.exit").alias("exit"), F.col("long.pnl").alias("pnl"), F.col("long.reason").alias("reason")).where("_mask > 0")
    # each set of signals that occurs is expanded to its combinations, not each bar
    set_bits = F.expr(f"filter(sequence(0, {len(names) - 1}), i -> shiftright(_mask, i) & 1 = 1)")
    level = F.transform("_bits", lambda i: F.array(i))
    levels = [level]
    for _ in range(size - 1):
        longer = lambda c: F.transform(F.filter("_bits", lambda j: j > F.element_at(c, -1)), lambda j: F.concat(c, F.array(j)))
        level = F.flatten(F.transform(level, longer))
        levels.append(level)
    label = F.array_join(F.transform("combo", lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)), " + ")
    subsets = bars.select("_mask").distinct().withColumn("_bits", set_bits).select("_mask", F.explode(F.concat(*levels)).alias("combo"))
    subsets = subsets.select("_mask", label.alias("signals"), F.size("combo").alias("n_signals"))
    entries = bars.join(subsets, "_mask").select(*KEYS, "signals", "n_signals", F.col("pos").alias("start"), F.col("exit").alias("end"), "pnl", "reason")
    trades = hop_select(entries, [*KEYS, "signals"], "start", "end", 1)
    wins = F.avg((F.col("pnl") > 0).cast("double"))
    found = trades.groupBy(*KEYS, "signals", "n_signals").agg(
        F.count(F.lit(1)).alias("n_trades"), wins.alias("_wr"), F.avg("pnl").alias("_avg"), F.sum("pnl").alias("_sum"), F.avg((F.col("reason") == "TP").cast("double")).alias("_tp")
    ).where(F.col("n_trades") >= least)
    edge = F.col("_wr") * take - (1 - F.col("_wr")) * stop
    return found.select(
        *KEYS, "signals", "n_signals", "n_trades", F.round("_wr", 4).alias("win_rate"), F.round("_avg", 6).alias("avg_pnl"), F.round("_sum", 4).alias("total_pnl"), F.round("_tp", 3).alias("tp_rate"), F.round(edge, 6).alias("edge")
    )
