"""The state of the last bar, kept bar by bar: what the indicators and the structure of a whole history say of its end.

A series keeps its exponential means, the last few hundred prices and distances, the lengths of its runs and its
last two swings of each kind, so a bar costs the same however long the history is.  A bar that comes late, within
the bars kept, is put in its place and the bars after it are worked on again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.catalogue import FIB_BARS, FIB_RATIOS, MA_SPANS, MACD_SPANS, NEAR_PCT, ORDER, STOCH_BARS, STOCH_HIGH, STOCH_LOW, STOCH_SMOOTH, SWING_BARS, ratio_name
from barloom.functions.windows import KEYS

CATEGORIES = ("estructura", "bos_event", "choch_event")
EMAS = tuple(n for n in MA_SPANS if n.startswith("ema"))
#: Bars that a late bar may be behind, by default.
KEEP = 256
STATE = "base string, tip string, bars array<struct<ts:timestamp,high:double,low:double,close:double>>, late long"


def names() -> list[str]:
    """The flags of a bar, in the order of the batch indicators."""
    out = ["macd_above_zero", "macd_line_above_zero", "macd_above_sig", "macd_e1_bull", "macd_e1_bear", "macd_e2_bull", "macd_e2_bear"]
    out += ["stoch_KD_above", "stoch_ob", "stoch_os", "stoch_A_bull", "stoch_A_bear", "stoch_B_bull", "stoch_B_bear"]
    for ma in MA_SPANS:
        out += [f"{p}_{ma}" for p in ("above", "near", "cross_bull", "cross_bear", "reject_bull", "reject_bear", "extreme_bull", "extreme_bear")]
    out += ["align_full_bull", "align_full_bear"]
    for ratio in FIB_RATIOS:
        f = f"fib{ratio_name(ratio)}"
        out += [f"{f}_{p}" for p in ("in_zone", "reject_bull", "reject_bear", "above")] + [f"{f}_conf_{ma}" for ma in MA_SPANS]
    return out


def _mean(values: list, n: int) -> float | None:
    """The mean of the last ``n`` values, summed in their order; None until all are there."""
    last = values[-n:]
    return None if len(last) < n or any(v is None for v in last) else float(np.add.accumulate(last)[-1]) / n


def _over(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and a > b


@dataclass
class Series:
    """What one (symbol, tf) hands from bar to bar; ``step`` takes a bar, ``flags`` tells of the last one."""

    tf: str
    swing: int
    n: int = 0
    means: dict[str, float] = field(default_factory=dict)
    high: list[float] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    close: list[float] = field(default_factory=list)
    raw: list[float | None] = field(default_factory=list)
    k: list[float | None] = field(default_factory=list)
    dist: dict[str, list[float | None]] = field(default_factory=lambda: {ma: [] for ma in MA_SPANS})
    mas: dict[str, float | None] = field(default_factory=dict)
    now: dict[str, float | None] = field(default_factory=dict)
    before: dict[str, float | None] = field(default_factory=dict)
    runs: dict[str, int] = field(default_factory=dict)
    free: dict[str, int] = field(default_factory=lambda: {"SH": 0, "SL": 0})
    swings: dict[str, list[float]] = field(default_factory=lambda: {"SH": [], "SL": []})

    def _exponential(self, name: str, span: int, x: float) -> float:
        a = 2.0 / (span + 1)
        self.means[name] = x if self.n == 0 else (1 - a) * self.means[name] + a * x
        return self.means[name]

    def step(self, high: float, low: float, close: float) -> None:
        fast, slow, signal = MACD_SPANS
        line = self._exponential("fast", fast, close) - self._exponential("slow", slow, close)
        hist = line - self._exponential("signal", signal, line)
        for values, x in ((self.high, high), (self.low, low), (self.close, close)):
            values.append(x)
            del values[: -max(FIB_BARS[self.tf] if self.tf in FIB_BARS else 0, *MA_SPANS.values(), self.swing + 1)]
        before, self.before = self.now, self.now
        top, bottom = max(self.high[-STOCH_BARS:]), min(self.low[-STOCH_BARS:])
        self.raw.append(100 * (close - bottom) / (top - bottom) if len(self.high) >= STOCH_BARS and top != bottom else None)
        self.k.append(_mean(self.raw, STOCH_SMOOTH))
        del self.raw[:-STOCH_SMOOTH], self.k[: -max(STOCH_SMOOTH, 3)]
        d = _mean(self.k, STOCH_SMOOTH)
        for ma in MA_SPANS:
            self.mas[ma] = self._exponential(ma, MA_SPANS[ma], close) if ma in EMAS else _mean(self.close, MA_SPANS[ma])
            value = self.mas[ma]
            self.dist[ma].append((close - value) / value * 100 if value else None)
            del self.dist[ma][:-200]
        self.now = {"hist": hist, "line": line, "over": int(line > self.means["signal"]), "delta": hist - before["hist"] if before else None, "d": d, "kd": int(_over(self.k[-1], d))}
        self.now |= {f"above_{ma}": int(_over(close, self.mas[ma])) for ma in MA_SPANS}
        k = self.k[-1]
        held = {"rising": _over(self.now["delta"], 0.0), "falling": _over(0.0, self.now["delta"]), "extreme": k is not None and (k > STOCH_HIGH or k < STOCH_LOW)}
        for name, true in held.items():
            self.runs[name] = self.runs.get(name, 0) + 1 if true else 0
        for ma in MA_SPANS:
            self.runs[ma] = self.runs.get(ma, 0) + 1 if before.get(f"above_{ma}") == self.now[f"above_{ma}"] else 1
        self.n += 1
        self._swing()

    def _swing(self) -> None:
        """Judges the bar that has just got as many bars after it as a swing needs."""
        at = self.n - 1 - self.swing
        if at < 0:
            return
        highs, lows = self.high[-self.swing - 1 : -1], self.low[-self.swing - 1 : -1]
        kind = None
        for side, true, at_free in (("SH", highs[0] == max(highs), self.free["SH"]), ("SL", lows[0] == min(lows), self.free["SL"])):
            if true and at >= at_free:
                self.free[side], kind = at + self.swing, side
        if kind:
            self.swings[kind] = [*self.swings[kind][-1:], highs[0] if kind == "SH" else lows[0]]

    def flags(self) -> dict[str, int]:
        now, before, close, high, low = self.now, self.before, self.close[-1], self.high[-1], self.low[-1]
        rises = lambda n: now[n] == 1 and not before.get(n)
        falls = lambda n: now[n] == 0 and before.get(n) == 1
        delta, last, k = now["delta"], before.get("delta"), self.k[-1]
        out: dict[str, Any] = {
            "macd_above_zero": now["hist"] > 0, "macd_line_above_zero": now["line"] > 0, "macd_above_sig": now["over"],
            "macd_e1_bull": last is not None and delta > 0 >= last, "macd_e1_bear": last is not None and delta < 0 <= last, "macd_e2_bull": rises("over"), "macd_e2_bear": falls("over"),
        }
        recent = [x for x in self.k[-3:] if x is not None]
        middle = k is not None and 30 <= k <= 70
        out |= {
            "stoch_KD_above": now["kd"], "stoch_ob": _over(k, STOCH_HIGH), "stoch_os": _over(STOCH_LOW, k), "stoch_A_bull": rises("kd") and any(x < STOCH_LOW for x in recent), "stoch_A_bear": falls("kd") and any(x > STOCH_HIGH for x in recent),
            "stoch_B_bull": rises("kd") and middle, "stoch_B_bear": falls("kd") and middle,
        }
        for ma, value in self.mas.items():
            dist, known = self.dist[ma][-1], [x for x in self.dist[ma] if x is not None]
            spread = float(np.std(known, ddof=1)) if len(known) >= 50 else None
            wide = spread is not None and dist is not None
            out |= {
                f"above_{ma}": now[f"above_{ma}"], f"near_{ma}": dist is not None and abs(dist) < NEAR_PCT, f"cross_bull_{ma}": rises(f"above_{ma}"), f"cross_bear_{ma}": falls(f"above_{ma}"),
                f"reject_bull_{ma}": value is not None and low <= value < close, f"reject_bear_{ma}": value is not None and high >= value > close, f"extreme_bull_{ma}": wide and dist > 2 * spread, f"extreme_bear_{ma}": wide and dist < -2 * spread,
            }
        chain = [close, *self.mas.values()]
        out |= {"align_full_bull": all(_over(a, b) for a, b in zip(chain, chain[1:])), "align_full_bear": all(_over(b, a) for a, b in zip(chain, chain[1:]))}
        bars = FIB_BARS.get(self.tf, 0)
        lo, hi = (min(self.low[-bars:]), max(self.high[-bars:])) if bars and self.n >= 5 else (0.0, 0.0)
        for ratio in FIB_RATIOS:
            level = lo + (hi - lo) * ratio if hi != lo else None
            near = lambda x: bool(level) and x is not None and (x - level if x > level else level - x) / level * 100 < NEAR_PCT  # noqa: B023, E731
            zone = bool(level) and abs((close - level) / level * 100) < NEAR_PCT
            f, has = f"fib{ratio_name(ratio)}", level is not None
            out |= {
                f"{f}_in_zone": zone, f"{f}_reject_bull": has and low <= level * (1 + NEAR_PCT / 100) and close > level,
                f"{f}_reject_bear": has and high >= level * (1 - NEAR_PCT / 100) and close < level, f"{f}_above": has and close > level, **{f"{f}_conf_{ma}": zone and near(x) for ma, x in self.mas.items()},
            }
        return {n: int(bool(v)) for n, v in out.items()}

    def categories(self) -> dict[str, str]:
        close, found = self.close[-1], {"estructura": "RANGO", "bos_event": "NONE", "choch_event": "NONE"}
        if len(self.swings["SH"]) == len(self.swings["SL"]) == 2:
            (psh, sh), (psl, sl) = self.swings["SH"], self.swings["SL"]
            if sh > psh and sl > psl:
                found = {"estructura": "ALCISTA", "bos_event": "BOS_BULL" if close > psh else "NONE", "choch_event": "CHOCH_BAJISTA" if close < sl else "NONE"}
            elif sh < psh and sl < psl:
                found = {"estructura": "BAJISTA", "bos_event": "BOS_BEAR" if close < psl else "NONE", "choch_event": "CHOCH_ALCISTA" if close > sh else "NONE"}
        return found


@dataclass
class Kept:
    """A series up to some bar (``base``), the bars since, and the series up to the last bar (``tip``)."""

    base: Series
    tip: Series
    bars: list[tuple[datetime, float, float, float]] = field(default_factory=list)
    late: int = 0

    @classmethod
    def new(cls, tf: str, swing: int) -> Kept:
        return cls(Series(tf, swing), Series(tf, swing))

    @classmethod
    def load(cls, base: str, tip: str, bars: list, late: int) -> Kept:
        return cls(Series(**json.loads(base)), Series(**json.loads(tip)), [tuple(b) for b in bars], late)

    def dump(self) -> tuple:
        return json.dumps(asdict(self.base)), json.dumps(asdict(self.tip)), self.bars, self.late

    def add(self, new: list[tuple[datetime, float, float, float]], keep: int) -> None:
        """Takes bars in, in any order: a bar of a known time replaces it; one from before the bars kept is counted as late and left out."""
        known = {b[0]: b for b in self.bars}
        first = self.bars[0][0] if self.bars and self.base.n else None
        fits = {b[0]: b for b in new if first is None or b[0] >= first}
        self.late += len({b[0] for b in new}) - len(fits)
        if not fits:
            return
        if self.bars and min(fits) <= self.bars[-1][0]:
            self.bars = [b for _, b in sorted((known | fits).items())]
            self.tip, ahead = Series(**json.loads(json.dumps(asdict(self.base)))), self.bars
        else:
            ahead = [b for _, b in sorted(fits.items())]
            self.bars += ahead
        for _, high, low, close in ahead:
            self.tip.step(high, low, close)
        while len(self.bars) > 2 * keep:
            for _, high, low, close in self.bars[:keep]:
                self.base.step(high, low, close)
            del self.bars[:keep]


def seeds(history: DataFrame, swings: dict[str, int] = SWING_BARS, keep: int = KEEP) -> DataFrame:
    """(symbol, tf and what is kept) of each series of stored bars: read once, in order, with a few hundred bars in memory."""
    source = history.where("high is not null and low is not null and close is not null").select(*KEYS, F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, None, []

        def table() -> pa.RecordBatch:
            bar = pa.struct([("ts", pa.timestamp("us", "UTC")), ("high", pa.float64()), ("low", pa.float64()), ("close", pa.float64())])
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(bar), pa.int64()]
            rows = [(*g, b, t, [dict(zip(("ts", "high", "low", "close"), x)) for x in bars], late) for g, (b, t, bars, late) in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], ["symbol", "tf", "base", "tip", "bars", "late"])

        for batch in batches:
            for symbol, tf, *bar in zip(*(c.to_pylist() for c in batch.columns)):
                if (symbol, tf) != group:
                    if held:
                        out.append((group, held.dump()))
                    group, held = (symbol, tf), Kept.new(tf, swings[tf])
                held.add([tuple(bar)], keep)
            yield table()
        if held:
            out.append((group, held.dump()))
        yield table()

    return source.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts").mapInArrow(run, f"symbol string, tf string, {STATE}")


class LiveProcessor(StatefulProcessor):
    """The kept series of one symbol, by timeframe; each batch gives the symbol's row of the state matrix as of its last bar."""

    def __init__(self, tfs: list[str], swings: dict[str, int], keep: int):
        self.tfs, self.swings, self.keep = tfs, swings, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "tf string", STATE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for row in initialState.itertuples(index=False):
            self.kept.updateValue((row.tf,), (row.base, row.tip, [_bar(b) for b in row.bars], int(row.late)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        series = {}
        for tf in self.tfs:
            own = found[found["tf"] == tf]
            held = Kept.load(*(x if i != 2 else [_bar(b) for b in x] for i, x in enumerate(self.kept.getValue((tf,))))) if self.kept.containsKey((tf,)) else Kept.new(tf, self.swings[tf])
            if len(own):
                bars = [(t.to_pydatetime(), float(h), float(l), float(c)) for t, h, l, c in zip(own["ts"], own["high"], own["low"], own["close"])]
                held.add([b for b in bars if b[1] == b[1] and b[2] == b[2] and b[3] == b[3]], self.keep)
                self.kept.updateValue((tf,), held.dump())
            if held.bars:
                series[tf] = held
        if series:
            out: dict[str, Any] = {"symbol": key[0], "ts": max(s.bars[-1][0] for s in series.values()), "late": sum(s.late for s in series.values())}
            for tf in self.tfs:
                state = series[tf].tip.flags() | series[tf].tip.categories() if tf in series else {}
                out |= {f"{tf}_{n}": state.get(n) for n in (*names(), *CATEGORIES)}
            frame = pd.DataFrame([out])
            flags = [f"{tf}_{n}" for tf in self.tfs for n in names()]
            yield frame.astype({f: "Int32" for f in flags})

    def close(self) -> None:
        pass


def _bar(bar: Any) -> tuple:
    ts, *prices = (bar["ts"], bar["high"], bar["low"], bar["close"]) if isinstance(bar, dict) else bar
    return (pd.Timestamp(ts).to_pydatetime(), *map(float, prices))


def live_states(bars: DataFrame, history: DataFrame | None = None, tfs: list[str] = ORDER, swings: dict[str, int] = SWING_BARS, keep: int = KEEP) -> DataFrame:
    """A stream of bars (symbol, tf, ts as a timestamp, high, low, close) as a stream of states: a row for each symbol and batch,
    with every timeframe's flags and structure as of the symbol's last bar, named timeframe_column.

    ``history`` is read once, before the first batch; afterwards a batch costs its own bars.  A bar up to ``keep`` bars
    behind the last one of its series still counts, and replaces an earlier one of its time; ``late`` tells how many came later than that.
    """
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [f"`{tf}_{n}` int" for tf in tfs for n in names()] + [f"`{tf}_{n}` string" for tf in tfs for n in CATEGORIES]
    order = [f"{tf}_{n}" for tf in tfs for n in (*names(), *CATEGORIES)]
    kinds = {c.split("`")[1]: c.split("` ")[1] for c in columns}
    schema = "symbol string, ts timestamp, late long, " + ", ".join(f"`{c}` {kinds[c]}" for c in order)
    start = seeds(history, swings, keep).groupBy("symbol") if history is not None else None
    source = bars.where(F.col("tf").isin(tfs)).select("symbol", "tf", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close")
    return source.groupBy("symbol").transformWithStateInPandas(LiveProcessor(tfs, swings, keep), schema, "Update", "None", initialState=start)
