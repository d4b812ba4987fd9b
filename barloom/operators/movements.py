"""Directional movements: a state machine over structure events, and links between timeframes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.catalogue import EXHAUSTION, MIN_MOVE_BARS, MINUTES, ORDER, PARENT
from barloom.functions.windows import KEYS, with_position
from barloom.operators.asof import asof
from barloom.stored import checkpoint

OPENS = {"CHOCH_ALCISTA": "LONG", "CHOCH_BAJISTA": "SHORT", "BOS_BULL": "LONG", "BOS_BEAR": "SHORT"}
SCHEMA = (
    "symbol string, tf string, mov_id string, direccion string, timestamp_inicio {ts}, timestamp_fin {ts}, precio_inicio double, precio_fin double, precio_extremo double, "
    "magnitud_pct double, duracion_barras int, duracion_min int, cierre_tipo string"
)


@dataclass
class Machine:
    """The movement of one (symbol, tf) that is open, and what one more bar does to it.

    ``step`` returns the movement that the bar closes, if any; batch and stream share it.
    """

    tf: str
    threshold: float
    opened: int = 0
    direction: str | None = None
    start: Any = None
    price: float = 0.0
    extreme: float = 0.0
    bars: int = 0

    def close(self, ts: Any, close: float, kind: str) -> tuple | None:
        """The finished movement; None if it has too few bars."""
        sign = 1 if self.direction == "LONG" else -1
        size = round(sign * (self.extreme - self.price) / self.price * 100, 4) if self.price else 0.0
        row = (f"{self.tf}_{self.opened}", self.direction, self.start, ts, self.price, close, self.extreme, size, self.bars, self.bars * MINUTES.get(self.tf, 1), kind)
        self.direction = None
        return row if self.bars >= MIN_MOVE_BARS else None

    def open(self, direction: str, ts: Any, price: float, high: float, low: float) -> None:
        self.opened += 1
        self.direction, self.start, self.price, self.bars = direction, ts, price, 1
        self.extreme = high if direction == "LONG" else low

    def step(self, ts: Any, high: float, low: float, close: float, next_open: float, bos: str, choch: str) -> tuple | None:
        done = None
        if self.direction:
            long, before = self.direction == "LONG", self.extreme
            self.extreme = max(before, high) if long else min(before, low)
            self.bars += 1
            back = ((before - close) if long else (close - before)) / before * 100 if before > 0 else 0.0
            if before > 0 and back >= self.threshold and self.bars >= MIN_MOVE_BARS:
                self.extreme = before
                return self.close(ts, close, "AGOTAMIENTO")
            if OPENS.get(bos) not in (None, self.direction):
                done = self.close(ts, close, "BOS_CONTRARIO")
        if choch != "NONE":
            wanted = OPENS[choch]
            if self.direction and self.direction != wanted:
                done = self.close(ts, close, "CHOCH")
            if not self.direction:
                self.open(wanted, ts, next_open, high, low)
        elif not self.direction and bos != "NONE":
            self.open(OPENS[bos], ts, next_open, high, low)
        return done


NAMES = ["mov_id", "direccion", "timestamp_inicio", "timestamp_fin", "precio_inicio", "precio_fin", "precio_extremo", "magnitud_pct", "duracion_barras", "duracion_min", "cierre_tipo"]
#: What a chunk of bars hands on to the next: the open movement, all null if there is none.
STATE = ["direction", "start", "price", "extreme", "bars"]


def _machines(rows: DataFrame, thresholds: dict[str, float], finished: bool) -> DataFrame:
    """Runs the machine over each chunk of ``rows`` from the state that its rows come with.

    Gives the movements (``finished``), or for each chunk the state it leaves and how many movements it opened.
    A bar opens a movement at the next bar's opening price: the next chunk's first where the chunk ends.
    """
    ts = rows.schema["ts"].dataType.simpleString()
    source = rows.select(*KEYS, "_chunk", "ts", "open", "high", "low", "close", "bos_event", "choch_event", "_next", "_opened", *[f"_{n}" for n in STATE]).repartition(*KEYS, "_chunk").sortWithinPartitions(*KEYS, "_chunk", "ts")
    schema = SCHEMA.format(ts=ts) if finished else f"symbol string, tf string, _chunk long, opened long, direction string, start {ts}, price double, extreme double, bars int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        machine, waiting, after = Machine("", 0.0), None, None
        out: list[tuple] = []
        begun = 0
        kinds: list[pa.DataType] = []

        def step(next_open: float | None) -> None:
            t, high, low, close, bos, choch = waiting
            done = machine.step(t, high, low, close, close if next_open is None else next_open, bos, choch)
            if done and finished:
                out.append((*group[:2], *done))

        def end() -> None:
            if group is None:
                return
            step(after[1])
            if not finished:
                state = (machine.direction, machine.start, machine.price, machine.extreme, machine.bars) if machine.direction else (None,) * 5
                out.append((*group, machine.opened - begun, *state))
            elif after[0] and machine.direction:
                done = machine.close(waiting[0], waiting[3], "FIN_DATOS")
                if done:
                    out.append((*group[:2], *done))

        def table() -> pa.RecordBatch:
            moved = [pa.string(), pa.string(), pa.string(), pa.string(), *kinds, *kinds, *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.string()]
            types = moved if finished else [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *kinds, pa.float64(), pa.float64(), pa.int32()]
            names = ["symbol", "tf", *NAMES] if finished else ["symbol", "tf", "_chunk", "opened", *STATE]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names)
            out.clear()
            return batch

        for batch in batches:
            kinds = [batch.schema.field("ts").type]
            for symbol, tf, number, t, first, high, low, close, bos, choch, following, opened, *state in zip(*(c.to_pylist() for c in batch.columns)):
                if (symbol, tf, number) != group:
                    end()
                    group, begun = (symbol, tf, number), opened or 0
                    direction, start, price, extreme, count = state
                    machine = Machine(tf, thresholds.get(tf, 1.5), begun, direction, start, price or 0.0, extreme or 0.0, count or 0)
                else:
                    step(first)
                waiting, after = (t, high, low, close, bos, choch), (following is None, following and following["open"])
            yield table()
        end()
        if out:
            yield table()

    return source.mapInArrow(run, schema)


def movements(bars: DataFrame, thresholds: dict[str, float] = EXHAUSTION, chunk: int = 1 << 16) -> DataFrame:
    """Movements of each (symbol, tf) from bars with ``bos_event`` and ``choch_event``; bars without a close are skipped.

    A series is cut into chunks of ``chunk`` rows.  Each chunk is first run as if nothing were open at its start; where the
    chunk before leaves another state, it is run again from that one, until no state changes.  Runs from different states
    soon agree, for every movement closes, so few chunks are run more than twice; a movement that stays open takes one
    round for each chunk it spans.  Numbers are given at opening, so movements that are dropped for having too few bars leave gaps.
    """
    bars = bars if "pos" in bars.columns else with_position(bars)
    rows = checkpoint(bars.where("close is not null").select(*KEYS, F.floor(F.col("pos") / chunk).alias("_chunk"), "ts", "open", "high", "low", "close", "bos_event", "choch_event"))
    order = Window.partitionBy(*KEYS).orderBy("_chunk")  # a row for each chunk
    following = F.lead(F.struct("open")).over(order)
    chunks = rows.groupBy(*KEYS, "_chunk").agg(F.min_by("open", "ts").alias("open")).withColumn("_next", following).drop("open")
    nothing = {"direction": F.lit(None).cast("string"), "start": F.lit(None).cast(rows.schema["ts"].dataType), "price": F.lit(None).cast("double"), "extreme": F.lit(None).cast("double"), "bars": F.lit(None).cast("int")}
    chunks = checkpoint(chunks.withColumns({f"_{n}": x for n, x in nothing.items()}).withColumn("_opened", F.lit(0).cast("long")))
    if chunks.where("_next is not null").limit(1).count():
        left = checkpoint(_machines(rows.join(chunks.where("_next is not null"), [*KEYS, "_chunk"]), thresholds, False))
        while True:
            found = chunks.drop(*[f"_{n}" for n in STATE]).join(left, [*KEYS, "_chunk"], "left")
            known = found.select(*KEYS, "_chunk", "_next", *[F.lag(n).over(order).alias(f"_{n}") for n in STATE], F.coalesce(F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_opened"))
            state = F.struct(*[F.col(f"_{n}") for n in STATE])
            before = chunks.select(*KEYS, "_chunk", state.alias("_was"))
            marked = checkpoint(known.join(before, [*KEYS, "_chunk"]).withColumn("_moved", ~state.eqNullSafe(F.col("_was"))).drop("_was"))
            chunks, again = marked.drop("_moved"), marked.where("_moved and _next is not null").drop("_moved")
            if not again.limit(1).count():
                break
            anew = checkpoint(_machines(rows.join(again, [*KEYS, "_chunk"]), thresholds, False))
            left = checkpoint(left.join(again.select(*KEYS, "_chunk"), [*KEYS, "_chunk"], "left_anti").unionByName(anew))
    return _machines(rows.join(chunks, [*KEYS, "_chunk"]), thresholds, True)


def link_parents(moves: DataFrame, tfs: list[str] = ORDER) -> DataFrame:
    """``tf_parent_id``: the movement of the next higher timeframe that began last at or before the start, if it hasn't ended before it."""
    parent_of = F.create_map(*[F.lit(x) for tf in tfs if tf in PARENT for x in (tf, PARENT[tf])])
    left = moves.withColumn("_ptf", parent_of[F.col("tf")])
    right = moves.select("symbol", F.col("tf").alias("_ptf"), F.col("timestamp_inicio").alias("_start"), F.col("timestamp_fin").alias("_end"), F.col("mov_id").alias("_id"))
    found = asof(left, right, ["symbol", "_ptf"], "timestamp_inicio", "_start", ["_end", "_id"], "_p")
    valid = F.col("_p").isNotNull() & (F.col("_p._end").isNull() | (F.col("_p._end") >= F.col("timestamp_inicio")))
    return found.withColumn("tf_parent_id", F.when(valid, F.col("_p._id"))).drop("_p", "_ptf")


def snapshots(moves: DataFrame, states: DataFrame, columns: list[str]) -> DataFrame:
    """State at both ends of each movement, as structs ``at_start`` and ``at_end``, keyed by the movement's id.

    ``states``: symbol, ts and ``columns``.  Both ends are looked up in one pass; an open movement has no end.
    """
    ends = moves.select("symbol", "tf", "mov_id", F.explode(F.array(F.struct(F.lit("start").alias("_at"), F.col("timestamp_inicio").alias("_ts")), F.struct(F.lit("end").alias("_at"), F.col("timestamp_fin").alias("_ts")))).alias("_e"))
    ends = ends.select("symbol", "tf", "mov_id", "_e.*").where("_ts is not null").withColumnRenamed("_ts", "_probe")
    found = asof(ends, states, ["symbol"], "_probe", "ts", columns, "_state")
    side = lambda s: F.max(F.when(F.col("_at") == s, F.col("_state"))).alias(f"at_{s}")
    return moves.join(found.groupBy("symbol", "tf", "mov_id").agg(side("start"), side("end")), ["symbol", "tf", "mov_id"], "left")


def continuation(moves: DataFrame) -> DataFrame:
    """``continuacion``: whether the next movement of the timeframe goes the same way; ULTIMO for the last."""
    w = Window.partitionBy(*KEYS).orderBy("timestamp_inicio", "mov_id")
    following = F.lead("direccion").over(w)
    return moves.withColumn("continuacion", F.when(following.isNull(), "ULTIMO").when(following == F.col("direccion"), "CONTINUACION").otherwise("REVERSION"))


def aligned(moves: DataFrame) -> DataFrame:
    """``alineamiento_3tf``: the parent goes the same way, and so does the grandparent if there is one."""
    one = moves.select("symbol", F.col("mov_id").alias("tf_parent_id"), F.col("direccion").alias("_d1"), F.col("tf_parent_id").alias("_up"))
    two = moves.select("symbol", F.col("mov_id").alias("_up"), F.col("direccion").alias("_d2"))
    found = moves.join(one, ["symbol", "tf_parent_id"], "left").join(two, ["symbol", "_up"], "left")
    same = (F.col("_d1") == F.col("direccion")) & (F.col("_d2").isNull() | (F.col("_d2") == F.col("direccion")))
    return found.withColumn("alineamiento_3tf", F.coalesce(same, F.lit(False))).select(*moves.columns, "alineamiento_3tf")
