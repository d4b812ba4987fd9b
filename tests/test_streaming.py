"""Streams give what batches give."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import movements, resample, structure
from barloom.plans.pipeline import matrix, states_of
from barloom.sources.bars import latest
from barloom.streaming import bars as streaming
from barloom.streaming import live
from tests.oracle import DATA, connect, difference
from tests.test_bars import T0, make, walk

TICK = "symbol string, ts timestamp, price double, volume double, seq long"


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.table(name)


def test_bars(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=7 * i), float(i % 5), 1.0, i) for i in range(60)]
    ticks = spark.createDataFrame(rows, TICK)
    ticks.coalesce(1).unionByName(ticks.limit(3)).write.parquet(str(tmp_path / "in"))  # three ticks come twice
    found = run(streaming.stream_bars(spark.readStream.schema(TICK).parquet(str(tmp_path / "in")), "1H"), "stream_bars")
    batch = {tuple(r) for r in resample.ohlcv(ticks, "1H").collect()}
    got = {tuple(r) for r in found.collect()}
    assert got and got <= batch and len(got) >= len(batch) - 2  # the last bars wait for the watermark


def test_movements(spark, tmp_path):
    bars = structure.structure(make(spark, walk(160, 5)), {"1H": 3}).withColumn("ts", F.col("ts").cast("timestamp"))
    bars = bars.select("symbol", "tf", "ts", "open", "high", "low", "close", "bos_event", "choch_event").cache()
    schema = bars.schema
    times = [r.ts for r in bars.select("ts").orderBy("ts").collect()]
    for k in range(4):
        bars.where(F.col("ts").isin(times[40 * k : 40 * k + 40])).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    found = run(streaming.stream_movements(source, {"1H": 2.0}), "stream_moves")
    batch = {r.mov_id: (r.direccion, r.duracion_barras, r.cierre_tipo) for r in movements.movements(bars, {"1H": 2.0}).where("cierre_tipo != 'FIN_DATOS'").collect()}
    got = {r.mov_id: (r.direccion, r.duracion_barras, r.cierre_tipo) for r in found.collect()}
    assert got and {k: v for k, v in batch.items() if k in got} == got and len(got) >= len(batch) - 1


def test_upsert(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double, seq long"
    for k, close in enumerate((1.0, 2.0, 3.0)):
        rows = [("a", T0, close, k), (f"s{k}", T0, 5.0, k), ("b", T0 + timedelta(days=k), close, k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    table, found = str(tmp_path / "table"), {}
    for k in (0, 1, 1, 2):  # a batch that is run again changes nothing
        source = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}"))
        query = streaming.upsert_stream(source, table, str(tmp_path / f"ck{k}-{len(found)}"), schema)
        query.processAllAvailable()
        query.stop()
        found[len(found)] = sorted((r.symbol, r.ts, r.close) for r in streaming.stored_bars(spark, table, schema).collect())
    days = [("b", T0 + timedelta(days=k), float(k + 1)) for k in range(3)]
    wanted = lambda k: sorted([("a", T0, float(k + 1)), *[(f"s{i}", T0, 5.0) for i in range(k + 1)], *days[: k + 1]])
    assert list(found.values()) == [wanted(0), wanted(1), wanted(1), wanted(2)]


@pytest.mark.parametrize("n", [1, 4, 30, 260, 420])
def test_kept_series_equals_the_batch(spark, n):
    """Flags and structure of the last bar, from any order of the bars that the series keeps."""
    closes = walk(n, n)
    bars = make(spark, closes).cache()
    states, flags = states_of(bars, structure.structure(bars, {"1H": 4}))
    wanted = states.orderBy(F.desc("ts")).first().asDict()
    assert sorted(flags) == sorted(live.names())
    rows = [(r.ts, r.high, r.low, r.close) for r in bars.orderBy("ts").collect()]
    for keep, mixed in ((300, False), (300, True), (20, False), (20, True)):
        kept, r = live.Kept.new("1H", 4), random.Random(n)
        for at in range(0, n, 13):
            part = rows[at : at + 13]
            if mixed:
                r.shuffle(part)
                part = part[:5] + part[:2] + part[5:]  # some come twice
                kept.add(part[:6], keep)
                part = part[6:]
            kept.add(part, keep)
            kept = live.Kept.load(*kept.dump())
        assert kept.tip.flags() | kept.tip.categories() == {k: wanted[k] for k in (*flags, *live.CATEGORIES)} and kept.late == 0
        assert len(kept.bars) <= 2 * keep


def test_a_bar_from_before_the_kept_ones_is_counted():
    kept = live.Kept.new("1H", 2)
    bars = [(T0 + timedelta(hours=i), 2.0 + i, 1.0 + i, 1.5 + i) for i in range(40)]
    kept.add(bars[1:], 8)
    kept.add(bars[:1], 8)
    assert kept.late == 1 and kept.tip.n == 39
    kept.add([(*bars[-1][:3], 99.0)], 8)  # the last bar again, with another close
    assert kept.tip.n == 39 and kept.tip.close[-1] == 99.0


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_live_states_equal_the_batch(spark, tmp_path, batches):
    """After each number of batches, with a stored history and bars that come late."""
    tfs, swings = ["4H", "1H"], {"4H": 3, "1H": 3}
    base = make(spark, walk(500, 3)).drop("tf").unionByName(make(spark, walk(480, 4), "b").drop("tf"))
    bars = resample.all_timeframes(base, tfs).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    states, flags = states_of(bars, structure.structure(bars, swings))
    wanted = {r.symbol: r.asDict() for r in matrix(latest(states).select("symbol", "ts"), states, tfs, [*flags, *live.CATEGORIES]).collect()}
    number = F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("ts")) - 200
    part = F.least(F.floor(number / 60) + F.when((number % 7 == 3) & (number % 60 > 30), 1).otherwise(0), F.lit(batches - 1))
    dealt = bars.withColumn("part", F.when(number >= 0, F.greatest(part, F.lit(0))))
    for k in range(batches):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
        time.sleep(1.1)  # files are taken by their times
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = run(live.live_states(source, dealt.where("part is null").drop("part"), tfs, swings), f"live_{batches}", "update")
    rows = found.collect()
    last = {s: max((r for r in rows if r.symbol == s), key=lambda r: rows.index(r)).asDict() for s in "ab"}
    for s in "ab":
        assert last[s].pop("late") == 0
        assert last[s] == wanted[s]


def test_upsert_stream_reads_what_many_tasks_wrote(spark, tmp_path, monkeypatch):
    from barloom.plans import surface

    monkeypatch.setattr(surface, "place", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = surface.QUERIES["stream_upsert"](spark, f"{DATA}/sf0.001").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(list((tmp_path / "in").glob("part-*"))) == 8  # four tasks for each of two micro-batches
    assert difference(found, connect("sf0.001").sql(surface.ORACLE["stream_upsert"]).df()) == ""
