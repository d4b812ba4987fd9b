"""Sources, windows, joins and state machines on hand-made rows, against independent expectations."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.catalogue import MIN_MOVE_BARS
from barloom.functions import indicators as ind
from barloom.functions import tables
from barloom.functions.windows import carried, ewm, flag, in_blocks, rolling, with_position, with_run, with_runs
from barloom.operators import analysis, asof, hop, knn, mining, movements, outcomes, resample, signals, structure
from barloom.sources import bars as sources
from barloom.sources import paged, report
from barloom.stored import checkpoint

T0 = datetime(2024, 1, 1)
BAR = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def make(spark, closes, symbol="a", tf="1H", step=timedelta(hours=1), spread=0.5):
    rows, before = [], closes[0]
    for i, c in enumerate(closes):
        rows.append((symbol, tf, T0 + i * step, float(before), float(max(before, c) + spread), float(min(before, c) - spread), float(c), 1.0))
        before = c
    return spark.createDataFrame(rows, BAR)


def walk(n, seed=1):
    r = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(round(out[-1] * (1 + r.uniform(-0.02, 0.02)), 4))
    return out


@pytest.mark.parametrize("n", [1, 255, 256, 257, 600])
def test_ewm_equals_recursion(spark, n):
    closes = walk(n)
    df = ewm(with_position(make(spark, closes)), {"y": ("close", 8), "z": ("close", 26)}).orderBy("ts").toPandas()
    for name, span in (("y", 8), ("z", 26)):
        assert (df[name] - pd.Series(closes).ewm(span=span, adjust=False).mean()).abs().max() < 1e-9


def test_position_across_chunks(spark):
    df = with_position(make(spark, walk(50)), chunk_seconds=3600 * 7).orderBy("ts")
    assert [r.pos for r in df.collect()] == list(range(50))


def test_run_length(spark):
    values = [True, True, False, False, True, None]
    rows = [("a", "1H", T0 + timedelta(hours=i), v) for i, v in enumerate(values)]
    df = with_run(spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, b boolean"), "run", F.col("b"))
    assert [r.run for r in df.orderBy("ts").collect()] == [1, 2, 0, 0, 1, 0]


@pytest.mark.parametrize("chunk", [3600 * 7, 86_400 * 64])
def test_scans_across_chunks(spark, chunk):
    r = random.Random(5)
    held = [r.choice([True, True, True, False, None]) for _ in range(90)]
    rows = [("a", "1H", T0 + timedelta(hours=i + (40 if i > 50 else 0)), v, None if r.random() < 0.6 else i) for i, v in enumerate(held)]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, b boolean, x int")
    out = carried(carried(with_runs(df, {"run": F.col("b"), "not": ~F.col("b")}, chunk_seconds=chunk), {"upto": F.col("x")}, chunk_seconds=chunk), {"before": F.col("x")}, strict=True, chunk_seconds=chunk).orderBy("ts").collect()
    run = rest = 0
    last = None
    for (*_, v, x), row in zip(rows, out):
        run, rest = run + 1 if v else 0, rest + 1 if v is False else 0
        assert (row["run"], row["not"], row.before) == (run, rest, last)
        last = x if x is not None else last
        assert row.upto == last


def test_scans_leave_no_series_in_one_task(spark):
    plan = with_runs(with_position(make(spark, walk(30))), {"run": F.col("close") > F.col("open")})._jdf.queryExecution().executedPlan().toString()
    # rows are dealt by chunk; what is dealt by series alone has a row for each chunk
    assert "_chunk" in plan and plan.count("hashpartitioning(symbol#") > 0
    for line in plan.splitlines():
        if "hashpartitioning(symbol" in line and "_chunk" not in line.split("hashpartitioning")[1].split(")")[0]:
            assert "close" not in line


def test_zero_prices(spark):
    closes = [0.0, 0.0, 5.0, 0.0, 4.0, 3.0] + [0.0] * 30 + walk(60)
    df = with_position(make(spark, closes, spread=0.0)).cache()
    assert ind.fib_levels(df).count() == ind.ma_family(df).count() == len(closes)
    assert ind.all_indicators(df).where("dist_ema8_pct is null").count() > 0
    rows = signals.forward(df, (5,)).orderBy("ts").collect()
    assert [r.ret_5 is None for r in rows[:7]] == [True, True, False, True, False, False, True]
    assert signals.first_hit(df, hold=5).where("close = 0 and long is not null").count() == 0
    assert ind.ma_family(make(spark, [0.0] * 60, spread=0.0)).where("near_sma50 = 1").count() == 0


@pytest.mark.parametrize("block", [512, 1 << 14])
def test_indicators_in_blocks_equal_whole_series(spark, block):
    df = make(spark, walk(900, 8)).cache()
    whole = ind.fib_levels(checkpoint(ind.ma_family(checkpoint(ind.stochastic(checkpoint(ind.macd(df)))))))
    a = whole.select(*sorted(whole.columns)).orderBy("ts").toPandas()
    b = ind.all_indicators(df, block).select(*sorted(whole.columns)).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_rolling_warms_up(spark):
    df = make(spark, [1, 2, 3, 4]).withColumn("m", rolling(F.avg, F.col("close"), 3))
    assert [r.m for r in df.orderBy("ts").collect()] == [None, None, 2.0, 3.0]


def test_bucket_edges(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 23:59:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00"]
    ticks = spark.createDataFrame([("a", datetime.fromisoformat(t), float(i), 1.0, i) for i, t in enumerate(times)], "symbol string, ts timestamp_ntz, price double, volume double, seq long")
    label = lambda tf: [str(r.ts) for r in resample.ohlcv(ticks, tf).orderBy("ts").collect()]
    assert label("4H") == ["2024-01-01 00:00:00", "2024-01-01 04:00:00", "2024-01-02 00:00:00", "2024-01-08 00:00:00"]
    assert label("1W") == ["2024-01-08 00:00:00", "2024-01-15 00:00:00"]
    assert [str(r.ts) for r in resample.ohlcv(ticks, "1W", causal=False).orderBy("ts").collect()] == ["2024-01-01 00:00:00", "2024-01-08 00:00:00"]
    for tf in ("4H", "1D", "1W"):
        assert resample.ohlcv(ticks, tf).agg(F.sum("volume")).first()[0] == len(times)


def test_null_prices_do_not_open_a_bar(spark):
    ticks = spark.createDataFrame([("a", T0 + timedelta(seconds=i), p, 1.0, i) for i, p in enumerate([None, 5.0, 7.0, None])] + [("b", T0, None, 1.0, 9)], "symbol string, ts timestamp_ntz, price double, volume double, seq long")
    rows = resample.ohlcv(ticks, "1H").where("ts > '2024-01-01'").collect()
    assert [(r.symbol, r.open, r.close) for r in rows] == [("a", 5.0, 7.0)]


def test_flat_prices(spark):
    df = ind.stochastic(make(spark, [5.0] * 30, spread=0.0))
    assert df.where("stoch_K is not null").count() == 0
    assert ind.fib_levels(make(spark, [5.0] * 30, spread=0.0), mas=()).where("fib05_level is not null").count() == 0


def test_142_indicators(spark):
    df = ind.all_indicators(make(spark, walk(60)))
    new = [c for c in df.columns if c not in ("symbol", "tf", "ts", "open", "high", "low", "close", "volume", "pos")]
    assert len(new) == 142 and len(ind.flag_columns(df)) == 104


def test_upsert_keeps_new_then_latest(spark):
    schema = "symbol string, ts timestamp_ntz, close double, seq long"
    old = spark.createDataFrame([("a", T0, 1.0, 1), ("a", T0, 2.0, 2), ("b", T0, 3.0, 1)], schema)
    new = spark.createDataFrame([("a", T0, 9.0, 0)], schema)
    assert sorted((r.symbol, r.close) for r in sources.upsert(old, new).collect()) == [("a", 9.0), ("b", 3.0)]
    assert sorted((r.symbol, r.close) for r in sources.upsert(old, old.limit(0)).collect()) == [("a", 2.0), ("b", 3.0)]


def test_csv_and_missing_file(spark, tmp_path):
    (tmp_path / "X_1m.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:01:00,NaN,2,1,1,5\n")
    rows = sources.read_csv(spark, str(tmp_path / "X_1m.csv")).orderBy("ts").collect()
    assert [(r.symbol, r.open, r.close) for r in rows] == [("X", 1.0, 1.5), ("X", None, 1.0)]
    assert sources.read_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_json_pages(spark):
    page = json.dumps({"results": [{"t": 1704067200000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 3}], "next_url": None})
    row = sources.read_pages(spark.createDataFrame([(page,)], "value string"), "X").first()
    assert (row.symbol, str(row.ts), row.close) == ("X", "2024-01-01 00:00:00", 1.5)


def fake_fetch(url):
    pages = {"u/X": ([1704067200000], "u/X2"), "u/X2": ([1704067260000], None)}
    times, following = pages[url]
    return json.dumps({"results": [{"t": t, "o": 1, "h": 2, "l": 0, "c": 1, "v": 1} for t in times], "next_url": following})


def test_paged_source(spark):
    from barloom.sources.paged import BarPages

    spark.dataSource.register(BarPages)
    df = spark.read.format("bar_pages").option("fetch", "tests.test_bars:fake_fetch").option("symbols", "X").option("url", "u/{symbol}").option("pause", "0").load()
    assert df.count() == 2


def ranged_fetch(url):
    """Bars of whole minutes from start to stop, both counted, two on a page; what was asked for is written down."""
    name, start, stop, at, log = url.split("|")
    if at == start and log:
        with open(log, "a") as out:
            out.write(f"{name} {start} {stop}\n")
    times = [t for t in range(int(at), int(at) + 120_000, 60_000) if t <= int(stop)]
    following = f"{name}|{start}|{stop}|{times[-1] + 60_000}|{log}" if times and times[-1] + 60_000 <= int(stop) else None
    return json.dumps({"results": [{"t": t, "o": 1, "h": 2, "l": 0, "c": 1, "v": 1} for t in times], "next_url": following})


def test_paged_source_cuts_ranges_of_time(spark):
    spark.dataSource.register(paged.BarPages)
    options = {"fetch": "tests.test_bars:ranged_fetch", "symbols": "X, Y", "url": "{symbol}|{start}|{stop}|{start}|", "pause": "0", "width": str(5 * 60_000)}
    planned = [(T0, T0 + timedelta(minutes=12)), (T0 + timedelta(minutes=20), T0 + timedelta(minutes=23))]
    df = spark.read.format("bar_pages").options(**options, ranges=paged.ranges_option(planned)).load()
    assert df.rdd.getNumPartitions() == 8
    minutes = [*range(12), 20, 21, 22]
    assert sorted((r.symbol, (r.ts.replace(tzinfo=None) - T0).seconds // 60) for r in df.collect()) == [(s, m) for s in "XY" for m in minutes]


def test_paged_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(paged.BarPages)
    log = tmp_path / "asked"
    start = paged.milliseconds(T0)
    for minutes in (7, 7, 15):
        options = {"fetch": "tests.test_bars:ranged_fetch", "symbols": "X", "url": "{symbol}|{start}|{stop}|{start}|" + str(log), "pause": "0", "width": str(5 * 60_000), "start": str(start), "stop": str(start + minutes * 60_000)}
        stream = spark.readStream.format("bar_pages").options(**options).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.ts.replace(tzinfo=None) - T0).seconds // 60 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == list(range(15))
    asked = sorted({tuple((int(x) - start) // 60_000 for x in line.split()[1:]) for line in log.read_text().splitlines()})
    assert asked == [(0, 5), (5, 7), (7, 12), (12, 15)]  # nothing twice


def test_stored_series_need_no_exchange(spark, tmp_path):
    bars = make(spark, walk(40)).unionByName(make(spark, walk(30, 2), "b"))
    stored = sources.store_series(bars, "stored_series_test", str(tmp_path / "bars"), 4)
    out = ind._stoch_flags(stored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and out.count() == 70
    joined = stored.join(stored.groupBy("symbol", "tf").agg(F.max("close").alias("top")), ["symbol", "tf"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_table_functions(spark):
    assert tables.register_tables(spark) == ["hop_select", "movements"]
    rows = [("a", 0, 5), ("a", 3, 4), ("a", 5, 9), ("b", 1, 2), (None, 7, 8), (None, 7, 9), ("a", 6, 7), ("a", 9, 9)]
    df = spark.createDataFrame(rows, "g string, s int, e int")
    df.createOrReplaceTempView("some_intervals")
    got = spark.sql("SELECT * FROM hop_select(TABLE(some_intervals), 'g', 's', 'e', 0)").collect()
    assert sorted(map(str, got)) == sorted(map(str, hop.hop_select(df, ["g"], "s", "e").collect()))
    with pytest.raises(Exception, match="no column x"):
        spark.sql("SELECT * FROM hop_select(TABLE(some_intervals), 'g', 'x', 'e', 0)").collect()
    bars = structure.structure(make(spark, walk(200, 5)), {"1H": 3})
    bars.createOrReplaceTempView("some_bars")
    got = spark.sql("SELECT * FROM movements(TABLE(some_bars), 2.0D)").collect()
    assert sorted(map(str, got)) == sorted(map(str, movements.movements(bars, {"1H": 2.0}).collect())) and len(got) > 2


def test_missing_ranges(spark):
    bars = make(spark, [1, 2, 3])
    day = timedelta(days=1)
    assert sources.missing_ranges(bars, T0, T0 + timedelta(hours=2)) == []
    assert sources.missing_ranges(bars, T0 - 2 * day, T0 + day) == [(T0 - 2 * day, T0), (T0 + timedelta(hours=2), T0 + day)]
    assert sources.missing_ranges(bars.limit(0), T0, T0 + day) == [(T0, T0 + day)]


def test_json_state_keeps_nulls(spark):
    df = spark.createDataFrame([("a", float("nan"), 1)], "symbol string, x double, y int")
    assert json.loads(sources.state_json(df).first()[0]) == {"symbol": "a", "x": None, "y": 1}


@pytest.mark.parametrize("chunk", [86_400 * 32, 7200])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, chunk, strict):
    r = random.Random(3)
    left = [("ab"[r.randrange(2)], T0 + timedelta(minutes=r.randrange(600)), i) for i in range(80)]
    right = [("ab"[r.randrange(2)], T0 + timedelta(minutes=10 * i), None if i % 5 == 0 else float(i)) for i in range(60)]
    a = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, id int")
    b = spark.createDataFrame(right, "symbol string, rts timestamp_ntz, v double")
    got = {x.id: (x.m.rts, x.m.v) if x.m else None for x in asof.asof(a, b, ["symbol"], "ts", "rts", ["v"], "m", strict, chunk).collect()}
    for s, t, i in left:
        fits = [(rt, v) for rs, rt, v in right if rs == s and (rt < t if strict else rt <= t)]
        assert got[i] == (max(fits, key=lambda x: x[0]) if fits else None)


def test_asof_ties_take_the_largest(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(days=k), k) for k in (0, 40, 90)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("a", T0, 3, "x"), ("a", T0, 7, None), ("a", T0, 7, "b"), ("a", T0, 7, "a")], "k string, t timestamp, v int, w string")
    got = {r.id: (r.m.v, r.m.w) for r in asof.asof(left, right, ["k"], "t", "t", ["v", "w"], "m").collect()}
    assert got == {k: (7, "b") for k in (0, 40, 90)}  # also in chunks that hold no right row


def test_range_join_equals_brute_force(spark):
    r = random.Random(4)
    points = [("a" if r.random() < 0.7 else "b", T0 + timedelta(minutes=r.randrange(6000)), r.random()) for _ in range(300)]
    spans = [(k, r.choice("ab"), T0 + timedelta(minutes=r.randrange(6000)), r.randrange(-50, 4000)) for k in range(60)]
    left = spark.createDataFrame([(k, s, a, a + timedelta(minutes=n)) for k, s, a, n in spans], "id int, s string, a timestamp, z timestamp")
    right = spark.createDataFrame(points, "s string, t timestamp, x double")
    for seconds in (600, 3600, 86_400):
        got = {q.id: (q.hi, q.lo) for q in asof.in_range(left, right, "s", "a", "z", "t", seconds, {"hi": (F.max, "x"), "lo": (F.min, "x")}, ["id"]).collect()}
        wanted = {}
        for k, s, a, n in spans:
            own = [x for q, t, x in points if q == s and a <= t <= a + timedelta(minutes=n)]
            if own:
                wanted[k] = (max(own), min(own))
        assert got == wanted


def test_blocks_change_nothing(spark):
    df = with_position(make(spark, walk(150, 8)))
    step = lambda d: signals.forward(d.withColumn("m", rolling(F.avg, F.col("close"), 9)), (5, 7))
    wanted = sorted(map(str, step(df).collect()))
    for block in (9, 10, 64, 1000):
        assert sorted(map(str, in_blocks(df, step, before=8, after=7, block=block).select(step(df).columns).collect())) == wanted
    with pytest.raises(ValueError):
        in_blocks(df, step, before=8, block=4)


def test_signals_are_chosen_from_the_table(spark):
    rows = [("a", 600, 0.60, 0.1), ("b", 600, 0.56, 0.58), ("c", 10, 0.9, 0.9), ("d", 600, None, 0.2)]
    table = spark.createDataFrame(rows, "variable string, n int, wr_long_120 double, wr_short_120 double")
    assert signals.chosen_signals(table) == (["a"], ["b"])
    assert signals.chosen_signals(table.where("variable = 'b'"), win_rate=0.59) == (["b"], ["b"])
    assert signals.chosen_signals(table.limit(0)) == ([], [])


@pytest.mark.parametrize("chunk", [1, 7, 40, 1 << 16])
def test_hop_select_in_chunks_equals_streaming(spark, chunk):
    r = random.Random(chunk)
    for gap, longest in ((0, 6), (1, 90), (0, 400)):
        rows = [(g, s, s + r.randrange(0 if gap else 1, longest)) for g in ("a", "b", None) for s in r.choices(range(300), k=80)]
        wanted, free = [], {}
        for g, s, e in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
            if s >= free.get(g, -1):
                wanted.append((g, s, e))
                free[g] = e + gap
        df = spark.createDataFrame(rows, "g string, s int, e long").repartition(3)
        key = lambda x: (str(x[0]), x[1], x[2])
        assert sorted((tuple(x) for x in hop.hop_select(df, ["g"], "s", "e", gap, chunk).collect()), key=key) == sorted(wanted, key=key)


def test_hop_select_deals_one_group_to_many_tasks(spark):
    df = spark.range(64_000).selectExpr("'a' as g", "id as s", "id + 3 as e")
    out = hop.hop_select(df, ["g"], "s", "e", chunk=1000)
    assert [r.s for r in out.orderBy("s").collect()] == list(range(0, 64_000, 3))
    assert "hashpartitioning(g" in out._jdf.queryExecution().toString() and "_chunk" in out._jdf.queryExecution().toString()


def test_hop_select_is_greedy(spark):
    r = random.Random(4)
    rows = sorted((g, s, s + r.randrange(1, 9)) for g in "ab" for s in r.sample(range(100), 30))
    df = spark.createDataFrame(rows, "g string, s int, e int")
    for gap in (0, 1):
        wanted, free = [], {}
        for g, s, e in rows:
            if s >= free.get(g, -1):
                wanted.append((g, s, e))
                free[g] = e + gap
        assert sorted(tuple(x) for x in hop.hop_select(df, ["g"], "s", "e", gap).collect()) == wanted
    assert hop.hop_select(df.limit(0), ["g"], "s", "e").count() == 0


def test_swings_and_both_on_one_bar(spark):
    # one tall bar is a high and a low candidate; it is labelled as a low
    df = structure.swings(make(spark, [10, 10, 10, 10, 10, 10], spread=0.0).withColumns({"high": F.col("high"), "low": F.col("low")}), {"1H": 2})
    kinds = [r.swing_type for r in df.orderBy("ts").collect()]
    assert kinds == ["SL", "NONE", "SL", "NONE", "NONE", "NONE"]


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_swings_in_blocks(spark, block):
    df = make(spark, walk(300, 6)).cache()
    a, b = (structure.swing_candidates(df, {"1H": 4}, n).orderBy("ts").select("ts", "is_high", "is_low", "_known").collect() for n in (block, 1 << 20))
    assert a == b and sum(r.is_high for r in a) > 5


@pytest.mark.parametrize("seed", range(2))
def test_movements_in_chunks_equal_one_run(spark, seed):
    """Borders in every place: events and prices at random, chunks of 7 to 50 bars."""
    r = random.Random(seed)
    rows = []
    for symbol in "ab":
        price = 100.0
        for i in range(120):
            before, price = price, price * (1 + r.uniform(-0.02, 0.02))
            bos, choch = r.choice(["NONE"] * 8 + ["BOS_BULL", "BOS_BEAR"]), r.choice(["NONE"] * 12 + ["CHOCH_ALCISTA", "CHOCH_BAJISTA"])
            rows.append((symbol, "1H", T0 + timedelta(hours=i), before if i % 11 else None, max(before, price), min(before, price), None if i % 17 == 5 else price, bos, choch))
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, bos_event string, choch_event string").cache()
    for threshold in (1.5, 9.0):
        whole = sorted(tuple(x) for x in movements.movements(df, {"1H": threshold}).collect())
        direct = []
        for symbol in "ab":
            m, own = movements.Machine("1H", threshold), [x for x in rows if x[0] == symbol and x[6] is not None]
            for k, (_, _, ts, _, high, low, close, bos, choch) in enumerate(own):
                following = own[k + 1][3] if k + 1 < len(own) else None
                done = m.step(ts, high, low, close, close if following is None else following, bos, choch)
                direct += [(symbol, "1H", *done)] if done else []
            done = m.close(own[-1][2], own[-1][6], "FIN_DATOS") if m.direction else None
            direct += [(symbol, "1H", *done)] if done else []
        assert whole == sorted(direct)
        for chunk in (7, 50) if threshold == 1.5 else (13,):
            assert sorted(tuple(x) for x in movements.movements(df, {"1H": threshold}, chunk).collect()) == whole


@pytest.mark.parametrize("seed", range(5))
def test_first_reaching(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 9, int(rng.integers(1, 40))).astype(float)
    start, level = rng.integers(0, len(values) + 1, 200), rng.integers(0, 11, 200).astype(float)
    wanted = [next((j for j in range(s, len(values)) if values[j] >= x), len(values)) for s, x in zip(start, level)]
    assert signals.first_reaching(values, start, level).tolist() == wanted


@pytest.mark.parametrize("chunk", [3, 16, 1 << 16])
def test_first_hit_equals_brute_force(spark, chunk):
    closes = walk(90, 9)
    for hold in (1, 5, 40):
        got = signals.first_hit(with_position(make(spark, closes)), 0.015, 0.02, hold, chunk).orderBy("ts").collect()
        for i, row in enumerate(got):
            if i + hold >= len(closes):
                assert row.long is None and row.short is None
                continue
            for sign, hit in ((1, row.long), (-1, row.short)):
                win, lose = closes[i] * (1 + sign * 0.015), closes[i] * (1 - sign * 0.02)
                found = next(((k, price, why) for k in range(i + 1, i + hold + 1) for price, why, met in ((win, "TP", sign * closes[k] >= sign * win), (lose, "SL", sign * closes[k] <= sign * lose)) if met), (i + hold, closes[i + hold], "TIME"))
                assert (hit.exit, hit.price, hit.reason) == found


def test_quantile_by_histograms(spark):
    r = random.Random(2)
    for values in ([7], [3, 3, 3], [-5, 10**15, None, 2], [r.randrange(-(10**15), 10**15) for _ in range(400)], [r.randrange(9) for _ in range(50)], [None]):
        df = spark.createDataFrame([(v,) for v in values], "x long").repartition(3)
        for q in (0.0, 0.5, 0.75, 1.0):
            assert mining.quantile(df, "x", q) == df.agg(F.percentile("x", F.lit(q))).first()[0]
    known = sorted(r.randrange(10**6) for _ in range(300))
    assert mining.nth_values(spark.createDataFrame([(v,) for v in known], "x long"), "x", [0, 150, 299], bins=4) == [known[0], known[150], known[299]]


def machine(events, threshold=1e9):
    m = movements.Machine("1H", threshold)
    done = []
    for i, (high, low, close, bos, choch) in enumerate(events):
        row = m.step(i, high, low, close, close, bos, choch)
        if row:
            done.append((row[0], row[1], row[2], row[3], row[8], row[10]))
    return m, done


def test_machine_rules():
    quiet = (10, 9, 9.5, "NONE", "NONE")
    # an opposite break with too few bars drops the movement, its number is not used again, and the same bar opens anew
    m, done = machine([(10, 9, 9.5, "BOS_BULL", "NONE"), (10, 9, 9.5, "BOS_BEAR", "NONE"), quiet, quiet, (10, 9, 9.5, "NONE", "CHOCH_ALCISTA")])
    assert done == [("1H_2", "SHORT", 1, 4, 4, "CHOCH")] and m.opened == 3 and m.direction == "LONG"
    # exhaustion ends the bar: its change of character opens nothing
    m, done = machine([(10, 9, 9.5, "BOS_BULL", "NONE"), quiet, (20, 9, 5.0, "NONE", "CHOCH_BAJISTA")], threshold=10)
    assert done == [("1H_1", "LONG", 0, 2, MIN_MOVE_BARS, "AGOTAMIENTO")] and m.direction is None


def test_movement_open_at_the_end(spark):
    df = make(spark, [10.0] * 5, spread=0.0).withColumns({"bos_event": F.when(F.col("ts") == F.lit(T0), "BOS_BULL").otherwise("NONE"), "choch_event": F.lit("NONE")})
    assert [(r.cierre_tipo, r.duracion_barras) for r in movements.movements(df).collect()] == [("FIN_DATOS", 5)]


def test_outcome_edges(spark):
    schema = "symbol string, tf string, mov_id string, direccion string, timestamp_inicio timestamp_ntz, timestamp_fin timestamp_ntz, precio_inicio double, precio_fin double, precio_extremo double, magnitud_pct double, duracion_barras int, tf_parent_id string"
    far = T0 + timedelta(days=90)
    rows = [("a", "1H", "m1", "LONG", T0, T0 + timedelta(hours=3), 100.0, 101.0, 103.0, 3.0, 3, None), ("a", "1H", "m2", "SHORT", far, far, 0.0, 1.0, 1.0, 1.0, 3, "m1"), ("a", "1H", "open", "LONG", far, None, 1.0, None, 1.0, 0.0, 1, None)]
    found = {r.mov_id: r for r in outcomes.outcomes(spark.createDataFrame(rows, schema), make(spark, [100, 102, 103, 101])).collect()}
    assert set(found) == {"m1", "m2"}
    assert found["m1"].mfe_pct == 3.5 and found["m1"].continuacion == "REVERSION" and found["m1"].rebote_fib is None
    assert found["m2"].mfe_pct is None and found["m2"].fib_agotamiento is None and found["m2"].continuacion == "ULTIMO"


def test_first_hit_and_trades(spark):
    closes = [100, 101, 102, 99, 98, 97, 100, 100, 100, 100]
    df = signals.first_hit(with_position(make(spark, closes)), 0.015, 0.007, 3)
    rows = df.orderBy("ts").collect()
    assert (rows[0].long.exit, rows[0].long.reason) == (2, "TP") and (rows[2].long.exit, rows[2].long.reason) == (3, "SL")
    assert rows[6].long.reason == "TIME" and rows[7].long is None
    trades = signals.trade_cycle(with_position(make(spark, closes)), F.lit(True), F.lit(False), 0.015, 0.007, 3).orderBy("bar_entry").collect()
    assert [(t.bar_entry, t.bar_exit) for t in trades] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 9)]


def test_windows_are_nested_suffixes():
    assert mining.windows_of(100) == [(0, 60, 99), (1, 72, 99), (2, 84, 99), (3, 96, 99)]
    assert len(mining.windows_of(100, rolling=True)) == 5


def test_mode_takes_the_lowest(spark):
    rows = [("1H", "LONG", T0 + timedelta(hours=i), "CONTINUACION", 1.0, 1, 1.0, 1.0, x, x, 1) for i, x in enumerate([0.5, 0.236, 0.5, 0.236] * 3)]
    df = spark.createDataFrame(rows, "tf string, direccion string, timestamp_inicio timestamp_ntz, continuacion string, magnitud_pct double, duracion_min int, mfe_pct double, mae_pct double, rebote_fib double, fib_agotamiento double, up int")
    found = mining.mine(df, ["up"], holdout=False).collect()
    assert {r.rebote_fib_frecuente for r in found} == {0.236} and {r.n for r in found} == {12}


def test_classify_by_data(spark):
    df = spark.createDataFrame([(1, 0.0, "x", 5), (0, None, "y", 6)], "a int, b double, c string, d int")
    assert mining.classify(df, ["a", "b", "c", "d"]) == (["a", "b"], ["c"])


def test_knn_mask_and_limits(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(knn.mask_of(["a", "b", "c"])).collect()] == [1, 7]
    with pytest.raises(ValueError):
        knn.mask_of([str(i) for i in range(64)])


def test_pattern_key(spark):
    df = spark.createDataFrame([(0, True, -4.0, None), (3, None, 0.1, 1)], "a int, b boolean, dist_x double, c int")
    assert [r[0] for r in df.select(analysis.pattern_key(df, ["a", "b", "dist_x", "c"])).collect()] == ["b=1|dist_x=FAR_BELOW", "a=3|dist_x=AT|c=1"]


def test_flags_are_never_null(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "x double")
    assert [r[0] for r in df.select(flag(F.col("x") > 0)).collect()] == [0, 1]


def test_report(spark):
    df = spark.createDataFrame([("<b>", 0.5, None)], "a string, b double, c int")
    page = report.html_page("T", report.html_table(df, "x"), report.html_table(df.limit(0), "y"))
    assert "&lt;b&gt;" in page and "0.5000" in page and "No data." in page
    assert "pending" in report.match_text({"variable": "v", "value": "1", "tf": "1H", "direccion": "LONG", "n": 3, "winrate": 0.5, "wr_valid": None})


@pytest.mark.parametrize("rolling", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_robustness_of_very_few_rows(spark, n, rolling):
    rows = [("a", f"1H_{i}", "1H", "LONG", datetime(2024, 1, 1, i), "CONTINUACION", 1) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, mov_id string, tf string, direccion string, timestamp_inicio timestamp_ntz, continuacion string, up int")
    patterns = spark.createDataFrame([("up", "1", "LONG")], "variable string, value string, direccion string")
    assert all(0 <= a <= b < n for _, a, b in mining.windows_of(n, rolling=rolling))
    assert [(r.variable, r.wr_ventanas, r.robusto) for r in mining.robustness(df, ["up"], patterns, rolling=rolling).collect()] == [("up", None, False)]


def test_rows_of_a_section_without_data(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    page = report.html_page("T", report.html_table(df.limit(0), "none"), report.html_table(df, "two"))
    assert [report.table_rows(page, t) for t in ("none", "two")] == [0, 2]
