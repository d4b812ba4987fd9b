"""Registered queries of sources, sinks, views, reports and streams, with their DuckDB SQL.

Sinks write to a new place in the folder that driver and executors share, and what was written is read back.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from barloom.catalogue import MIN_COUNT, MIN_COUNT_GLOBAL, MINUTES, PARENT
from barloom.functions import indicators as ind
from barloom.functions.tables import register_tables
from barloom.functions.windows import in_blocks, rolling, with_position
from barloom.operators import asof, mining, movements, resample, structure
from barloom.plans import pipeline, service
from barloom.plans.oracle import ALIGNED, HELD, LINK, MACD, REBOUND, STRUCT, bars, by_tf, excursion, flag, indicator_rows, machine, roll, run
from barloom.plans.oracle import ORACLE as _KNOWN
from barloom.plans.oracle import structure as structure_sql
from barloom.plans.queries import FLAGS, SWINGS, THRESHOLDS, events, flagged, orders, stated_legs
from barloom.sources import bars as sources
from barloom.sources.paged import BarPages, ranges_option
from barloom.sources.report import html_page, html_table, match_text, table_rows
from barloom.stored import checkpoint, shared_dir
from barloom.streaming import bars as streaming
from barloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__], ORACLE[function.__name__] = function, sql
        return function

    return add


def place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"


VALUES = "symbol, ts, open, high, low, close, volume"


@query(f"WITH {bars('e', '1H')} SELECT {VALUES} FROM b WHERE symbol = 'click'")
def csv_bars(spark, sf_dir):
    """Bars of one symbol written as CSV with a header, and read by the bar reader."""
    path, one = place(spark), events(spark, sf_dir, "1H").where("symbol = 'click'")
    sources.write_table(one.select(F.col("ts").cast("timestamp").alias("timestamp"), *sources.VALUES), path, None, "csv")
    return sources.read_csv(spark, path, "click").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {bars('o', '1D')} SELECT {VALUES} FROM b")
def parquet_table(spark, sf_dir):
    """A table stored by symbol, and read again."""
    path = place(spark)
    sources.write_table(orders(spark, sf_dir).drop("tf"), path)
    return sources.read_parquet(spark, path)


@query(f"WITH {bars('o', '1D')} SELECT symbol, ts, close, CASE WHEN close > open THEN volume END AS volume FROM b")
def json_table(spark, sf_dir):
    """A table stored as JSON, nulls and all."""
    path, df = place(spark), orders(spark, sf_dir)
    sources.write_table(df.select("symbol", "ts", "close", F.when(F.col("close") > F.col("open"), F.col("volume")).alias("volume")), path, None, "json")
    return sources.read_table(spark, path, "symbol string, ts timestamp_ntz, close double, volume double", "json")


@query(f"WITH {bars('e', '1H')} SELECT {VALUES} FROM b")
def json_pages(spark, sf_dir):
    """Bars as a service answers with them, one JSON text for each symbol and day, taken apart again."""
    df = events(spark, sf_dir, "1H").withColumn("ts", F.col("ts").cast("timestamp"))
    bar = F.struct(F.unix_millis("ts").alias("t"), *[F.col(v).alias(v[0]) for v in sources.VALUES])
    pages = df.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(F.collect_list(bar).alias("results"), F.lit(None).cast("string").alias("next_url"))).alias("value"))
    return sources.read_pages(pages, F.col("symbol")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS ts, value FROM events), x AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM e),
        held AS (SELECT min(ts) AS a, max(ts) AS z FROM e, x WHERE ts >= lo + INTERVAL 5 DAY AND ts < hi - INTERVAL 5 DAY)
    SELECT symbol, ts, value AS open, value AS high, value AS low, value AS close, 1.0::DOUBLE AS volume FROM e, held WHERE ts < a OR ts >= z"""
)
def paged_source(spark, sf_dir):
    """What the gap planner finds missing of the events, fetched page by page from a service over that table, a partition for each symbol and range of time."""
    spark.dataSource.register(BarPages)
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"))
    lo, hi = table.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz")).first()
    held = table.where((F.col("ts") >= lo + timedelta(days=5)) & (F.col("ts") < hi - timedelta(days=5)))
    missing = sources.missing_ranges(held, lo, hi + timedelta(days=1))
    symbols = ",".join(sorted(r[0] for r in table.select("symbol").distinct().collect()))  # what to ask the service for
    options = {"fetch": "barloom.plans.service:events_page", "symbols": symbols, "url": f"{sf_dir}/events.parquet?{{symbol}}&{{start}}&{{stop}}&0", "ranges": ranges_option(missing), "width": str(5 * 86_400_000), "pause": "0"}
    return spark.read.format("bar_pages").options(**options).load().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_KNOWN["hop_intervals"])
def sql_hop_intervals(spark, sf_dir):
    """The greedy choice of intervals as a table function of SQL."""
    register_tables(spark)
    df = with_position(events(spark, sf_dir, "15M")).withColumn("stop", F.col("pos") + 1 + F.floor(F.col("close") / 20).cast("long"))
    df.select("symbol", "pos", "stop").createOrReplaceTempView(view := f"intervals_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT symbol, pos, stop FROM hop_select(TABLE({view}), 'symbol', 'pos', 'stop', 1)")


@query(_KNOWN["movement_machine"])
def sql_movements(spark, sf_dir):
    """The movement machine as a table function of SQL."""
    register_tables(spark)
    formed = structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS)
    formed.createOrReplaceTempView(view := f"formed_{uuid.uuid4().hex}")
    parts = [f"SELECT * FROM movements(TABLE(SELECT * FROM {view} WHERE tf = '{tf}'), {limit})" for tf, limit in THRESHOLDS.items()]
    return spark.sql(" UNION ALL ".join(parts)).withColumn("magnitud_pct", F.round("magnitud_pct", 2))


@query(f"WITH {bars('e', '1H', '4H')} SELECT symbol, tf, ts, round({roll('avg', 'close', 50)}, 4) AS mean50, {roll('max', 'high', 14)} AS high14 FROM b")
def stored_series(spark, sf_dir):
    """Frames over bars that are stored in buckets by series: the windows need no exchange."""
    stored_bars = sources.store_series(events(spark, sf_dir, "1H", "4H"), f"bars_{uuid.uuid4().hex}", place(spark), 8)
    return stored_bars.select("symbol", "tf", "ts", F.round(rolling(F.avg, F.col("close"), 50), 4).alias("mean50"), rolling(F.max, F.col("high"), 14).alias("high14"))


@query(
    f"""WITH {bars('o', '1D')}, x AS (SELECT min(ts) AS a, max(ts) AS z FROM b)
    SELECT TIMESTAMP '1990-01-01' AS start, a AS stop FROM x WHERE TIMESTAMP '1990-01-01' < a - INTERVAL 1 DAY UNION ALL SELECT z, TIMESTAMP '2030-01-01' FROM x WHERE z < TIMESTAMP '2030-01-01' - INTERVAL 1 HOUR"""
)
def gap_ranges(spark, sf_dir):
    """What to fetch so that the daily bars cover forty years."""
    found = sources.missing_ranges(orders(spark, sf_dir), datetime(1990, 1, 1), datetime(2030, 1, 1))
    return spark.createDataFrame(found, "start timestamp_ntz, stop timestamp_ntz")


@query(
    f"""WITH {bars('e', '1H')}, g AS (SELECT symbol, count(*) AS n, max(close) AS top FROM b GROUP BY 1)
    SELECT '<h2>Bars</h2><table><thead><tr><th>symbol</th><th>n</th><th>top</th></tr></thead><tbody>' || string_agg('<tr><td>' || symbol || '</td><td>' || n || '</td><td>' || printf('%.4f', top) || '</td></tr>', '' ORDER BY symbol) || '</tbody></table>' AS html FROM g"""
)
def html_sink(spark, sf_dir):
    """A small result as an HTML table."""
    df = events(spark, sf_dir, "1H").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top")).orderBy("symbol")
    return spark.createDataFrame([(html_table(df, "Bars"),)], "html string")


@query(
    f"""{HELD} SELECT variable || '==' || value || coalesce('@' || tf, '') || '  ' || direccion || chr(10) || '  n=' || n || '  win rate ' || printf('%.3f', winrate) || '  validated ' ||
        CASE WHEN wr_valid IS NULL THEN 'pending' ELSE printf('%.3f', wr_valid) END || chr(10) AS block FROM good"""
)
def match_blocks(spark, sf_dir):
    """Patterns as the blocks of text that a match is shown as."""
    rows = mining.mine(stated_legs(spark, sf_dir), FLAGS).collect()  # as many as patterns pass validation
    return spark.createDataFrame([(match_text(r.asDict()),) for r in rows], "block string")


@query(
    f"""WITH {bars('e', '1H', '4H', '1D')}, c AS (SELECT tf, count(*) AS n FROM b GROUP BY 1), s AS (SELECT symbol, max(close) AS top FROM b GROUP BY 1)
    SELECT unnest(['Timeframes', 'Symbols']) AS title, unnest([(SELECT count(*) FROM c), (SELECT count(*) FROM s)]) AS n_rows, true AS whole"""
)
def report_page(spark, sf_dir):
    """A composed page: its sections, their rows, and whether every cell came through."""
    df = events(spark, sf_dir, "1H", "4H", "1D")
    parts = {"Timeframes": df.groupBy("tf").agg(F.count(F.lit(1)).alias("n")), "Symbols": df.groupBy("symbol").agg(F.max("close").alias("top"))}
    page = html_page("Bars", *[html_table(d, t) for t, d in parts.items()])
    rows = []
    for title, d in parts.items():
        body = page.split(f"<h2>{title}</h2>")[1].split("</table>")[0]
        rows.append((title, table_rows(page, title), all(f"<td>{r[0]}</td>" in body for r in d.collect())))
    return spark.createDataFrame(rows, "title string, n_rows long, whole boolean")


@query(f"WITH {bars('e', '1H')} SELECT unnest(['above_open', 'above_prev', 'long_range', 'upper_half', 'symbol', 'tf']) AS name, unnest(['flag', 'flag', 'flag', 'flag', 'category', 'category']) AS kind")
def classify_columns(spark, sf_dir):
    """Which columns are flags and which are categories, by their data."""
    df = flagged(events(spark, sf_dir, "1H"))
    flags, categories = mining.classify(df, [c for c in df.columns if c != "ts"])
    return spark.createDataFrame([(c, "flag") for c in flags] + [(c, "category") for c in categories], "name string, kind string")


@query(f"WITH {bars('e', '1H', '4H')} SELECT symbol, tf, max(high) AS max_high, max(low) AS max_low FROM b GROUP BY 1, 2")
def columns_by_pattern(spark, sf_dir):
    """Columns chosen by a pattern of their names."""
    df = events(spark, sf_dir, "1H", "4H")
    chosen = df.select(df.colRegex("`(high|low)`")).columns
    return df.groupBy("symbol", "tf").agg(*[F.max(c).alias(f"max_{c}") for c in chosen])


@query(f"WITH {bars('e', '1H', '4H')} SELECT symbol, ts, close FROM b WHERE tf = '1H' AND symbol IN (SELECT symbol FROM b WHERE tf = '4H' GROUP BY 1 HAVING max(high) > 300)")
def semi_join(spark, sf_dir):
    """Bars of the symbols that have gone high on a coarser timeframe."""
    df = events(spark, sf_dir, "1H", "4H")
    high = df.where("tf = '4H'").groupBy("symbol").agg(F.max("high").alias("top")).where("top > 300")
    return df.where("tf = '1H'").join(high, "symbol", "left_semi").select("symbol", "ts", "close")


@query(f"WITH {bars('e', '1H')} SELECT symbol, ts, open, close FROM b WHERE ts = (SELECT max(ts) FROM b WHERE symbol = 'view') AND symbol = 'view'")
def point_lookup(spark, sf_dir):
    """One bar by its key."""
    df = events(spark, sf_dir, "1H")
    at = df.where("symbol = 'view'").agg(F.max("ts")).first()[0]
    return sources.lookup(df, symbol="view", ts=at).select("symbol", "ts", "open", "close")


@query(f"WITH {bars('e', '1H', '1D')}, d AS (SELECT symbol, ts::DATE AS day, count(*) AS n_bars, max(high) AS top FROM b WHERE tf = '1H' GROUP BY 1, 2) SELECT symbol, count(*) AS n_days, sum(n_bars)::BIGINT AS n_bars, max(top) AS top FROM d GROUP BY 1")
def sql_views(spark, sf_dir):
    """The bars as views for SQL."""
    sources.register_views(events(spark, sf_dir, "1H", "1D"))
    return spark.sql("SELECT symbol, count(*) AS n_days, sum(n_bars) AS n_bars, max(top) AS top FROM (SELECT symbol, to_date(ts) AS day, count(*) AS n_bars, max(high) AS top FROM bars_1h GROUP BY 1, 2) GROUP BY 1")


@query(f"WITH {bars('o', '1W')} SELECT symbol, tf, ts - INTERVAL 7 DAY AS ts, open, high, low, close, volume FROM b")
def resample_week_start(spark, sf_dir):
    """Weeks labelled by their start."""
    return resample.ohlcv(sources.from_orders(spark, sf_dir), "1W", causal=False)


@query(f"WITH {bars('e', '1H')} SELECT symbol, ts, round({roll('avg', 'close', 50)}, 4) AS mean50, {roll('max', 'high', 14)} AS high14 FROM b")
def rolling_in_blocks(spark, sf_dir):
    """Bounded frames in blocks of a series, each with copies of the rows before it."""
    step = lambda d: d.select("*", F.round(rolling(F.avg, F.col("close"), 50), 4).alias("mean50"), rolling(F.max, F.col("high"), 14).alias("high14"))
    return in_blocks(with_position(events(spark, sf_dir, "1H")), step, before=49, block=64).select("symbol", "ts", "mean50", "high14")


MOVED = f"{STRUCT}, {machine(THRESHOLDS)}, done AS MATERIALIZED (SELECT *, symbol || '_' || mov_id AS id, CASE tf WHEN '1H' THEN '4H' WHEN '4H' THEN '1D' END AS ptf FROM mov)"


@query(f"{MOVED} SELECT m.symbol, m.mov_id, CASE WHEN p.timestamp_fin >= m.timestamp_inicio THEN p.mov_id END AS tf_parent_id FROM done m ASOF LEFT JOIN done p ON m.symbol = p.symbol AND m.ptf = p.tf AND m.timestamp_inicio >= p.timestamp_inicio")
def machine_parents(spark, sf_dir):
    """The state machine's movements, each linked to the one of the next higher timeframe that holds its start."""
    formed = structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS)
    moved = checkpoint(movements.movements(formed, THRESHOLDS))
    return movements.link_parents(moved, ["1D", "4H", "1H"]).select("symbol", "mov_id", "tf_parent_id")


def finished(df: DataFrame, spark: SparkSession, kind: str) -> DataFrame:
    """All that a stream gives for what its source holds now."""
    path = place(spark)
    started = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(kind).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query(f"WITH {bars('e', '1H')}, late AS (SELECT max(ts) - INTERVAL 1 MICROSECOND - INTERVAL 10 MINUTE AS upto FROM t_b) SELECT symbol, tf, ts, open, high, low, close, volume FROM b, late WHERE ts <= date_trunc('millisecond', upto)")
def stream_bars(spark, sf_dir):
    """Bars of a stream of ticks: windows, a watermark, repeated ticks dropped; those that the watermark has passed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticks = rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))
    return finished(streaming.stream_bars(ticks, "1H"), spark, "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_KNOWN["upsert_dedup"])
def stream_upsert(spark, sf_dir):
    """The upsert over two micro-batches into a table by month."""
    path, schema = place(spark), "symbol string, ts timestamp_ntz, price double, seq long"
    rows = sources.from_orders(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), "o_orderstatus"), "seq")
    for status in (True, False):
        part = rows.where((F.col("o_orderstatus") == "F") == status).select("symbol", "ts", "price", "seq")
        part.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(schema).parquet(f"{path}/in")
        started = streaming.upsert_stream(source, f"{path}/table", f"{path}/state", schema, "month")
        started.processAllAvailable()
        started.stop()
    return streaming.stored_bars(spark, f"{path}/table", schema).drop("part")


def _exhausted() -> str:
    """The moves' SQL with stochastic exits: daily bars, weekly ones as their context."""
    stoch = lambda a, b: f"""{b}1 AS (SELECT *, {roll('min', 'low', 14)} AS lo14, {roll('max', 'high', 14)} AS hi14 FROM {a}), {b}2 AS (SELECT *, 100 * (close - lo14) / nullif(hi14 - lo14, 0) AS raw FROM {b}1),
        {b}3 AS (SELECT *, {roll('avg', 'raw', 3)} AS k FROM {b}2), {b}4 AS (SELECT *, {roll('avg', 'k', 3)} AS k3 FROM {b}3)"""  # noqa: E731
    head = f"""{MACD}, {stoch('d', 'sd')}, {bars('o', '1W', name='q')}, {stoch('q', 'sw')}, j AS (SELECT sd4.*, sw4.k AS kw FROM sd4 ASOF LEFT JOIN sw4 ON sd4.symbol = sw4.symbol AND sd4.ts >= sw4.ts),
        {run('delta > 0', 'j', 'r1')}"""
    sql = _KNOWN["histogram_moves"].replace(f"{MACD}, {run('delta > 0', 'd', 'r1')}", head)
    for side, extreme in (("falling", "> 80"), ("rising", "< 20")):
        sql = sql.replace(f"v.{side} >= 5", f"coalesce((v.k {extreme} AND v.{side} >= 5) OR (v.kw {extreme} AND v.{side} >= 3), false)")
    return sql


def exhausted(spark: SparkSession, sf_dir: str) -> pipeline.Moves:
    ticks = sources.from_orders(spark, sf_dir)
    daily = checkpoint(ind.stochastic(ind.macd(resample.ohlcv(ticks, "1D"))))
    weekly = ind.stochastic(with_position(resample.ohlcv(ticks, "1W"))).select("symbol", F.col("ts").alias("week"), "stoch_ob", "stoch_os")
    df = asof.asof(daily, weekly, ["symbol"], "ts", "week", ["stoch_ob", "stoch_os"], "_w").withColumns({"context_ob": F.coalesce("_w.stoch_ob", F.lit(0)), "context_os": F.coalesce("_w.stoch_os", F.lit(0))})
    return pipeline.analyse_moves(checkpoint(df.drop("_w")), SIGNATURE, least_bars=5, least_pct=10.0, **pipeline.exhaustion())


SIGNATURE = ["macd_above_zero", "macd_line_above_zero", "stoch_KD_above", "stoch_ob"]


@query(_exhausted())
def exhausted_moves(spark, sf_dir):
    """Moves that end where the stochastic of their own or the next timeframe says that they are exhausted."""
    return exhausted(spark, sf_dir).moves.drop("tf")


def _signatures() -> str:
    parts = {"macd_above_zero": "hist > 0", "macd_line_above_zero": "line > 0", "stoch_KD_above": "k > k3", "stoch_ob": "k > 80"}
    key = " || ".join(f"CASE WHEN {condition} THEN '|{name}=1' ELSE '' END" for name, condition in parts.items())
    moves = _exhausted()
    cut = moves.rindex("SELECT symbol, direction, pos AS bar_start")
    one = lambda side, at: f"""SELECT '{side}' AS side, pattern, count(*) AS n, CASE WHEN 2 * count(*) FILTER (direction = 'LONG') >= count(*) THEN 'LONG' ELSE 'SHORT' END AS dominant_dir,
        round(greatest(count(*) FILTER (direction = 'LONG'), count(*) FILTER (direction = 'SHORT')) / count(*) * 100, 1) AS pct_aligned, round(round(median(abs(pct_move)), 3), 1) AS pct_move_med, round(round(avg(abs(pct_move)), 3), 1) AS pct_move_mean, round(round(median(mfe_pct), 3), 1) AS mfe_med, round(median(duration_hrs), 1) AS dur_hrs_med
        FROM (SELECT fin.*, coalesce(nullif(ltrim({key}, '|'), ''), 'NO_SIGNAL') AS pattern FROM fin JOIN v ON v.symbol = fin.symbol AND v.pos = fin.{at}) GROUP BY 2 HAVING count(*) >= 3"""  # noqa: E731
    return f"{moves[:cut].rstrip()}, fin AS MATERIALIZED ({moves[cut:]}) {one('entry', 'bar_start')} UNION ALL {one('exit', 'bar_end')}"


@query(_signatures())
def entry_exit_stats(spark, sf_dir):
    """Statistics of the signatures at the starts and at the ends of those moves."""
    found = exhausted(spark, sf_dir)
    both = found.entry.withColumn("side", F.lit("entry")).unionByName(found.exit.withColumn("side", F.lit("exit")))
    return both.withColumns({c: F.round(c, 1) for c in ("pct_move_med", "pct_move_mean", "mfe_med")})


def in_batches(df: DataFrame, parts: int, path: str) -> DataFrame:
    """A stream of ``df``, one micro-batch for each value of its column ``part``."""
    stored_rows = checkpoint(df)
    for k in range(parts):
        stored_rows.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{path}/in/k={k}")
        time.sleep(1.1)  # files are taken by their times, which may count in seconds
    return df.sparkSession.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """``df`` with ``part``: as many stretches of each series, of which one bar in seven of the last 40 comes a stretch too late."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "tf"))
    size = F.ceil(n / parts)
    place = (F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("ts")) - 1).cast("long")
    late = (place % 7 == 3) & (place % size >= size - 40)
    return df.withColumn("part", F.least(F.floor(place / size) + late.cast("int"), F.lit(parts - 1)))


def _live(source: str, tfs: list[str], sizes: dict[str, int]) -> str:
    ctes, flags, _, _ = indicator_rows(source, *tfs)
    last = "x AS MATERIALIZED (SELECT r_last.*, st.estructura, st.bos_event, st.choch_event FROM r_last JOIN st USING (symbol, tf, pos) QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY pos DESC) = 1)"
    columns = [f'max(CASE WHEN tf = \'{tf}\' THEN {flag(c)} END) AS "{tf}_{n}"' for tf in tfs for n, c in flags.items()]
    columns += [f'max(CASE WHEN tf = \'{tf}\' THEN {c} END) AS "{tf}_{c}"' for tf in tfs for c in live.CATEGORIES]
    return f"{ctes}, {structure_sql(sizes)}, {last} SELECT symbol, max(ts) AS ts, 0::BIGINT AS late, {', '.join(columns)} FROM x GROUP BY 1"


@query(_live("o", ["1W", "1D"], {"1W": 3, "1D": 4}))
def live_state(spark, sf_dir):
    """Flags and structure of each symbol's last bar, kept bar by bar: half of the bars as history, the rest in three micro-batches, some late."""
    path, tfs = place(spark), ["1W", "1D"]
    bars_ = resample.all_timeframes(sources.from_orders(spark, sf_dir), tfs).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = checkpoint(dealt(bars_, 6))
    stream = in_batches(cut.where("part >= 3").withColumn("part", F.col("part") - 3), 3, path)
    states = live.live_states(stream, cut.where("part < 3").drop("part"), tfs, {"1W": 3, "1D": 4})
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*states.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out")
    last = Window.partitionBy("symbol").orderBy(F.desc("batch"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    f"""{STRUCT}, {machine(THRESHOLDS)}, ends AS (SELECT symbol, tf, max(ts) AS ts FROM b GROUP BY 1, 2) SELECT symbol, tf, mov_id, direccion, timestamp_inicio, timestamp_fin, duracion_barras, cierre_tipo
    FROM mov JOIN ends USING (symbol, tf) WHERE cierre_tipo <> 'FIN_DATOS' AND timestamp_fin < ts"""
)
def stream_machine(spark, sf_dir):
    """The movement machine with state over three micro-batches: all movements but those that the last bar, whose successor isn't there yet, would end."""
    path = place(spark)
    formed = structure.structure(events(spark, sf_dir, "1H", "4H", "1D"), SWINGS).withColumn("ts", F.col("ts").cast("timestamp"))
    slim = formed.select("symbol", "tf", "ts", "open", "high", "low", "close", "bos_event", "choch_event")
    n, number = F.count(F.lit(1)).over(Window.partitionBy("symbol", "tf")), F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("ts")) - 1
    stream = in_batches(slim.withColumn("part", F.floor(number * 3 / n)), 3, path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = finished(streaming.stream_movements(stream, THRESHOLDS), spark, "append")
    return found.select("symbol", "tf", "mov_id", "direccion", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("timestamp_inicio", "timestamp_fin")], "duracion_barras", "cierre_tipo")


ANALYSED = ["1D", "4H", "1H"]


def _analysed() -> str:
    """The whole chain in SQL, to ``good``: movements of the machine, outcomes, every flag and category of all timeframes at their starts, mining."""
    ctes, flags, _, _ = indicator_rows("e", *ANALYSED)
    legs = f"legs AS MATERIALIZED (SELECT * REPLACE (symbol || '_' || mov_id AS mov_id, round_even(magnitud_pct, 4) AS magnitud_pct), duracion_barras * {by_tf(MINUTES, str)} AS duracion_min FROM mov)"
    linked = f"lp AS (SELECT *, {by_tf({a: repr(b) for a, b in PARENT.items()}, str)} AS ptf FROM legs), {LINK}"
    columns = lambda tf: [f'{flag(c)} AS "{n}"' for n, c in flags.items()]
    states = ", ".join(f"s_{tf} AS MATERIALIZED (SELECT r_last.symbol, r_last.ts, {', '.join(columns(tf))}, st.estructura, st.bos_event, st.choch_event FROM r_last JOIN (SELECT symbol, tf, pos, estructura, bos_event, choch_event FROM st) st USING (symbol, tf, pos) WHERE tf = '{tf}')" for tf in ANALYSED)
    said = lambda tf: [f"CASE WHEN s_{tf}.\"{n}\" = 1 THEN {{variable: '{tf}_{n}', value: '1'}} END" for n in flags] + [f"CASE WHEN s_{tf}.{c} NOT IN ('NONE', 'ULTIMO') THEN {{variable: '{tf}_{c}', value: s_{tf}.{c}}} END" for c in live.CATEGORIES]
    joins = " ".join(f"ASOF LEFT JOIN s_{tf} ON o1.symbol = s_{tf}.symbol AND o1.timestamp_inicio >= s_{tf}.ts" for tf in ANALYSED)
    stated = f"stated AS (SELECT o1.*, unnest([{', '.join(x for tf in ANALYSED for x in said(tf))}]) AS v FROM o1 {joins} WHERE continuacion <> 'ULTIMO')"
    least = by_tf({tf: MIN_COUNT[tf] for tf in ANALYSED}, str).replace(" END", f" ELSE {MIN_COUNT_GLOBAL} END")
    return f"""{ctes}, {structure_sql(SWINGS)}, {machine(THRESHOLDS)}, {legs}, {linked}, {excursion("(SELECT * FROM b WHERE tf = '1H')")}, {REBOUND}, {ALIGNED},
    o1 AS MATERIALIZED (SELECT linked.*, mfe_pct, CASE WHEN n2 IS NULL THEN 'ULTIMO' WHEN n2 = direccion THEN 'CONTINUACION' ELSE 'REVERSION' END AS continuacion
        FROM (SELECT *, lead(direccion) OVER (PARTITION BY symbol, tf ORDER BY timestamp_inicio, mov_id) AS n2 FROM linked) linked JOIN exc USING (mov_id)),
    {states}, {stated}, judged AS (SELECT * FROM o1 WHERE continuacion <> 'ULTIMO'), cut AS (SELECT quantile_cont(epoch_us(timestamp_inicio)::DOUBLE, 0.75) AS c FROM judged),
    timed AS MATERIALIZED (SELECT v.variable AS variable, v.value AS value, tf, direccion, (continuacion = 'CONTINUACION')::INT::DOUBLE AS win, epoch_us(timestamp_inicio) <= c AS early FROM stated, cut WHERE v IS NOT NULL),
    sets AS (SELECT variable, value, tf, direccion, count(*) AS n, avg(win) AS winrate, count(*) FILTER (early) AS n_train, avg(win) FILTER (early) AS wr_train, avg(win) FILTER (NOT early) AS wr_valid FROM timed GROUP BY GROUPING SETS ((variable, value, direccion), (variable, value, tf, direccion))),
    mined AS (SELECT *, {least} AS least FROM sets WHERE n >= {least}), held AS (SELECT *, n - n_train < greatest(3, floor(least / 5)) AS pending FROM mined WHERE n_train >= least),
    good AS MATERIALIZED (SELECT variable, value, tf, direccion, n, winrate, wr_train, CASE WHEN NOT pending THEN wr_valid END AS wr_valid, CASE WHEN pending THEN 'PENDIENTE_VALIDACION' ELSE 'VALIDADO' END AS estado FROM held WHERE pending OR (wr_valid >= 0.55 AND wr_train - wr_valid <= 0.10))"""


def analysed(spark: SparkSession, sf_dir: str) -> pipeline.Result:
    return pipeline.analyse(sources.from_events(spark, sf_dir), ANALYSED, swings=SWINGS, exhaustion=THRESHOLDS)


@query(f"{_analysed()} SELECT variable, value, tf, direccion, n, round(winrate, 4) AS winrate, round(wr_train, 4) AS wr_train, round(wr_valid, 4) AS wr_valid, estado FROM good")
def analysed_patterns(spark, sf_dir):
    """The patterns of the whole chain: from ticks to what the state matrix of all timeframes says of the movements' starts."""
    found = analysed(spark, sf_dir).patterns
    return found.select(*mining.PATTERN, "n", *[F.round(c, 4).alias(c) for c in ("winrate", "wr_train", "wr_valid")], "estado")


@query(
    f"""{_analysed()}, d AS (SELECT count(DISTINCT (tf, direccion)) AS c FROM legs), g AS (SELECT count(*) AS c FROM good)
    SELECT unnest(['Movements', 'Outcomes', 'Patterns']) AS title, unnest([(SELECT c FROM d), (SELECT c FROM d), least((SELECT c FROM g), 500)]) AS n_rows"""
)
def analysis_report(spark, sf_dir):
    """The report of the whole chain: sections of its page and their rows."""
    page = pipeline.report(analysed(spark, sf_dir))
    rows = [(t, table_rows(page, t)) for t in ("Movements", "Outcomes", "Patterns")]
    return spark.createDataFrame(rows, "title string, n_rows long")
