"""Reading, shaping and keeping bar series: (symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalogue import ORDER

VALUES = ("open", "high", "low", "close", "volume")
CSV_SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume double"
BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
PAGE_SCHEMA = "results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>, next_url string"


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column; no operator here sees NaN."""
    kinds = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in kinds}) if kinds else df


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of CSV files with a header; the symbol is given or the file name up to its last underscore.  A path without files gives no bars."""
    try:
        raw = spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)
        name = F.lit(symbol) if symbol else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_[^_]*\.csv", 1)
        raw = raw.select(name.alias("symbol"), F.col("timestamp").alias("ts"), *VALUES)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], BAR_SCHEMA)
    return no_nan(raw.where("ts is not null"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return no_nan(spark.read.parquet(path))


def read_pages(pages: DataFrame, symbol: str | Column, column: str = "value") -> DataFrame:
    """Bars of JSON answers, one in each row of ``column``: results of {t, o, h, l, c, v} with t in milliseconds."""
    bar = F.explode(F.from_json(F.col(column), PAGE_SCHEMA)["results"]).alias("r")
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    return pages.select(name.alias("symbol"), bar).select("symbol", F.timestamp_millis("r.t").alias("ts"), *[F.col(f"r.{v[0]}").alias(v) for v in VALUES])


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks (symbol, ts, price, volume, seq) of the events table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the orders table, one symbol for each priority."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("seq")
    )


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Both, with one bar for each key: that of ``new`` where it has one.

    Of repeated bars within an input the one with the largest ``seq`` stays, if there is such a column, then
    the one with the largest values, column by column.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = [c for c in ("_new", "seq") if c in both.columns]
    order = F.struct(*first, *[c for c in both.columns if c not in first])
    row = F.struct(*[c for c in both.columns if c != "_new"])
    return both.groupBy(*keys).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def time_range(bars: DataFrame, start: str, end: str, parity: bool = False) -> DataFrame:
    """Bars from the day ``start`` to the day ``end``, which counts whole; with ``parity`` only its midnight does."""
    kind = bars.schema["ts"].dataType.simpleString()
    low, high = F.lit(start).cast(kind), F.lit(end).cast(kind)
    return bars.where((F.col("ts") >= low) & ((F.col("ts") <= high) if parity else (F.col("ts") < high + F.expr("interval 1 day"))))


def missing_ranges(bars: DataFrame, start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """What to fetch so that ``bars`` cover the range: a past part if it begins over a day late, a later part if it ends over an hour early."""
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [(start, end)]
    out = []
    if start < first - timedelta(days=1):
        out.append((start, first))
    if last < end - timedelta(hours=1):
        out.append((last, end))
    return out


def latest(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last row of each key by time; no sort, one partial aggregate."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "ts").alias("_r")).select("_r.*")


def write_table(df: DataFrame, path: str, partition: str | None = "symbol", kind: str = "parquet", mode: str = "overwrite") -> None:
    """A table as parquet, CSV or JSON (nulls written as null)."""
    writer = df.write.mode(mode)
    if partition and kind == "parquet":
        writer = writer.partitionBy(partition)
    if kind == "csv":
        writer = writer.option("header", True)
    if kind == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(kind).save(path)


def store_series(bars: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """``bars`` as the table ``name`` under ``path``, in buckets by (symbol, tf), sorted by time, a file each; read back.

    Windows over a series and joins on (symbol, tf) need no exchange of such a table, however often it is read.
    """
    dealt = bars.repartition(buckets, "symbol", "tf")
    dealt.write.mode("overwrite").bucketBy(buckets, "symbol", "tf").sortBy("symbol", "tf", "ts").option("path", path).saveAsTable(name)
    return bars.sparkSession.table(name)


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A stored result table as parquet, CSV or JSON."""
    reader = spark.read.schema(schema)
    return no_nan((reader.option("header", True) if kind == "csv" else reader).format(kind).load(path))


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The rows of one key; the filter reaches a stored table's files."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def register_views(rows: DataFrame, prefix: str = "bars") -> list[str]:
    """A temporary view for SQL of each timeframe, named prefix_timeframe, and one of all of them."""
    rows.createOrReplaceTempView(prefix)
    names = [prefix]
    for tf in ORDER:
        rows.where(F.col("tf") == tf).createOrReplaceTempView(f"{prefix}_{tf.lower()}")
        names.append(f"{prefix}_{tf.lower()}")
    return names


def state_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, NaN and null as null."""
    return no_nan(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
