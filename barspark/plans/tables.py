"""Bar tables derived from the shared test tables, as DataFrames and as the same SQL.

The SQL texts are common table expressions for a second engine to check against.
Prices are cut to four decimals, so that both engines start from equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import change
from ..functions.frames import DAILY, Series, dealt, previous


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier as ticker, ship date as date.

    Order inside a day is one double per line, so that the grouping keeps fixed-width
    buffers and stays a hash aggregate with map-side combine.  There are no more bars than
    lines, whose number the file footers have; the bars are dealt out by ticker accordingly.
    """
    lines = table(spark, folder, "lineitem")
    line = lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10) / 10000).alias("px"))
    line = line.withColumn("ord", F.col("l_orderkey") * 8.0 + F.col("l_linenumber") + F.col("px") / 1000)
    bars = line.groupBy("ticker", "date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max(F.col("px") * (1 + F.col("l_tax"))).alias("high"),
        F.min(F.col("px") * (1 - F.col("l_discount"))).alias("low"),
        F.max_by("px", "ord").alias("close"),
        (F.sum("l_quantity") * 30000).cast("long").alias("volume"))
    return dealt(bars, lines.count(), ["ticker"])


BARS = """bars AS (
  SELECT ticker, date, arg_min(px, ord) AS open, max(px * (1 + l_tax)) AS high, min(px * (1 - l_discount)) AS low,
         arg_max(px, ord) AS close, CAST(sum(l_quantity) * 30000 AS BIGINT) AS volume
  FROM (SELECT *, l_orderkey * 8.0::DOUBLE + l_linenumber + px / 1000 AS ord
        FROM (SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
                     l_quantity, l_discount, l_tax, floor(l_extendedprice / l_quantity * 10) / 10000 AS px
              FROM lineitem) a) b
  GROUP BY ticker, date)"""


def bars_minute(spark: SparkSession, folder: str) -> DataFrame:
    """Event type as ticker, one bar per minute that has an event."""
    ev = table(spark, folder, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    ev = ev.withColumn("dt", F.date_trunc("minute", F.col("ts")))
    # microseconds into the minute, ties by id: one double, so the grouping stays a hash aggregate
    ev = ev.withColumn("ord", F.unix_micros("ts") - F.unix_micros("dt") + F.col("event_id") % 1000 / 1000.0)
    return ev.groupBy("ticker", "dt").agg(
        F.min_by("value", "ord").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ord").alias("close"), F.count(F.lit(1)).alias("volume"))\
        .withColumn("date", F.to_date("dt"))


MINUTES = """mins AS (
  SELECT ticker, dt, CAST(dt AS DATE) AS date, arg_min(value, ord) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ord) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM (SELECT event_type AS ticker, date_trunc('minute', ts) AS dt, value,
               epoch_us(ts) - epoch_us(date_trunc('minute', ts)) + event_id % 1000 / 1000.0::DOUBLE AS ord FROM events) a
  GROUP BY ticker, dt)"""

FIVES = """fives AS (
  SELECT ticker, time_bucket(INTERVAL '5 minutes', dt) AS dt, CAST(time_bucket(INTERVAL '5 minutes', dt) AS DATE) AS date,
         arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close,
         CAST(sum(volume) AS BIGINT) AS volume
  FROM mins GROUP BY 1, 2, 3)"""

RETS = """rets AS (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret_d,
         abs(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) AS abs_ret_d
  FROM bars)"""


def market(bars: DataFrame) -> DataFrame:
    """Mean daily return over all tickers: one row per date."""
    r = bars.select("date", change(F.col("close"), previous("close", DAILY)).alias("r"))
    return r.filter(F.col("r").isNotNull()).groupBy("date").agg(F.avg("r").alias("ret_m"))


MARKET = "market AS (SELECT date, avg(ret_d) AS ret_m FROM rets WHERE ret_d IS NOT NULL GROUP BY date)"

# Order priority -> factor name.
FACTOR_OF = {"1-URGENT": "mkt_rf", "2-HIGH": "smb", "3-MEDIUM": "hml", "4-NOT SPECIFIED": "rmw", "5-LOW": "cma"}


def factor_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Five factor columns in percent and a risk-free rate per date, as a factor library ships them."""
    means = (table(spark, folder, "orders")
             .select(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
             .groupBy("p", "date").agg(F.avg("o_totalprice").alias("m")))
    x = means.withColumn("x", change(F.col("m"), previous("m", Series(("p",), "date", 36_600))) * 100)
    return x.groupBy("date").agg(
        *[F.max(F.when(F.col("p") == p, F.col("x"))).alias(n) for p, n in FACTOR_OF.items()],
        F.lit(0.01).alias("rf"))


FACTORS = """facs AS (
  SELECT date, """ + ", ".join(f"max(CASE WHEN p = '{p}' THEN x END) AS {n}" for p, n in FACTOR_OF.items()) + """,
         0.01::DOUBLE AS rf
  FROM (SELECT p, date, (m / lag(m) OVER (PARTITION BY p ORDER BY date) - 1) * 100 AS x
        FROM (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS m
              FROM orders GROUP BY 1, 2) a) b
  GROUP BY date)"""


def recursive_means(source: str, keys: str, order: str, values: dict[str, tuple[str, int]], out: str,
                    name: str) -> str:
    """A table expression that adds exponentially weighted means to ``source`` (series up to 3 000 rows)."""
    pos = f"(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1)"
    cols = []
    for col, (value, span) in values.items():
        r = f"({span - 1}.0::DOUBLE / {span + 1}.0::DOUBLE)"
        a = f"(1.0::DOUBLE - {r})"
        cols.append(f"power({r}, p) * sum({value} * (CASE WHEN p = 0 THEN 1.0::DOUBLE ELSE {a} END)"
                    f" * power(1.0::DOUBLE / {r}, p)) OVER (PARTITION BY {keys} ORDER BY {order}) AS {col}")
    return (f"{name} AS (SELECT {out}, {', '.join(cols)} FROM (SELECT *, {pos} AS p FROM {source}) z)")
