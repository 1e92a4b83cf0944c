"""Feed files to tables, and a second run that has nothing to do."""

import datetime
import gzip

from pyspark.sql import functions as F

from barspark.plans import pipelines
from barspark.sources.datasets import market_data

HEADER = "ticker,volume,open,high,low,close,window_start\n"


def ns(day, minute=0):
    t = datetime.datetime(2024, 1, 1, 14, 30, tzinfo=datetime.timezone.utc) + datetime.timedelta(days=day, minutes=minute)
    return int(t.timestamp()) * 1_000_000_000


def line(ticker, day, price, minute=0):
    return f"{ticker},800000,{price},{price + 0.3},{price - 0.2},{price},{ns(day, minute)}\n"


def test_feed_to_tables(spark, tmp_path):
    daily, minute, root = tmp_path / "day", tmp_path / "minute", str(tmp_path / "tables")
    daily.mkdir()
    minute.mkdir()
    names = ["AAA", "BBB", "CCCCW"]
    for d in range(70):
        with gzip.open(daily / f"d{d}.csv.gz", "wt") as f:
            f.write(HEADER + "".join(line(n, d, 4.0 + (d * 7 + i) % 5) for i, n in enumerate(names)))
    for d in (68, 69):
        with gzip.open(minute / f"d{d}.csv.gz", "wt") as f:
            f.write(HEADER + "".join(line(n, d, 4.0 + (m * 3 + i) % 4, m) for m in range(60) for i, n in enumerate(names)))
    pipelines.build_daily(spark, str(daily), root)
    pipelines.build_minute(spark, str(minute), root)
    for step in pipelines.STEPS.values():
        step(spark, root)
    pipelines.build_filtered(spark, root, 0.5)
    tables = market_data(root)
    assert tables.load(spark, "daily").filter("ticker = 'CCCCW'").count() == 0
    assert tables.load(spark, "daily").count() == 140
    assert tables.load(spark, "scoring_index").count() == 2
    assert tables.load(spark, "filtered").select("ticker").distinct().count() == 2
    assert tables.load(spark, "technical").filter(F.col("sma_50").isNotNull()).count() == 2 * 21
    assert spark.read.parquet(f"{root}/minute_features.parquet").count() == 4
    assert spark.read.parquet(f"{root}/events.parquet").count() > 0
    before = spark.read.parquet(f"{root}/macd_day_features.parquet").inputFiles()
    pipelines.build_macd_day(spark, root)
    assert sorted(spark.read.parquet(f"{root}/macd_day_features.parquet").inputFiles()) == sorted(before)
