import gzip

import pytest
from pyspark.sql import functions as F

from barspark.sources import bars as feeds, datasets, increments, sinks
from barspark.sources.folders import work_folder
from barspark.streaming import bars as streams

# 2024-01-02 14:30 and 14:31 UTC in nanoseconds
T0, T1 = 1704205800000000000, 1704205860000000001


def write_feed(folder, name, rows, header="ticker,volume,open,high,low,close,window_start"):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / f"{name}.csv.gz", "wt") as f:
        f.write(header + "\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_feed_aliases_and_nanoseconds(spark, tmp_path):
    write_feed(tmp_path / "2024" / "01", "2024-01-02", [("A", 10, 1, 2, 0.5, 1.5, T1)], "symbol,volume,open,high,low,close,timestamp")
    raw = feeds.read_feed(spark, str(tmp_path))
    row = feeds.minute_bars(raw).first()
    assert (row["ticker"], row["hour"], row["minute"], row["volume"]) == ("A", 14, 31, 10)
    assert feeds.daily_bars(raw).columns == ["date", "ticker", "open", "high", "low", "close", "volume", "year", "month"]


@pytest.mark.parametrize("unit, value", [("ns", -1), ("us", -1), ("ms", -1), ("s", -1)])
def test_epoch_units(spark, unit, value):
    df = spark.createDataFrame([(value,)], "x long").select(F.unix_micros(feeds.epoch_to_timestamp(F.col("x"), unit)).alias("us"))
    assert df.first()["us"] == {"ns": -1, "us": -1, "ms": -1_000, "s": -1_000_000}[unit]


def test_strict_and_lenient_numbers(spark, tmp_path):
    write_feed(tmp_path, "2024-01-02", [("A", 10, 1, 2, 0.5, 1.5, T0), ("B", 1, 1, 1, 1, 1, "oops")])
    raw = feeds.read_feed(spark, str(tmp_path))
    assert feeds.minute_bars(raw, lenient=True).count() == 1
    with pytest.raises(Exception):
        feeds.minute_bars(raw).collect()


def test_feed_of_mixed_layouts(spark, tmp_path):
    write_feed(tmp_path / "feed [1]", "2024-01-02", [("A", 10, 1, 4, 0.5, 1.5, T0)])
    write_feed(tmp_path / "feed [1]", "2024-01-03", [(1.5, 0.5, 4, 1, "B", T1, 10, "x")], "close,low,high,open,symbol,timestamp,volume,note")
    for lenient in (True, False):
        rows = feeds.minute_bars(feeds.read_feed(spark, str(tmp_path), lenient), lenient=lenient).orderBy("ticker").collect()
        assert [(r["ticker"], r["volume"], r["open"], r["high"], r["low"], r["close"]) for r in rows] == [(t, 10, 1.0, 4.0, 0.5, 1.5) for t in "AB"]
    write_feed(tmp_path, "2024-01-04", [("C", 1, T0)], "ticker,close,window_start")
    with pytest.raises(ValueError):
        feeds.read_feed(spark, str(tmp_path))


def test_headers_are_read_from_the_first_block_only(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\n \n\ufeffticker,volume\n" + "A,1\n" * 400_000)
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "broken.csv.gz").write_bytes(b"no gzip")
    (tmp_path / "one line.csv").write_text("x" * 1_000_000)
    files = feeds.feed_files(spark, str(tmp_path))
    assert len(files) == 4
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = {name.rpartition("/")[2]: header for name, header in feeds.headers(spark, files).items()}
    assert got == {"long.csv": "ticker,volume", "none.csv": "", "broken.csv.gz": "", "one line.csv": "x" * 65_536}
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before  # no pass over rows


def test_the_published_column_order_is_read_by_name(spark, tmp_path):
    write_feed(tmp_path, "2024-01-02", [("A", 10, 200.05, 200.1, 200.63, 200.01, T0)], "ticker,volume,open,close,high,low,window_start")
    target = str(tmp_path / "out")
    streams.ingest_days(spark, str(tmp_path), target, str(tmp_path / "cp"))
    r = spark.read.parquet(target).first()
    assert (r["open"], r["close"], r["high"], r["low"]) == (200.05, 200.1, 200.63, 200.01)


def test_ingest_of_mixed_layouts_sets_unfit_files_aside(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    write_feed(source, "2024-01-02", [("A", 10, 1, 4, 0.5, 1.5, T0)])
    write_feed(source / "sub [1]", "2024-01-03", [(1.5, 0.5, 4, 1, "B", T1, 10, "x"), (1.5, 0.5, 4, 1, "C", "oops", 10, "x")], "close,low,high,open,symbol,timestamp,volume,note")
    write_feed(source, "2024-01-04", [("C", 1, T0)], "ticker,close,window_start")
    (source / "blank.csv").write_text("\n \n")
    (source / "broken.csv.gz").write_bytes(b"no gzip")
    for _ in range(2):
        streams.ingest_days(spark, str(source), target, str(tmp_path / "cp"))
    rows = spark.read.parquet(target).orderBy("ticker").collect()
    assert [(r["ticker"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows] == [(t, 1.0, 4.0, 0.5, 1.5, 10) for t in "AB"]
    aside = {r["path"].rpartition("/")[2]: r["reason"] for r in spark.read.schema(streams.REJECTED_SCHEMA).json(f"{target}_rejected/*").collect()}
    assert aside == {"2024-01-04.csv.gz": "lacks high, low, open, volume", "blank.csv": "no readable header", "broken.csv.gz": "no readable header"}


def test_increments_read_new_dates_only(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    def rows(d, n, price=1.0):
        return spark.range(n).select(F.lit("A").alias("ticker"), F.lit(d).cast("date").alias("date"), (F.col("id") + price).alias("x"))
    seen = []
    def step(part):
        read = [r["file_path"] for r in part.select("_metadata.file_path").distinct().collect()]
        seen.append((read, part._jdf.queryExecution().executedPlan().toString()))
        sinks.write_by_date(part.filter("x > 1"), target)  # a date of one row gives no output
    sinks.write_by_date(rows("2024-01-01", 5).union(rows("2024-01-02", 1)), source)
    assert [str(d) for d in increments.run(spark, source, target, log, step)] == ["2024-01-01", "2024-01-02"]
    assert increments.run(spark, source, target, log, step) == [] and len(seen) == 1
    sinks.write_by_date(rows("2024-01-03", 4), source)
    assert [str(d) for d in increments.run(spark, source, target, log, step)] == ["2024-01-03"]
    files, plan = seen[-1]
    assert files and all("date=2024-01-03" in f for f in files) and "PartitionFilters: [isnotnull(date" in plan
    # a date with another content is done again, and what it had before goes
    sinks.write_by_date(rows("2024-01-01", 1), source)
    assert [str(d) for d in increments.run(spark, source, target, log, step)] == ["2024-01-01"]
    assert {str(r["date"]): r["count"] for r in spark.read.parquet(target).groupBy("date").count().collect()} == {"2024-01-03": 3}
    # a run that fails is done again
    sinks.write_by_date(rows("2024-01-04", 4), source)
    with pytest.raises(RuntimeError):
        increments.run(spark, source, target, log, lambda part: (_ for _ in ()).throw(RuntimeError("lost")))
    assert [str(d) for d in increments.run(spark, source, target, log, step)] == ["2024-01-04"]


def test_registry_falls_back_and_rejects(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "old"))
    names = datasets.Datasets({"x": [str(tmp_path / "new"), str(tmp_path / "old")], "none": [str(tmp_path / "no")]})
    assert names.load(spark, "x").count() == 3
    with pytest.raises(FileNotFoundError):
        names.load(spark, "none")
    with pytest.raises(datasets.UnknownDataset):
        names.load(spark, "y")


@pytest.mark.parametrize("today, expected", [("2024-01-08", "2024-01-05"), ("2024-01-07", "2024-01-05"),
                                              ("2024-01-06", "2024-01-05"), ("2024-01-09", "2024-01-08")])
def test_last_trading_day(spark, today, expected):
    df = spark.range(1).select(datasets.last_trading_day(F.lit(today).cast("date")).cast("string").alias("d"))
    assert df.first()["d"] == expected


def test_file_dates_and_listing(spark):
    lines = spark.createDataFrame([("2025-05-07 20:30:14  212396 a/b/2025-01-02.csv.gz",), ("PRE x",), ("",)], "value string")
    files = datasets.listed_files(lines)
    assert [r.file for r in files.collect()] == ["2025-01-02.csv.gz"]
    present = spark.createDataFrame([("2025-01-03.csv.gz",)], "file string")
    assert {(r.file[:10], r.status) for r in datasets.missing_and_extra(files, present).collect()} == {
        ("2025-01-02", "missing"), ("2025-01-03", "extra")}
    assert spark.range(1).select(datasets.file_date(F.lit("x/y.csv")).alias("d")).first()["d"] is None


def test_dates_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    def rows(d, n):
        return spark.range(n).select(F.lit("A").alias("ticker"), F.lit(d).cast("date").alias("date"), "id")
    sinks.write_by_date(rows("2024-01-01", 5).union(rows("2024-01-02", 5)), path)
    sinks.write_by_date(rows("2024-01-02", 2), path)
    assert {str(r.date): r["count"] for r in spark.read.parquet(path).groupBy("date").count().collect()} == {
        "2024-01-01": 5, "2024-01-02": 2}


def test_export_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    sinks.export_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"a":null,"b":null,"c":1.0}'


def test_unknown_codec(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_parquet(spark.range(1), str(tmp_path / "x"), compression="zip")


def test_shared_folder_is_used_where_the_cluster_names_one():
    from types import SimpleNamespace
    def session(master="local[8]", **conf):
        settings = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=settings.get), sparkContext=SimpleNamespace(master=master))
    cluster = session("yarn", spark_checkpoint_dir="hdfs://shared/work")
    assert work_folder(cluster, "x").startswith("hdfs://shared/work/x-")
    assert work_folder(cluster, "x") != work_folder(cluster, "x")
    assert "barspark-" in work_folder(session(), "x")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            work_folder(session(master), "x")


def test_ingest_takes_only_new_files(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write_feed(source, "2024-01-02", [("A", 10, 1, 2, 0.5, 1.5, T0), ("ABCDW", 10, 1, 2, 0.5, 1.5, T0)])
    streams.ingest_days(spark, str(source), target, checkpoint)
    assert spark.read.parquet(target).count() == 1
    write_feed(source, "2024-01-03", [("A", 10, 1, 2, 0.5, 1.5, T0 + 86_400_000_000_000)])
    streams.ingest_days(spark, str(source), target, checkpoint)
    assert spark.read.parquet(target).select("date").distinct().count() == 2
    # a late second file of a date adds to it
    write_feed(source, "2024-01-02-b", [("B", 10, 1, 2, 0.5, 1.5, T0)])
    streams.ingest_days(spark, str(source), target, checkpoint)
    assert spark.read.parquet(target).filter("date = '2024-01-02'").count() == 2


def test_streaming_crosses_continue_over_batches(spark, tmp_path):
    """Files fed one by one give the same crossings as one pass over everything."""
    import numpy as np
    import pandas as pd
    from barspark.functions.frames import Series
    from barspark.operators import macd
    r = np.random.default_rng(4)
    at = pd.date_range("2024-01-01", periods=600, freq="min")
    pdf = pd.concat([pd.DataFrame({"ticker": t, "dt": at, "close": 10 + np.cumsum(r.normal(0, 0.1, 600))}) for t in "AB"])
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(3):
        part = pdf[(pdf["dt"] >= at[i * 200]) & (pdf["dt"] <= at[i * 200 + 199])]
        if i == 2:  # rows the state already contains are ignored
            part = pd.concat([part, pdf[pdf["dt"] == at[10]]])
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("ticker string, dt timestamp, close double").parquet(str(source))
        streams.run_to_table(streams.macd_crosses(stream), target, checkpoint)
    got = {(x.ticker, x.dt, x.event_type) for x in spark.read.parquet(target).collect()}
    series = Series(("ticker",), "dt", 36_600)
    whole = macd.crossings(macd.macd(spark.createDataFrame(pdf), series), series)
    want = {(x.ticker, x.dt, "cross_up" if x.cross_up else "cross_down") for x in whole.filter("cross_up + cross_down > 0").collect()}
    assert got == want and want


def test_late_rows_are_dropped_from_streaming_bars(spark, tmp_path):
    source, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "ticker string, dt timestamp, open double, high double, low double, close double, volume long"
    def feed(*times):
        rows = [("A", t, 1.0, 1.0, 1.0, 1.0, 1) for t in times]
        spark.createDataFrame(rows, "ticker string, dt string, open double, high double, low double, close double, volume long") \
            .withColumn("dt", F.to_timestamp("dt")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.run_to_table(streams.resampled(stream), target, checkpoint)
    feed("2024-01-01 10:01:00", "2024-01-01 10:03:00", "2024-01-01 10:30:00")
    feed("2024-01-01 10:02:00", "2024-01-01 11:00:00")
    got = {r.dt.strftime("%H:%M"): r.volume for r in spark.read.parquet(target).collect()}
    assert got == {"10:00": 2, "10:30": 1}


def test_folders_hold_few_files(spark, tmp_path):
    df = spark.range(20_000, numPartitions=8).select(
        F.concat(F.lit("T"), F.col("id") % 50).alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("date"))
    sinks.write_by_date(df, str(tmp_path / "t"))
    assert len(spark.read.parquet(str(tmp_path / "t")).inputFiles()) <= 8 and spark.read.parquet(str(tmp_path / "t")).count() == 20_000
