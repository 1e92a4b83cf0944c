"""Hot keys and long series give whole, exact results; plans have the shape they were designed for."""

import datetime
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions.ewm import ewm, memory, widths
from barspark.functions.frames import DAILY, Series, dealt, extremes
from barspark.operators import factors, indicators, intraday, macd, ml, ranking, scoring, signals
from barspark.operators.long_series import numbered, over_blocks
from barspark.plans.tables import bars_daily, bars_minute, table

SMALL = "/root/testdata/sf0.001"


def minute_history(n, ticker, seed):
    r = np.random.default_rng(seed)
    close = 20 * np.exp(np.cumsum(r.normal(0, 0.001, n)))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(r.integers(1, 4, n)), unit="min")
    return pd.DataFrame({"ticker": ticker, "dt": at, "date": at.date, "open": close, "high": close, "low": close,
                         "close": close, "volume": 1})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_average_rank_of_hot_groups(spark):
    r = np.random.default_rng(0)
    hot = pd.DataFrame({"g": "hot", "v": np.where(r.random(6_000) < 0.4, 0.0, r.standard_cauchy(6_000))})
    rest = pd.DataFrame({"g": [f"g{i % 50}" for i in range(12_000)], "v": r.normal(size=12_000).round(2)})
    pdf = pd.concat([hot, rest, pd.DataFrame({"g": ["hot"], "v": [None]})], ignore_index=True)
    pdf["id"] = range(len(pdf))
    want = pdf.groupby("g")["v"].rank()
    for rows in (200, ranking.RANGE_ROWS):
        got = ranking.average_ranks(spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))), ["g"],
                                    {"v": "rank"}, rows).orderBy("id").toPandas()
        assert len(got) == len(pdf) and np.allclose(got["rank"].astype(float), want, equal_nan=True)


def test_ranking_has_one_plan_at_all_sizes(spark):
    shapes = set()
    for n in (3, 300_000):
        df = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") % 1000).cast("double").alias("v"), F.col("id").cast("double").alias("w"))
        optimized = ranking.average_ranks(df, ["g"], {"v": "a", "w": "b"})._jdf.queryExecution().optimizedPlan().toString()
        shapes.add(tuple(re.findall(r"^[\s:+-]*(\w+)", optimized, re.M)))
    assert len(shapes) == 1


def test_only_crowded_groups_are_sketched_and_values_share_an_exchange(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit("big")).when(F.col("id") % 3 == 1, F.concat(F.lit("s"), F.col("id") % 100)).alias("g"),
                                   F.when(F.col("id") % 7 > 0, (F.col("id") * 7 % 101).cast("double")).alias("v"), (-F.col("id")).cast("double").alias("w"), "id")
    cuts = ranking.splitters(df.where("g IS NOT NULL"), ["g"], ["v"], 500).collect()
    assert [r["g"] for r in cuts] == ["big"] and ranking.splitters(df, ["g"], ["v"]).isEmpty()
    pdf = df.toPandas().sort_values("id")
    for rows in (500, ranking.RANGE_ROWS):  # a NULL group is a group as well
        got = ranking.average_ranks(df, ["g"], {"v": "a", "w": "b"}, rows).orderBy("id").toPandas()
        for value, rank in (("v", "a"), ("w", "b")):
            want = pdf.groupby(pdf["g"].fillna("none"))[value].rank().to_numpy()
            assert np.allclose(got[rank].astype(float), want, equal_nan=True)
    whole = ranking._whole(df, ["g"], ["v", "w"])
    assert exchanges(whole) == 1


def test_rsi_walk_forward_sorts_its_slices_once(spark):
    df = spark.range(400).select(F.lit("T").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                 (F.col("id") * 37 % 23 + 10).cast("double").alias("close"))
    few = signals.walk_forward(df, signals.parameter_grid(period=(9, 14), oversold=(30,), overbought=(65,)), strategy="rsi")
    assert len(re.findall(r"Sort \[[^]]*phase#\d+ ASC", plan(few))) == 1
    assert few.count() > 0


def test_outliers_leave_the_ranges_even(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.normal(size=199_995), [1e300, -1e300, 1e12, -1e9, 1e8]])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values}))
    cuts = ranking.splitters(df, ["g"], ["v"], 4_000)
    ranged = df.crossJoin(cuts.select("_cuts_0")).groupBy(ranking._range(F.col("v"), F.col("_cuts_0")).alias("r")).count().toPandas()
    inner = ranged[ranged["r"] % 2 == 0]
    assert len(inner) >= 30 and inner["count"].max() < 2 * 200_000 / 32
    got = ranking.average_ranks(df, ["g"], {"v": "rank"}, 4_000).orderBy("v").toPandas()
    assert got["rank"].tolist() == pd.Series(np.sort(values)).rank().tolist()


def test_a_hot_value_is_spread_and_ranked_exactly(spark):
    df = spark.range(60_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") - 30_000.5).alias("v"), "id")
    got = ranking.average_ranks(df, ["g"], {"v": "rank"}, 1_000)
    pdf = got.orderBy("id").toPandas()
    assert np.allclose(pdf["rank"], pdf["v"].rank())
    assert "_salt" in plan(got)


def test_numbering_without_a_series_sort(spark):
    df = spark.createDataFrame(minute_history(5_000, "HOT", 1))
    got = numbered(df, ("ticker",), "dt", F.col("date")).orderBy("dt").toPandas()
    assert got["_n"].tolist() == list(range(5_000))


def test_blocks_equal_whole_series(spark):
    pdf = pd.concat([minute_history(9_000, "HOT", 1), *[minute_history(900, f"T{i}", i) for i in range(3)]])
    df = spark.createDataFrame(pdf)
    got = over_blocks(df, lambda d, s: macd.crossings(macd.macd(d, s), s), ("ticker",), "dt", F.col("date"),
                      before=800, rows=1_500).orderBy("ticker", "dt").toPandas()
    assert len(got) == len(pdf)
    for ticker, g in pdf.sort_values("dt").groupby("ticker"):
        line = g["close"].ewm(span=12, adjust=False).mean() - g["close"].ewm(span=26, adjust=False).mean()
        hist = line - line.ewm(span=9, adjust=False).mean()
        mine = got[got["ticker"] == ticker]
        assert np.allclose(mine["hist"], hist, atol=1e-10)
        assert mine["cross_up"].sum() == ((hist > 0) & (hist.shift() <= 0)).sum()


def test_blocks_hold_a_bounded_number_of_rows(spark):
    df = spark.createDataFrame(minute_history(9_000, "HOT", 1))
    sizes = []

    def look(d, series: Series):
        sizes.append(d.groupBy(*series.keys).count().agg(F.max("count")).first()[0])
        return d

    out = over_blocks(df, look, ("ticker",), "dt", F.col("date"), before=100, after=50, rows=1_000)
    assert out.count() == 9_000 and sizes[0] <= 1_150


def test_indicators_share_one_exchange(spark):
    df = indicators.technical_features(bars_daily(spark, SMALL))
    # one builds the bars, one serves every window
    assert exchanges(df) == 2


def test_day_features_reuse_the_window_exchange(spark):
    minute = bars_minute(spark, SMALL)
    assert exchanges(intraday.day_features(minute)) == 2


def test_metrics_take_one_exchange_after_the_bars(spark):
    from barspark.operators.returns import daily_derivatives
    bars = daily_derivatives(bars_daily(spark, SMALL), 1.0, 9.99)
    assert exchanges(scoring.ticker_metrics(scoring.since(bars, F.lit("2001-01-01").cast("date")))) == 2


def test_scan_reads_only_needed_columns(spark):
    text = plan(bars_minute(spark, SMALL).select("ticker", "dt", "close"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "user_id" not in schema


def test_filters_reach_the_scan(spark, tmp_path):
    from barspark.functions.predicates import apply_filters
    from barspark.sources.sinks import write_parquet
    bars = bars_daily(spark, SMALL).withColumns({"year": F.year("date"), "month": F.month("date")})
    write_parquet(bars, str(tmp_path / "bars"), ["year", "month"], tradable=False)
    df = apply_filters(spark.read.parquet(str(tmp_path / "bars")), {"close": {"min": 5.0}, "year": 1998})
    text = plan(df)
    assert "GreaterThanOrEqual(close,5.0)" in text
    assert re.search(r"PartitionFilters: \[[^\]]*year", text)


def test_bars_are_combined_before_the_shuffle(spark):
    text = plan(bars_daily(spark, SMALL))
    assert text.count("HashAggregate") >= 2 and "SortAggregate" not in text


def test_a_third_of_the_ticks_in_one_ticker(spark, tmp_path):
    line = table(spark, SMALL, "lineitem")
    hot = line.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_suppkey")))
    hot.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = bars_daily(spark, str(tmp_path)).filter("ticker = 'S1'").orderBy("date").toPandas()
    raw = hot.filter("l_suppkey = 1").toPandas()
    raw["date"] = raw["l_shipdate"].dt.date
    # however hot the ticker, its series is bounded by its trading days
    assert got["date"].tolist() == sorted(raw["date"].unique())
    raw["px"] = np.floor(raw["l_extendedprice"] / raw["l_quantity"] * 10) / 10000
    raw = raw.sort_values(["date", "l_orderkey", "l_linenumber", "px"])
    by = raw.groupby("date")
    assert np.allclose(got["open"], by["px"].first()) and np.allclose(got["close"], by["px"].last())
    assert got["volume"].tolist() == (by["l_quantity"].sum() * 30000).astype(int).tolist()


@pytest.mark.parametrize("period", ["1d", "12mo"])
def test_chart_range_counts_back_from_the_newest_row(spark, period):
    newest = datetime.date(2024, 3, 31)
    rows = [("A", newest - datetime.timedelta(days=i), 1.0) for i in range(500)]
    got = indicators.chart_range(spark.createDataFrame(rows, "ticker string, date date, close double"), period).count()
    assert got == {"1d": 2, "12mo": 367}[period]


def test_bucketed_bars_need_no_exchange(spark, tmp_path):
    from barspark.sources.sinks import write_bucketed
    write_bucketed(bars_daily(spark, SMALL), "bucketed_bars", 4, path=str(tmp_path / "b"))
    try:
        df = indicators.technical_features(spark.table("bucketed_bars"))
        assert exchanges(df) == 0 and df.count() == bars_daily(spark, SMALL).count()
    finally:
        spark.sql("DROP TABLE bucketed_bars")


def test_no_query_multiplies_tables(spark):
    """No registered plan holds a cross or nested-loop join, or an ungrouped window over a table."""
    import __spark_entry__ as entry
    acts = ("ml", "snk", "st1", "st2", "st3")  # these run jobs while they are built
    single = {"rk11_portfolio_report"}  # one portfolio: a series with one row per date
    for name, query in entry.queries().items():
        if not name.startswith(acts) or name == "ml1_time_folds":
            text = plan(query(spark, SMALL))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
            assert not re.search(r"Window \[[^\n]*windowspecdefinition\((specifiedwindowframe|[a-z_]+#\d+ (ASC|DESC))", text) or name in single, name


def test_approximate_counts_are_asked_for(spark):
    from barspark.operators.screens import distinct_count
    df = spark.range(1000)
    assert df.agg(distinct_count("id").alias("n")).first()["n"] == 1000
    assert abs(df.agg(distinct_count("id", True).alias("n")).first()["n"] - 1000) < 150


def test_resampling_draws_without_rows_of_draws(spark):
    r = np.random.default_rng(3)
    growth = np.exp(r.normal(0.01, 0.05, 400))
    pdf = pd.DataFrame({"ticker": "A", "trade": range(400), "trade_return": growth - 1})
    one = pd.DataFrame({"ticker": ["B", "C"], "trade": [1, 1], "trade_return": [0.5, None]})
    df = signals.bootstrap(spark.createDataFrame(pd.concat([pdf, one])), 2_000)
    assert "Join" not in plan(df) and exchanges(df) == 1
    got = {row["ticker"]: row for row in df.collect()}
    ends = np.log(growth).sum() + np.sqrt(400) * np.log(growth).std() * np.array([-1.645, 0.0, 1.645])
    drawn = np.log1p([got["A"]["return_5pct"], got["A"]["median_return"], got["A"]["return_95pct"]])
    assert np.allclose(drawn, ends, atol=0.15 * np.sqrt(400) * np.log(growth).std())
    assert got["B"]["median_return"] == pytest.approx(0.5) and got["B"]["simulations"] == 2_000
    assert set(got) == {"A", "B"}


def test_draws_are_even_and_independent():
    def mixed(x):
        for shift, factor in signals._MIX:
            x = ((x ^ (x >> shift)) * factor) % (1 << signals._BITS)
        return x

    n, sims = 50, 2_000
    starts = mixed((123_456_789 + np.arange(1, sims + 1, dtype=np.int64) * 1_000_003) % (1 << signals._BITS))
    at = (mixed((starts[:, None] + np.arange(1, n + 1)) % (1 << signals._BITS)) * n) >> signals._BITS
    counts = np.stack([(at == i).sum(axis=1) for i in range(n)], axis=1)
    assert abs(counts.mean(axis=0) - 1).max() < 0.12
    assert counts.var(axis=0).mean() == pytest.approx(1 - 1 / n, rel=0.05)
    assert abs(np.corrcoef(counts.T)[np.triu_indices(n, 1)].mean() + 1 / (n - 1)) < 0.01


def test_exchange_uses_each_value_once_and_not_the_number_of_parts(spark, monkeypatch):
    rows = [(f"T{i % 7}", datetime.date(2020, 1, 1) + datetime.timedelta(days=i // 7), float(i), None if i % 11 == 0 else 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double, y double").repartition(5)
    found = []
    for digits in (0, 1, 4):
        monkeypatch.setattr(ml, "_PART_DIGITS", digits)
        found.append({r["x"]: (r["_o_x"], r["_o_y"]) for r in ml.exchanged(df, ["x", "y"]).collect()})
    assert found[0] == found[1] == found[2]
    assert sorted(o for o, _ in found[0].values()) == [float(i) for i in range(500)]
    assert all((y is None) == (o % 11 == 0) for o, y in found[0].values())
    start, steps = 0.0, 0
    while steps == 0 or start != 0.0:
        start, steps = found[0][start][0], steps + 1
    assert steps == 500  # one round through all rows
    larger = df.union(spark.createDataFrame([("Z", datetime.date(2021, 1, 1), 500.0, 1.0)], df.schema))
    more = {r["x"]: r["_o_x"] for r in ml.exchanged(larger, ["x"]).collect()}
    assert sum(more[x] != o for x, (o, _) in found[0].items()) == 1
    assert ml.exchanged(df.limit(0), ["x"]).count() == 0
    assert ml.exchanged(df.filter("x = 3"), ["x"]).first()["_o_x"] == 3.0


@pytest.mark.parametrize("n", [2, 7, 30, 256, 900])
def test_sliding_extremes_by_blocks_equal_frames(spark, n):
    r = np.random.default_rng(n)
    pdf = pd.DataFrame({"ticker": ["A"] * 700 + ["B"] * 256 + ["C"], "at": [*range(700), *range(256), 0], "v": r.normal(size=957)})
    pdf.loc[r.random(957) < 0.1, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))).repartition(4)
    series = Series(("ticker",), "at", 1_000)
    wanted = {"hi": ("v", "max"), "lo": ("v", "min")}
    for ahead in (False, True):
        plain, blocks = (extremes(df, wanted, n, series, ahead, wide).orderBy("ticker", "at").collect() for wide in (10_000, 2))
        assert plain == blocks and any(row["hi"] is not None for row in plain) == (not ahead or n < 700)


def test_wide_extremes_take_no_further_exchange(spark):
    series = Series(("ticker",), "at", 1_000)
    df = spark.range(1_000).select((F.col("id") % 3).alias("ticker"), F.col("id").alias("at"), F.col("id").alias("v"))
    assert exchanges(extremes(df, {"hi": ("v", "max")}, 500, series)) == 1


def test_partitions_of_bars_follow_the_number_of_lines(spark, tmp_path):
    lines = spark.range(120_000).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 400).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
        (F.col("id") % 97 + 1.0).alias("l_extendedprice"), F.lit(0.01).alias("l_discount"), F.lit(0.02).alias("l_tax"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 400).cast("int")).alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = bars_daily(spark, str(tmp_path))
    assert bars.rdd.getNumPartitions() == 3 and bars.count() == 120_000
    grid = signals.macd_grid((5,), (13,), (5,))
    for df in (ewm(bars, {"e": (F.col("close"), 5)}, DAILY), signals.walk_forward(bars, grid), signals.run_strategy(bars, "rsi")):
        by_ticker = re.findall(r"Exchange hashpartitioning\(ticker#\d+, (\d+)\)", plan(df))
        assert by_ticker and set(by_ticker) == {"3"}


def test_dealt_rows_keep_their_keys_together(spark):
    df = dealt(spark.range(1_000).select((F.col("id") % 50).alias("k"), "id"), 1_000, ["k"], 100)
    assert df.rdd.getNumPartitions() == 10
    parts = df.select("k", F.spark_partition_id().alias("part")).groupBy("k")
    assert parts.agg(F.count_distinct("part").alias("n"), F.count("part").alias("rows")).where("n > 1 OR rows <> 20").count() == 0
    assert dealt(df, 0, ["k"]).count() == 1_000


def test_spans_share_blocks_and_their_sort(spark):
    assert widths([5, 50]) == {5: 1479, 50: 1479} and widths([14, 14], [2_048]) == {14: 2_048}
    apart = widths([2, 5, 50, 1_000])
    assert len(set(apart.values())) > 1 and all(memory(s) <= w for s, w in apart.items())
    r = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"ticker": t, "date": pd.date_range("1990-01-01", periods=n).date, "close": 50 + np.cumsum(r.normal(size=n))}) for t, n in (("A", 5_000), ("B", 3))])
    spans = (2, 5, 50, 1_000)
    df = ewm(spark.createDataFrame(pdf), {f"e{s}": (F.col("close"), s) for s in spans}, DAILY)
    got = df.toPandas().sort_values(["ticker", "date"])
    for s in spans:
        want = np.concatenate([g["close"].ewm(span=s, adjust=False).mean() for _, g in pdf.groupby("ticker")])
        assert np.allclose(got[f"e{s}"], want, rtol=1e-10)
    two = ewm(spark.createDataFrame(pdf), {"e5": (F.col("close"), 5), "e50": (F.col("close"), 50)}, DAILY)
    assert len(re.findall(r"\bSort \[", plan(two))) == 2


def test_resampling_multiplies_whole_blocks_of_slots(spark):
    r = np.random.default_rng(11)
    pdf = pd.concat([pd.DataFrame({"ticker": t, "trade": range(n), "trade_return": r.normal(0.01, 0.1, n)}) for t, n in (("A", 150), ("B", 64), ("C", 1), (None, 3))])
    df = signals.bootstrap(spark.createDataFrame(pdf, "ticker string, trade long, trade_return double"), 50, 7)
    assert "aggregate(" not in plan(df)  # no draw is a call of an interpreted function

    def mixed(x):
        for shift, factor in signals._MIX:
            x = ((x ^ (x >> shift)) * factor) % (1 << signals._BITS)
        return x

    got = {row["ticker"]: row for row in df.collect()}
    assert set(got) == {"A", "B", "C", None}
    for ticker, of in pdf.dropna().groupby("ticker"):
        own, growth, ends = int(hashlib.md5(ticker.encode()).hexdigest()[:7], 16), 1.0 + of["trade_return"].to_numpy(), []
        for s in range(1, 51):
            start, end = mixed((own + 7 + s * 1_000_003) % (1 << signals._BITS)), 1.0
            for slot in range(1, len(growth) + 1):
                end *= growth[(mixed((start + slot) % (1 << signals._BITS)) * len(growth)) >> signals._BITS]
            ends.append(end - 1.0)
        row = got[ticker]
        assert row["simulations"] == 50 and row["prob_positive"] == np.mean(np.array(ends) > 0)
        assert np.allclose([row["return_5pct"], row["median_return"], row["return_95pct"]], np.quantile(ends, [0.05, 0.5, 0.95]), rtol=1e-12, atol=1e-12)
    assert tuple(got[None]) == (None, 50, None, None, None, 0.0)  # nothing to draw by


def test_partitions_of_ranks_and_quantiles_follow_the_rows(spark, monkeypatch):
    rows = spark.range(6_000).select(F.lit("f").alias("factor"), F.concat(F.lit("T"), F.col("id") % 20).alias("ticker"),
                                     F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 20).cast("int")).alias("date"),
                                     (F.col("id") * 7 % 101 + 1.0).alias("close"), (F.col("id") * 13 % 97).cast("double").alias("value"))
    wanted = {factors.ranked: "rank_before", lambda df: factors.with_forward(factors.quantile_bins(df)): "fwd"}
    for make, column in wanted.items():
        few = make(rows)
        monkeypatch.setattr(ranking, "PART_ROWS", 1_000)
        monkeypatch.setattr(factors, "PART_ROWS", 1_000)
        many = make(rows)
        sizes = re.findall(r"Exchange hashpartitioning\(factor#\d+, (?:ticker|date)#\d+, (\d+)\), REPARTITION_BY_NUM", plan(many))
        assert len(sizes) >= 2 and set(sizes) == {"6"}
        order = [c for c in many.columns if c != column]
        assert [r[column] for r in many.orderBy(*order).collect()] == [r[column] for r in few.orderBy(*order).collect()]
        monkeypatch.undo()


def test_linear_folds_take_few_passes(spark):
    from barspark.operators import ml

    r = np.random.default_rng(5)
    pdf = pd.DataFrame(r.normal(50, 20, (2_000, 3)), columns=["a", "b", "c"]).assign(
        date=[pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=int(i)) for i in r.integers(0, 90, 2_000)], ticker="A")
    pdf["c"] = (pdf.c > 60).astype("int32")
    pdf["target"] = 0.3 * pdf.a - 0.1 * pdf.b + 4 * pdf.c + r.normal(0, 30, 2_000)
    pdf["k"] = pdf.a.where(pdf.date > pd.Timestamp("2024-01-20").date(), 3.0)  # constant in the first fold's training rows
    df = spark.createDataFrame(pdf)
    cuts = ml.folds(df, 3)
    for features, kind, alpha, most in ((["a", "b", "c"], None, 1.0, 12), (["k", "b", "c"], "ridge", 5_000.0, 24)):
        build = lambda n: ml.linear_stage(kind, alpha, n)
        spark.sparkContext.setJobGroup(f"folds {features} {kind}", "")
        got = {x.fold: x for x in ml.cross_validate(df, features, build, cuts).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds {features} {kind}"))
        spark.sparkContext.setJobGroup("other", "")
        assert jobs <= most
        for fold in cuts:
            train = fold.train(df)
            scored = ml.prepared(features, build(train.count())).fit(train).transform(fold.test(df))
            want = ml.regression_metrics(scored).first().asDict()
            assert got[fold.number].train_rows == train.count()
            for name, value in want.items():
                assert got[fold.number][name] == pytest.approx(value, rel=1e-9), (features, kind, name)
    with pytest.raises(Exception):  # as the assembler does
        ml.cross_validate(df.withColumn("a", F.when(F.col("date") < cuts[0].test_start, F.col("a")).otherwise(float("nan"))), ["a", "b"],
                          lambda n: ml.linear_stage(None, rows=n), cuts[:1]).collect()


def test_wide_means_come_from_narrow_frames(spark):
    r = np.random.default_rng(7)
    pdf = pd.DataFrame({"ticker": ["A"] * 300 + ["B"] * 450 + ["C"] * 30, "close": r.normal(50, 5, 780).round(4)})
    pdf["date"] = [pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i) for n in (300, 450, 30) for i in range(n)]
    gone = r.random(780) < 0.2
    gone[300:520] = True  # a whole window without a value
    df = spark.createDataFrame(pdf).withColumn("close", F.when(~F.col("ticker").isNull(), F.col("close")))
    missing = spark.createDataFrame(pdf[gone][["ticker", "date"]]).withColumn("gone", F.lit(True))
    df = df.join(missing, ["ticker", "date"], "left").withColumn("close", F.when(F.col("gone").isNull(), F.col("close"))).drop("gone")
    got = indicators.moving_averages(df)
    assert "-199" not in plan(got) and "_sum" not in " ".join(got.columns)
    pdf["close"] = pdf.close.where(~gone)
    for n in (20, 50, 200):
        mean = pdf.groupby("ticker").close.rolling(n, min_periods=1).mean().reset_index(level=0, drop=True)
        pdf[f"sma_{n}"] = mean.where(pdf.groupby("ticker").cumcount() >= n - 1)
    want = pdf.set_index(["ticker", "date"])
    rows = got.collect()
    assert len(rows) == 780
    for x in rows:
        for n in (20, 50, 200):
            value = want.loc[(x.ticker, x.date), f"sma_{n}"]
            assert (x[f"sma_{n}"] is None) == bool(np.isnan(value)) and (np.isnan(value) or abs(x[f"sma_{n}"] - value) < 1e-9)


def test_factors_are_evaluated_on_rows_written_once(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = [(f"T{i}" if i else None, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(d))).date() if d else None, float(r.integers(1, 9)), float(v), int(v) % 3)
            for i in range(15) for d, v in enumerate(r.integers(0, 12, 30))]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, a double, b int")
    df = df.withColumns({"a": F.when(F.col("a") > 0, F.col("a")), "close": F.when(F.col("close") > 1, F.col("close"))})
    pairs = factors.with_forward(factors.quantile_bins(factors.factor_rows(df, ["a", "b"])))
    want = factors.ic_summary(factors.daily_ic(pairs)).join(factors.spread(factors.quantile_returns(pairs)), ["factor", "horizon"], "left").toPandas()
    sizes, written = [], factors.written

    def counted(df, name):
        out = written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(factors, "written", counted)
    monkeypatch.setattr(ranking, "written", counted)
    got = factors.evaluate(df, ["a", "b"]).toPandas()
    order = ["factor", "horizon"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True)[want.columns], want.sort_values(order, ignore_index=True))
    assert len(got) == 6 and got["mean_ic"].notna().all()
    assert sum(sizes) < 1.5 * factors.factor_rows(df, ["a", "b"]).count()


def test_logistic_folds_take_few_passes(spark):
    r = np.random.default_rng(6)
    pdf = pd.DataFrame(r.normal(50, 20, (2_000, 3)), columns=["a", "b", "c"]).assign(
        date=[pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=int(i)) for i in r.integers(0, 90, 2_000)], ticker="A")
    pdf["c"] = (pdf.c > 60).astype("int32")
    pdf["target"] = 0.3 * (pdf.a - 50) - 0.1 * (pdf.b - 50) + 4 * pdf.c + r.normal(0, 9, 2_000)
    pdf["k"] = pdf.a.where(pdf.date > pd.Timestamp("2024-02-01").date(), 3.0)  # constant in the first fold's training rows
    df = spark.createDataFrame(pdf)
    cuts = ml.folds(df, 3)
    for features, kind, strength, most in ((["a", "b", "c"], "l2", 1.0, 45), (["a", "b", "c"], None, 1.0, 45), (["k", "b", "c"], "l2", 0.01, 80)):
        build = lambda n: ml.logistic_stage(kind, strength, n)
        spark.sparkContext.setJobGroup(f"logistic {features} {kind}", "")
        got = {x.fold: x for x in ml.cross_validate(df, features, build, cuts, True).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"logistic {features} {kind}"))
        spark.sparkContext.setJobGroup("other", "")
        assert jobs <= most
        labelled = ml.with_label(df)
        stages = [build(fold.train(df).count()) for fold in cuts]
        fitted = ml._margins(labelled, features, stages, cuts)
        assert set(fitted) == ({1, 2} if "k" in features else {0, 1, 2})
        for i, fold in enumerate(cuts):
            model = ml.prepared(features, stages[i].setTol(1e-12)).fit(fold.train(labelled))
            scored = model.transform(fold.test(labelled))
            want = ml.classification_metrics(scored).first().asDict()
            assert all(got[fold.number][name] == pytest.approx(value, rel=1e-9) for name, value in want.items())
            assert got[fold.number].auc == pytest.approx(ml.BinaryClassificationEvaluator(labelCol="label").evaluate(scored), rel=1e-9)
            if i in fitted:
                beta = fitted[i][1] * np.array(model.stages[1].std.toArray())
                assert np.allclose(beta, model.stages[2].coefficients.toArray(), atol=1e-6)
