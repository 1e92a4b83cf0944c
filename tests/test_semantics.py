"""Rules that are easy to get wrong, on literal tables."""

import datetime

import pytest
from builders import bars, column, day
from pyspark.sql import functions as F

from barspark.functions.predicates import apply_filters, compile_filters
from barspark.functions.tickers import is_tradable, with_chart_links
from barspark.operators import indicators as ind, intraday, labels, returns, risk, scoring, screens, signals
from barspark.operators.factors import factor_rows, quantile_bins


def minutes(spark, closes, start="2024-07-01 13:30:00", ticker="A"):
    first = datetime.datetime.fromisoformat(start)
    rows = [(ticker, first + datetime.timedelta(minutes=i), c, c, c, c, 1) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "ticker string, dt timestamp, open double, high double, low double, close double, volume long")
    return df.withColumn("date", F.to_date("dt"))


def test_rsi_without_losses_is_zero(spark):
    assert column(ind.rsi(bars(spark, [1.0, 2.0, 3.0])), "rsi_14") == [0.0, 0.0, 0.0]


def test_chart_rsi_without_losses_is_hundred(spark):
    got = column(ind.chart_rsi(bars(spark, [float(i) for i in range(1, 18)])), "chart_rsi")
    assert got[:14] == [None] * 14 and got[14:] == [100.0] * 3


def test_windows_are_null_until_full(spark):
    df = ind.stochastic(ind.moving_averages(bars(spark, [float(i) for i in range(25)], spread=1.0)))
    assert [x is None for x in column(df, "sma_20")] == [True] * 19 + [False] * 6
    assert [x is None for x in column(df, "stoch_k")] == [True] * 13 + [False] * 12
    assert [x is None for x in column(df, "stoch_d")] == [True] * 15 + [False] * 10


def test_flat_prices_do_not_divide_by_zero(spark):
    df = ind.technical_features(bars(spark, [5.0] * 30, volume=0))
    row = df.orderBy(F.desc("date")).first()
    assert row["bb_pct"] is None and row["stoch_k"] is None and row["vwap"] is None
    assert row["adx_14"] == 0.0 and row["above_bb_upper"] == 0 and row["obv"] == 0.0


def test_five_minute_return_looks_four_rows_back(spark):
    df = intraday.minute_returns(minutes(spark, [1.0, 2.0, 4.0, 8.0, 16.0, 8.0]))
    assert column(df, "ret_5m", "dt") == [None] * 4 + [15.0, 3.0]
    assert column(df, "drawdown_5m", "dt") == [None] * 4 + [0.0, 0.5]


def test_session_keeps_the_last_minute(spark):
    times = ["13:29", "13:30", "20:00", "20:01"]
    rows = [("A", datetime.datetime.fromisoformat(f"2024-07-01 {t}:00"), 1.0) for t in times]
    df = spark.createDataFrame(rows, "ticker string, dt timestamp, close double")
    kept = [r.dt.strftime("%H:%M") for r in intraday.regular_session(df).orderBy("dt").withColumn("dt", F.col("dt")).collect()]
    assert kept == ["13:30", "20:00"]


def test_missing_opening_range(spark):
    row = intraday.day_features(minutes(spark, [1.0, 2.0])).first()
    assert row["first_5m_high"] is None and row["range_5m_pct"] is None and row["breakout_5m_up"] is False


def test_opening_range_uses_utc_hours_unless_told(spark):
    utc = intraday.day_features(minutes(spark, [1.0, 3.0], "2024-07-01 09:30:00")).first()
    assert utc["first_5m_high"] == 3.0
    local = intraday.day_features(minutes(spark, [1.0, 3.0]), "America/New_York").first()
    assert local["first_5m_high"] == 3.0


def test_volume_mean_includes_today(spark):
    daily = bars(spark, [1.0] * 3).withColumn("volume", F.dayofmonth("date").cast("long"))
    assert column(intraday.average_volume(daily, 3), "avg_vol_prior") == [None, None, 2.0]


def test_forward_window_must_be_complete(spark):
    df = labels.forward_extremes(minutes(spark, [1.0, 5.0, 2.0, 3.0, 4.0]), 3)
    assert column(df, "fwd_max_high_3", "dt") == [5.0, 4.0, None, None, None]
    assert column(df, "fwd_min_low_3", "dt") == [2.0, 2.0, None, None, None]


def test_move_labels_are_named_by_basis_points(spark):
    df = labels.label_moves(labels.forward_extremes(minutes(spark, [100.0, 101.0, 99.0, 99.0]), 2), 0.008, 2)
    assert column(df, "label_up_80bp_2m", "dt") == [1, 0, None, None]
    assert column(df, "label_dn_80bp_2m", "dt") == [1, 1, None, None]


def test_range_expansion_drops_the_last_row(spark):
    df = labels.range_expansion(bars(spark, [10.0, 10.0, 10.0], spread=1.0))
    assert [(r["next_day_range_pct"], r["label_next_day_range_expand"]) for r in df.collect()] == [(0.2, 1), (0.2, 1)]


def test_open_drawdown_spell_is_not_counted(spark):
    rows = [("A", day(i), r) for i, r in enumerate([-0.10, -0.10, 0.30, -0.05])]
    got = risk.drawdowns(spark.createDataFrame(rows, "ticker string, date date, ret double")).first()
    # row 1 is its own high: the starting value is not part of the curve
    assert got["max_drawdown_days"] == 1
    assert got["max_drawdown"] == pytest.approx(-0.10)


def test_profit_factor_edges(spark):
    def factor(values):
        df = spark.createDataFrame([(v,) for v in values], "ret double")
        return df.agg(risk.profit_factor().alias("x")).first()["x"]
    assert factor([0.0]) == 0.0 and factor([0.1]) is None and factor([0.2, -0.1]) == pytest.approx(2.0)


def test_weeks_start_on_monday(spark):
    row = returns.weekly_returns(bars(spark, [float(i + 1) for i in range(14)])).orderBy("week_start").collect()
    assert [(r["week_start"], r["close_w"], r["ret_w"], r["week"]) for r in row] == [
        (datetime.date(2024, 1, 1), 7.0, None, 1), (datetime.date(2024, 1, 8), 14.0, 1.0, 2)]


def test_tradable_tickers(spark):
    names = ["AAPL", "ABCDW", "ABCDU", "ABCDR", "BRK.B", "TESTX", "ABCDEFG", "ABCP", "ABPRC", "A1B", "AB1", "", None, " msft "]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r.t for r in df.filter(is_tradable(F.col("t"))).collect()] == ["AAPL", "AB1", " msft "]


def test_chart_links(spark):
    df = with_chart_links(spark.createDataFrame([("A",)], "ticker string"))
    assert df.first()["tv_5m"].endswith("symbol=A&interval=5")


def test_filter_document_kinds(spark):
    df = spark.createDataFrame([("A.1", 1.0, True), ("AX1", 2.0, False), ("B", 3.0, None)], "t string, x double, b boolean")
    def names(document):
        return sorted(r.t for r in apply_filters(df, document).collect())
    assert names({"t": "A.1"}) == ["A.1", "AX1"]          # text is a regular expression
    assert names({"t": 1}) == ["A.1", "AX1"]              # a number on text is literal
    assert names({"x": "2"}) == ["AX1"]
    assert names({"x": {"min": 2, "max": None}}) == ["AX1", "B"]
    assert names({"x": [1.0, 3.0], "nothing": 5, "b": None}) == ["A.1", "B"]
    assert names({"b": {"value": False}}) == ["AX1"]
    assert compile_filters(df.schema, {"nothing": 1}) is None


@pytest.mark.parametrize("criterion, value, expected", [
    (scoring.Criterion("x", 2.0, 0.0, 10.0), 5.0, 1.0),
    (scoring.Criterion("x", 2.0, 0.0, 10.0), 50.0, 2.0),
    (scoring.Criterion("x", 2.0, 0.0, 10.0, invert=True), 2.5, 1.5),
    (scoring.Criterion("x", 2.0, 3.0, 3.0), 9.0, 1.0),
    (scoring.Criterion("x", 2.0, min_value=3.0), 3.0, 2.0),
    (scoring.Criterion("x", 2.0, max_value=3.0), 3.1, 0.0),
    (scoring.Criterion("x", 2.0), 0.0, 0.0),
    (scoring.Criterion("x", 2.0, 0.0, 10.0), None, 0.0),
])
def test_criteria(spark, criterion, value, expected):
    df = spark.createDataFrame([("A", value)], "ticker string, x double")
    assert scoring.score(df, (criterion,)).first()["total_score"] == pytest.approx(expected)


@pytest.mark.parametrize("criterion, value, expected", [
    (scoring.Criterion("x", 2.0, min_value=50.0), 75.0, 1.0), (scoring.Criterion("x", 2.0, max_value=50.0), 25.0, 1.0),
    (scoring.Criterion("x", 2.0), 50.0, 1.0), (scoring.Criterion("x", 2.0, min_value=100.0), 7.0, 1.0), (scoring.Criterion("x", 2.0, invert=True), 150.0, 0.0)])
def test_criteria_with_missing_bounds_in_the_sql_dialect(spark, criterion, value, expected):
    df = spark.createDataFrame([("A", value)], "ticker string, x double")
    assert scoring.score(df, (criterion,), "sql").first()["total_score"] == pytest.approx(expected)


def test_history_of_daily_weekly_and_minute_tables(spark):
    daily = returns.daily_derivatives(bars(spark, [1.0, 2.0, 3.0, 4.0]), 1.0, 9.99)
    for rows_per_day in (None, 1.5):
        got = intraday.history(daily, "A", 2, rows_per_day).collect()
        assert [(r["close"], round(r["ret_d"], 6)) for r in got] == [(4.0, round(1 / 3, 6)), (3.0, 0.5)]
    weekly = returns.weekly_returns(bars(spark, [float(i) for i in range(1, 30)]))
    assert [r["close_w"] for r in intraday.history(weekly, "A", 2).collect()] == [29.0, 28.0]
    minute = minutes(spark, [1.0, 5.0, 2.0])
    assert [r["close"] for r in intraday.history(minute, "A").collect()] == [2.0, 5.0, 1.0]
    rolled = intraday.history(minute, "A", rows_per_day=1.5).collect()
    assert [(r["open"], r["high"], r["close"], r["volume"]) for r in rolled] == [(1.0, 5.0, 2.0, 3)]


def test_assets_are_reported_over_their_common_dates(spark):
    rows = [("A", day(i), 0.01 * i) for i in range(1, 8)] + [("B", day(i), -0.01) for i in range(4, 8)]
    df = spark.createDataFrame(rows, "ticker string, date date, ret double")
    got = {r["ticker"]: r for r in risk.asset_report(df, spark.createDataFrame([("A", 0.7), ("Z", 9.0)], "ticker string, weight double")).collect()}
    assert got["A"]["total_return"] == pytest.approx(1.04 * 1.05 * 1.06 * 1.07 - 1) and got["A"]["weight"] == 0.7 and got["B"]["weight"] == 0.0
    weighted = risk.portfolio_returns(df, spark.createDataFrame([("A", 0.5)], "ticker string, weight double")).orderBy("date").collect()
    assert [round(r["ret"], 6) for r in weighted] == [0.02, 0.025, 0.03, 0.035]


def test_single_bar_has_metrics(spark):
    df = returns.daily_derivatives(bars(spark, [5.0], spread=0.2), 0.0, 10.0)
    for dialect in ("sql", "metrics"):
        row = scoring.ticker_metrics(df, dialect).first()
        assert row["trend_slope"] == 0.0 and row["volatility"] is None
        assert row["daily_range_std_dollars"] is None


def test_default_request_is_recognised_in_any_order():
    assert scoring.is_default(tuple(reversed(scoring.DEFAULT_CRITERIA)))
    assert not scoring.is_default(scoring.DEFAULT_CRITERIA[:-1])


def test_quantile_edges_with_ties(spark):
    rows = [("d1", f"T{i}", v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 2.0, 3.0])] + [("d2", "T0", 4.0), ("d2", "T1", 4.0)]
    df = spark.createDataFrame(rows, "factor string, ticker string, value double").withColumn("date", F.lit("2024-01-01").cast("date"))
    for small in (True, False):
        got = {(r.factor, r.ticker): r.quantile for r in quantile_bins(df, 5, small).collect()}
        # edges 1, 1, 1, 1, 2, 3 -> 1, 2, 3
        assert [got["d1", f"T{i}"] for i in range(6)] == [1, 1, 1, 1, 1, 2]
        assert got["d2", "T0"] is None


def test_pages_do_not_overlap(spark):
    df = bars(spark, [1.0] * 10)
    pages = [[r.date for r in screens.page(df, sort_by="close", offset=o, limit=4).collect()] for o in (0, 4, 8)]
    assert sum(map(len, pages)) == 10 and len({x for p in pages for x in p}) == 10


def test_account_pays_fees_and_ignores_repeated_entries(spark):
    df = bars(spark, [10.0, 10.0, 20.0, 20.0, 40.0])
    df = df.withColumns({"entry": F.col("date").isin(day(1), day(2)), "exit": F.col("date") == day(3)})
    sim = signals.simulate(df, 0.01, 0.0)
    assert column(sim, "position") == [0, 1, 1, 0, 0]
    assert column(sim, "equity")[-1] == pytest.approx(0.99 * 2.0 * 0.99)
    trade = signals.trades(sim).first()
    assert (trade["entry_date"], trade["exit_date"]) == (day(1), day(3))
    assert trade["trade_return"] == pytest.approx(0.99 * 2.0 * 0.99 - 1)


def test_factor_rows_drop_missing(spark):
    df = bars(spark, [1.0, 2.0]).withColumn("f", F.when(F.col("close") > 1, F.col("close")))
    assert factor_rows(df, ["f"]).count() == 1


def test_metrics_of_tables_with_missing_columns(spark):
    weekly = returns.weekly_returns(bars(spark, [float(i + 1) for i in range(28)]))
    row = scoring.score_filtered(weekly, F.lit("2024-02-01").cast("date"), min_days=1, min_avg_volume=500_000.0).first()
    assert row["current_price"] == 28.0 and row["tradability_score"] is None and row["avg_volume"] is None
    assert row["total_score"] == 10.0  # only the price criterion has a value
    plain = bars(spark, [10.0, 10.0], spread=1.0).drop("volume")
    row = scoring.ticker_metrics(plain, "metrics").first()
    assert row["avg_daily_swing_pct"] == pytest.approx(0.2) and row["volatility"] is None and row["position_pct_of_volume"] is None


def test_index_only_for_the_request_it_was_built_for():
    def choice(**other):
        return scoring.ranked_or_index(scoring.Request(**other), "index", lambda: "computed")
    assert choice() == choice(criteria=tuple(reversed(scoring.DEFAULT_CRITERIA))) == choice(filters={}) == "index"
    for other in ({"months_back": 3}, {"min_days": 30}, {"min_avg_volume": 0.0}, {"price": (0.0, 9.0)}, {"dataset": "weekly"},
                  {"filters": {"close": {"max": 5.0}}}, {"criteria": scoring.DEFAULT_CRITERIA[:-1]}):
        assert choice(**other) == "computed"
    assert scoring.ranked_or_index(scoring.Request(), None, lambda: "computed") == "computed"
