"""Results against pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest
from builders import day
from pyspark.sql import functions as F

from barspark.functions.ewm import ewm
from barspark.functions.frames import DAILY, Series
from barspark.functions import student
from barspark.operators import capm, factors, indicators, macd, ml, ranking, risk, signals


def walk(n, seed=1, ticker="A"):
    r = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    return pd.DataFrame({"ticker": ticker, "date": pd.date_range("1950-01-01", periods=n).date, "open": close,
                         "high": close * 1.01, "low": close * 0.99, "close": close, "volume": r.integers(1, 1000, n)})


def test_ewm_over_a_long_series(spark):
    pdf = walk(7_000)  # several blocks
    df = ewm(spark.createDataFrame(pdf), {f"e{s}": (F.col("close"), s) for s in (9, 12, 26, 90)}, DAILY)
    got = df.orderBy("date").toPandas()
    for s in (9, 12, 26, 90):
        want = pdf["close"].ewm(span=s, adjust=False).mean()
        assert np.max(np.abs(got[f"e{s}"] / want - 1)) < 1e-11


def test_ewm_with_spans_in_a_column(spark):
    pdf = walk(300)
    df = spark.createDataFrame(pdf).withColumn("span", F.lit(7.0))
    got = ewm(df, {"e": (F.col("close"), F.col("span"))}, Series(("ticker",), "date", 512)).orderBy("date").toPandas()
    assert np.allclose(got["e"], pdf["close"].ewm(span=7, adjust=False).mean(), rtol=1e-12)


def test_ewm_trusts_no_declared_length(spark):
    pdf = walk(3_000)
    sets = [(2.0, 1.0), (13.0, 400.0), (1.0, 3.0)]
    df = spark.createDataFrame(pd.concat([pdf.assign(ticker=str(i), a=a, b=b) for i, (a, b) in enumerate(sets)]))
    short = Series(("ticker",), "date", 100)
    got = ewm(df, {"fixed": (F.col("close"), 2), "same": (F.col("close"), 1), "far": (F.col("close"), 400),
                   "ea": (F.col("close"), F.col("a")), "eb": (F.col("close"), F.col("b"))}, short).orderBy("date").toPandas()
    for i, (a, b) in enumerate(sets):
        g = got[got["ticker"] == str(i)].reset_index(drop=True)
        for column, span in (("fixed", 2), ("same", 1), ("far", 400), ("ea", a), ("eb", b)):
            assert np.allclose(g[column], pdf["close"].ewm(span=span, adjust=False).mean(), rtol=1e-11), (column, span)
    with pytest.raises(ValueError):
        ewm(df, {"e": (F.col("close"), 0.5)}, short)


def test_macd_of_second_bars_and_far_spans(spark):
    close = walk(20_000)["close"]
    pdf = pd.DataFrame({"ticker": "A", "date": day(0), "dt": pd.date_range("2024-01-02 09:00", periods=len(close), freq="s"), "close": close})
    df = spark.createDataFrame(pdf)
    for fast, slow, span in ((2, 13, 2), (3, 200, 9), (12, 26, 9)):
        got = macd.macd(df, fast=fast, slow=slow, signal=span).orderBy("dt").toPandas()
        line = close.ewm(span=fast, adjust=False).mean() - close.ewm(span=slow, adjust=False).mean()
        assert np.allclose(got["hist"], line - line.ewm(span=span, adjust=False).mean(), atol=1e-9 * close.max())


def test_walk_forward_over_long_windows(spark):
    pdf = walk(1_500, 9)
    got = signals.walk_forward(spark.createDataFrame(pdf), signals.macd_grid((2,), (13,), (2,)), train_months=36, test_months=6, fee=0.0, slippage=0.0).orderBy("window").toPandas()
    dates, first = pd.to_datetime(pdf["date"]), pd.Timestamp(pdf["date"][0])
    assert len(got) > 1
    for _, row in got.iterrows():
        a = first + pd.DateOffset(months=6 * int(row["window"]))
        c = pdf["close"][(dates >= a) & (dates <= a + pd.DateOffset(months=36))].reset_index(drop=True)
        line = c.ewm(span=2, adjust=False).mean() - c.ewm(span=13, adjust=False).mean()
        hist = line - line.ewm(span=2, adjust=False).mean()
        said = pd.Series(np.where((hist > 0) & (hist.shift() <= 0), 1.0, np.where((hist < 0) & (hist.shift() >= 0), 0.0, np.nan)))
        ret = said.ffill().fillna(0).shift().fillna(0) * c.pct_change().fillna(0)
        assert row["train_metric"] == pytest.approx(ret.mean() / ret.std() * np.sqrt(252), rel=1e-7)


def test_indicators_match_pandas(spark):
    pdf = walk(400, 3)
    got = indicators.technical_features(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    delta = pdf["close"].diff()
    up = delta.clip(lower=0).fillna(0).ewm(span=14, adjust=False).mean()
    down = (-delta.clip(upper=0)).fillna(0).ewm(span=14, adjust=False).mean()
    rsi = 100 - 100 / (1 + (up / down).where(down > 0, 0))
    assert np.allclose(got["rsi_14"], rsi, atol=1e-8)
    assert np.allclose(got["sma_200"].dropna(), pdf["close"].rolling(200).mean().dropna())
    assert np.allclose(got["hist_vol_20"].dropna(),
                       (np.log(pdf["close"]).diff().rolling(20).std() * np.sqrt(252)).dropna())


def test_rolling_beta_and_capm(spark):
    r = np.random.default_rng(42)
    m = r.normal(0.0005, 0.015, 252)
    a = 0.0001 + 1.2 * m + r.normal(0, 0.008, 252)
    dates = [day(i) for i in range(252)]
    ret = spark.createDataFrame(pd.DataFrame({"ticker": "asset", "date": dates, "ret": a}))
    mkt = spark.createDataFrame(pd.DataFrame({"date": dates, "ret_m": m}))
    pairs = capm.aligned(ret, mkt)
    row = capm.capm_report(pairs).first()
    x = np.column_stack([np.ones(252), m])
    coef, rss, *_ = np.linalg.lstsq(x, a, rcond=None)
    s2 = rss[0] / 250
    se = np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x)))
    assert row["beta"] == pytest.approx(coef[1], rel=1e-9) and row["alpha"] == pytest.approx(coef[0] * 252, rel=1e-7)
    assert row["std_error_beta"] == pytest.approx(se[1], rel=1e-8) and row["std_error_alpha"] == pytest.approx(se[0], rel=1e-8)
    assert 1.0 < row["beta"] < 1.5 and row["r_squared"] > 0.5 and abs(row["t_stat_beta"]) > 2 and row["p_value_beta"] < 0.05
    assert row["beta_ci_lower"] < row["beta"] < row["beta_ci_upper"]
    roll = capm.rolling(pairs).orderBy("date").toPandas()
    s = pd.DataFrame({"a": a, "m": m})
    beta = s["a"].rolling(60, min_periods=30).cov(s["m"]) / s["m"].rolling(60, min_periods=30).var()
    assert np.allclose(roll["rolling_beta"].astype(float), beta, equal_nan=True)
    assert roll["rolling_beta"].notna().sum() == 252 - 29


def test_short_series_reports_an_error(spark):
    dates = [day(i) for i in range(10)]
    ret = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": dates, "ret": np.linspace(0, 1, 10)}))
    mkt = spark.createDataFrame(pd.DataFrame({"date": dates, "ret_m": np.linspace(0, 1, 10) ** 2}))
    row = capm.capm(capm.aligned(ret, mkt)).first()
    assert row["beta"] is None and row["error"].startswith("Insufficient data: 10")


def test_factor_model_matches_least_squares(spark):
    r = np.random.default_rng(7)
    dates = [day(i) for i in range(300)]
    f = pd.DataFrame(r.normal(0, 0.01, (300, 5)), columns=list(capm.MODELS["5-factor"]))
    f.insert(0, "date", dates)
    f["rf"] = 0.0001
    y = 0.0002 + f[list(capm.MODELS["5-factor"])].to_numpy() @ np.array([1.1, 0.4, -0.2, 0.3, 0.0]) + r.normal(0, 0.005, 300)
    ret = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": dates, "ret": y + 0.0001}))
    got = capm.factor_exposures(ret, spark.createDataFrame(f), "5-factor").toPandas().set_index("term")
    x = np.column_stack([np.ones(300), f[list(capm.MODELS["5-factor"])]])
    coef, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(np.diag(rss[0] / 294 * np.linalg.inv(x.T @ x)))
    assert np.allclose(got["coefficient"], coef, rtol=1e-7, atol=1e-12) and np.allclose(got["std_error"], se, rtol=1e-7)
    with pytest.raises(ValueError):
        capm.factor_exposures(ret, spark.createDataFrame(f), "4-factor")


def test_tails_of_t_and_f(spark):
    """Native tails against the density, summed up, and against table values."""
    from math import gamma, lgamma, pi
    def t_tail(t, v):
        x = np.linspace(0, abs(t), 200_001)
        y = np.exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / np.sqrt(v * pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        return float(1 - 2 * np.trapezoid(y, x))
    rows = [(float(t), float(v), t_tail(t, v)) for t in (0, 0.3, -1.7, 2.228, 5) for v in (1, 2, 10, 61, 900)]
    rows += [(63.657, 1.0, 0.01), (float("nan"), 5.0, None), (1.0, 0.0, None), (None, 5.0, None), (float("inf"), 5.0, 0.0)]
    df = spark.createDataFrame(rows, "t double, v double, want double").withColumn("p", student.p_value(F.col("t"), F.col("v")))
    for r in df.collect():
        assert (r["p"] is None) if r["want"] is None else r["p"] == pytest.approx(r["want"], abs=1e-5 if r["t"] == 63.657 else 1e-9), r
    q = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (30.0,), (250.0,), (0.0,)], "v double").select(student.t_975(F.col("v")).alias("q")).collect()
    assert [r["q"] for r in q[:5]] == pytest.approx([12.7062047, 4.3026527, 2.5705818, 2.0422725, 1.9694982], abs=1e-6) and q[5]["q"] is None
    # with one degree of freedom above, F is the square of t
    f = spark.createDataFrame([(2.25, 1.0, 17.0), (4.0, 3.0, 20.0), (0.0, 3.0, 20.0)], "f double, a double, b double")
    got = [r["p"] for r in f.select(student.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()]
    x = np.linspace(4.0, 4000.0, 4_000_001)
    density = gamma(11.5) / gamma(1.5) / gamma(10) * (3 / 20) ** 1.5 * x ** 0.5 * (1 + 3 * x / 20) ** -11.5
    assert got == pytest.approx([t_tail(1.5, 17), np.trapezoid(density, x), 1.0], abs=1e-7)


def test_risk_report_matches_pandas(spark):
    r = pd.Series(np.random.default_rng(5).normal(0.001, 0.02, 500))
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": [day(i) for i in range(500)], "ret": r}))
    row = risk.report(df).first()
    wealth = (1 + r).cumprod()
    assert row["total_return"] == pytest.approx(wealth.iloc[-1] - 1)
    assert row["max_drawdown"] == pytest.approx((wealth / wealth.cummax() - 1).min())
    assert row["var_95"] == pytest.approx(np.percentile(r, 5)) and row["cvar_95"] == pytest.approx(r[r <= np.percentile(r, 5)].mean())
    assert row["sortino_ratio"] == pytest.approx(r.mean() / r[r < 0].std() * np.sqrt(252))


def test_ic_matches_pandas(spark):
    r = np.random.default_rng(11)
    pdf = pd.DataFrame([(f"T{i}", day(d), float(r.integers(0, 6)), float(r.normal())) for d in range(4) for i in range(30)],
                       columns=["ticker", "date", "value", "fwd"])
    pdf["factor"], pdf["horizon"] = "f", 1
    want = pdf.groupby("date").apply(lambda g: g["value"].rank().corr(g["fwd"].rank()), include_groups=False)
    got = factors.daily_ic(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    assert np.allclose(got["ic"], want)


def test_walk_forward_against_a_loop(spark):
    pdf = pd.concat([walk(420, 3, "A"), walk(300, 4, "B")])
    grid = signals.macd_grid((4, 8), (12,), (5,))
    got = signals.walk_forward(spark.createDataFrame(pdf), grid, fee=0.0, slippage=0.0).toPandas()
    assert len(got)

    def run(g, fast, slow, signal):
        span = signal
        c = g["close"].reset_index(drop=True)
        line = c.ewm(span=fast, adjust=False).mean() - c.ewm(span=slow, adjust=False).mean()
        hist = line - line.ewm(span=span, adjust=False).mean()
        said = pd.Series(np.where((hist > 0) & (hist.shift() <= 0), 1.0, np.where((hist < 0) & (hist.shift() >= 0), 0.0, np.nan)))
        held = said.ffill().fillna(0).shift().fillna(0)
        ret = held * c.pct_change().fillna(0)
        sharpe = ret.mean() / ret.std() * np.sqrt(252) if ret.std() > 0 else 0.0
        return sharpe, (1 + ret).prod() - 1

    for ticker, g in pdf.groupby("ticker"):
        g = g.assign(date=pd.to_datetime(g["date"]))
        first, final = g["date"].min(), g["date"].max()
        k, rows = 0, []
        while first + pd.DateOffset(months=k + 7) <= final:
            a, b, c = (first + pd.DateOffset(months=k + m) for m in (0, 6, 7))
            train, test = g[g["date"].between(a, b)], g[g["date"].between(b, c)]
            best = max(grid, key=lambda p: run(train, **p)[0])
            rows.append((k, best["fast"], run(train, **best)[0], run(test, **best)[1]))
            k += 1
        mine = got[got["ticker"] == ticker].sort_values("window")
        assert mine["window"].tolist() == [r[0] for r in rows]
        assert mine["fast"].tolist() == [float(r[1]) for r in rows]
        assert np.allclose(mine["train_metric"], [r[2] for r in rows]) and np.allclose(mine["test_return"], [r[3] for r in rows])


@pytest.mark.parametrize("metric", signals.METRICS)
def test_walk_forward_decides_by_any_figure(spark, metric):
    """The training figure of each window is the best of the sets' figures that a run of the strategy itself reports."""
    pdf = walk(300, 5, "A")
    grid = signals.parameter_grid(period=(5, 9), oversold=(40,), overbought=(55, 60))
    df = spark.createDataFrame(pdf)
    got = signals.walk_forward(df, grid, metric=metric, strategy="rsi").collect()
    first = pd.Timestamp(pdf["date"].min())
    for r in got[:1]:
        a, b = first + pd.DateOffset(months=r["window"]), first + pd.DateOffset(months=r["window"] + 6)
        part = spark.createDataFrame(pdf[pd.to_datetime(pdf["date"]).between(a, b)])
        found = []
        for p in grid:
            x = signals.strategy_stats(signals.simulate(signals.rsi_signals(part, **p))).first()[metric]
            found.append(float("inf") if x is None and metric == "profit_factor" else x)
        best = max(x for x in found if x is not None)
        assert r["train_metric"] == pytest.approx(best)
        chosen = grid[next(i for i, x in enumerate(found) if x is not None and round(x, 9) == round(best, 9))]
        assert (r["period"], r["overbought"]) == (chosen["period"], chosen["overbought"])


def test_walk_forward_of_a_function(spark):
    pdf = walk(300, 6, "A")
    def dips(df, series, rows):
        mean = F.avg("close").over(series.last(rows))
        return df.withColumns({"entry": F.col("close") < mean * 0.98, "exit": F.col("close") > mean * 1.02})
    grid = signals.parameter_grid(rows=(3, 8))
    got = signals.walk_forward(spark.createDataFrame(pdf), grid, metric="max_drawdown", strategy=signals.searched(dips, ["rows"])).toPandas()
    assert len(got) and set(got["rows"]) <= {3.0, 8.0} and (got["train_metric"] <= 0).all()
    for wrong in (dict(metric="luck"), dict(strategy="none"), dict(grid=[{"fast": 1}])):
        with pytest.raises(ValueError):
            signals.walk_forward(spark.createDataFrame(pdf), **({"grid": grid} | wrong))


def test_short_means_equal_the_long_form_and_refuse_longer_series(spark):
    from barspark.functions.ewm import ewm_short, width
    pdf = walk(400, 2)
    df = spark.createDataFrame(pdf)
    both = ewm_short(ewm(df, {"a": (F.col("close"), 12), "one": (F.col("close"), 1)}, DAILY), {"b": (F.col("close"), 12), "two": (F.col("close"), 1)}, DAILY).toPandas()
    assert np.allclose(both["a"], both["b"], rtol=1e-12) and np.array_equal(both["one"], both["two"])
    assert width(2) < 3000
    with pytest.raises(Exception):
        ewm_short(spark.createDataFrame(walk(3000, 2)), {"b": (F.col("close"), 2)}, DAILY).agg(F.max("b")).collect()


@pytest.fixture(scope="module")
def features(spark):
    r = np.random.default_rng(42)
    x = r.normal(size=(500, 4))
    y = 0.001 + 0.1 * x[:, 0] + 0.2 * x[:, 1] + 0.5 * r.normal(size=500)
    pdf = pd.DataFrame(x, columns=["feature1", "feature2", "feature3", "noise"])
    pdf["target"], pdf["date"], pdf["ticker"] = y, [day(i) for i in range(500)], "A"
    return spark.createDataFrame(pdf)


NAMES = ["feature1", "feature2", "feature3", "noise"]


def test_linear_significance(spark, features):
    table = {r.feature: r for r in ml.coefficients(ml.fit_linear(features, NAMES), NAMES, spark).collect()}
    assert table["feature2"].abs_coefficient > table["feature1"].abs_coefficient > table["noise"].abs_coefficient
    assert table["feature2"].p_value < 0.05 and table["feature2"].significant


def test_shrinkage(spark, features):
    def size(kind, alpha):
        return sum(r.abs_coefficient for r in ml.coefficients(ml.fit_linear(features, NAMES, kind, alpha), NAMES, spark).collect())
    plain = size(None, 0.0)
    assert size("ridge", 1_000.0) < plain
    assert size("lasso", 10.0) == pytest.approx(0.0, abs=1e-9)


def test_path_agrees_with_a_fit(spark, features):
    cuts = ml.folds(features, 3)
    best, path = ml.tune(features, NAMES, "lasso", [0.01, 0.05], cuts)
    assert best in (0.01, 0.05)
    fitted = {r.feature: r.coefficient for r in ml.coefficients(ml.fit_linear(features, NAMES, "lasso", 0.05), NAMES, spark).collect()}
    mine = {r.feature: r.coefficient for r in path.filter("alpha = 0.05").collect()}
    assert all(mine[n] == pytest.approx(fitted[n], abs=2e-3) for n in NAMES)


def test_folds_are_chronological(features):
    for f in ml.folds(features, 5):
        assert f.train_start <= f.train_end < f.test_start <= f.test_end


def test_logistic_and_permutation(spark, features):
    cv = ml.cross_validate(features, NAMES, lambda n: ml.logistic_stage("l2", 1.0, n), ml.folds(features, 2), True).toPandas()
    assert cv["auc"].between(0.5, 1.0).all()
    top = ml.permutation_importance(ml.fit_linear(features, NAMES), features, NAMES).first()
    assert top["feature"] == "feature2"


def test_daily_macd_is_pandas_macd(spark):
    pdf = walk(500, 9)
    got = macd.daily_macd(spark.createDataFrame(pdf)).orderBy("date").toPandas()
    line = pdf["close"].ewm(span=12, adjust=False).mean() - pdf["close"].ewm(span=26, adjust=False).mean()
    assert np.allclose(got["hist"], line - line.ewm(span=9, adjust=False).mean(), atol=1e-10)


def test_quantiles_match_numpy(spark):
    v = np.random.default_rng(2).normal(size=999) ** 3
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": v}))
    for rows in (ranking.RANGE_ROWS, 50):
        got = ranking.quantiles(df, ["g"], "v", [0, 0.2, 0.5, 1], "q", rows).first()["q"]
        assert np.allclose(got, np.quantile(v, [0, 0.2, 0.5, 1]))
