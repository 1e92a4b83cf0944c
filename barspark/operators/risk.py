"""Return and risk statistics over long tables (ticker, date, ret), all series at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import DAILY, Series, full, positioned, previous
from ..functions.numeric import TRADING_DAYS, change, ratio

_YEAR = math.sqrt(TRADING_DAYS)


def returns_of(prices: DataFrame, series: Series = DAILY, close: str = "close") -> DataFrame:
    """(ticker, date, ret) without the first row of each series."""
    r = change(F.col(close), previous(close, series))
    return prices.select(*series.keys, series.order, r.alias("ret")).filter(F.col("ret").isNotNull())


def sharpe(ret: str | Column = "ret", risk_free: float = 0.0) -> Column:
    """Aggregate: annualised mean excess return over deviation; 0 without deviation."""
    c = F.col(ret) if isinstance(ret, str) else ret
    excess = F.avg(c) - F.lit(risk_free / TRADING_DAYS)
    return F.coalesce(ratio(excess, F.stddev_samp(c)), F.lit(0.0)) * _YEAR


def sortino(ret: str = "ret", risk_free: float = 0.0) -> Column:
    """Aggregate: as ``sharpe`` over the sample deviation of the negative returns."""
    down = F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret)))
    return F.coalesce(ratio(F.avg(ret) - F.lit(risk_free / TRADING_DAYS), down), F.lit(0.0)) * _YEAR


def win_rate(ret: str = "ret") -> Column:
    return ratio(F.count_if(F.col(ret) > 0), F.count(ret))


def profit_factor(ret: str = "ret") -> Column:
    """Aggregate: gains over losses; 0 without either, NULL (unbounded) without losses."""
    wins = F.coalesce(F.sum(F.when(F.col(ret) > 0, F.col(ret))), F.lit(0.0))
    losses = F.coalesce(F.sum(F.when(F.col(ret) < 0, -F.col(ret))), F.lit(0.0))
    return F.when((wins == 0) & (losses == 0), F.lit(0.0)).otherwise(ratio(wins, losses))


def value_at_risk(ret: str = "ret", confidence: float = 0.95) -> Column:
    """Aggregate: exact interpolated lower percentile; a series holds at most a calendar of returns."""
    return F.percentile(ret, F.lit(1.0 - confidence))


def curve(returns: DataFrame, series: Series = DAILY) -> DataFrame:
    """Cumulative return, drawdown from the running high, and at each new high the length of
    the spell under water that it ended (a spell that is still open has none)."""
    df = positioned(returns, series)
    df = df.withColumn("_wealth", F.product(F.lit(1.0) + F.col("ret")).over(series.running()))
    df = df.withColumn("_peak", F.max("_wealth").over(series.running()))
    df = df.withColumns({"cumulative_return": F.col("_wealth") - 1.0,
                         "drawdown": ratio(F.col("_wealth") - F.col("_peak"), F.col("_peak"))})
    high = F.when(~(F.col("drawdown") < 0), F.col("_pos"))
    df = df.withColumn("_high", high)
    df = df.withColumn("_last_high", F.last("_high", ignorenulls=True).over(
        series.ordered().rowsBetween(Window.unboundedPreceding, -1)))
    return (df.withColumn("recovered_after", F.when(
        F.col("_high").isNotNull() & (F.col("_high") - F.col("_last_high") > 1), F.col("_high") - F.col("_last_high") - 1))
        .drop("_wealth", "_peak", "_high", "_last_high", "_pos"))


def drawdowns(returns: DataFrame, series: Series = DAILY) -> DataFrame:
    """Deepest drawdown and longest recovered spell per series."""
    return curve(returns, series).groupBy(*series.keys).agg(
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.max("recovered_after"), F.lit(0)).alias("max_drawdown_days"))


def cvar(returns: DataFrame, confidence: float = 0.95, series: Series = DAILY) -> DataFrame:
    df = returns.withColumn("_var", value_at_risk("ret", confidence).over(series.whole()))
    return df.groupBy(*series.keys).agg(
        F.max("_var").alias("var"), F.avg(F.when(F.col("ret") <= F.col("_var"), F.col("ret"))).alias("cvar"))


def rolling(returns: DataFrame, sharpe_rows: int = 60, vol_rows: int = 20, risk_free: float = 0.0,
            series: Series = DAILY) -> DataFrame:
    df = positioned(returns, series)
    long, short = series.last(sharpe_rows), series.last(vol_rows)
    excess = F.avg("ret").over(long) - F.lit(risk_free / TRADING_DAYS)
    return df.withColumns({
        "rolling_sharpe": full(ratio(excess, F.stddev_samp("ret").over(long)) * _YEAR, sharpe_rows),
        "rolling_volatility": full(F.stddev_samp("ret").over(short) * _YEAR, vol_rows),
    }).drop("_pos")


def report(returns: DataFrame, risk_free: float = 0.0, series: Series = DAILY) -> DataFrame:
    """Every summary figure per series: one exchange for the curve, the tail and the grouping."""
    df = curve(returns, series).withColumn("_var", value_at_risk("ret").over(series.whole()))
    r = F.col("ret")
    out = df.groupBy(*series.keys).agg(
        F.count("ret").alias("trading_days"),
        (F.product(F.lit(1.0) + r) - 1.0).alias("total_return"),
        (F.avg(r) * TRADING_DAYS).alias("annualized_return"),
        (F.stddev_samp(r) * _YEAR).alias("annualized_volatility"),
        sharpe("ret", risk_free).alias("sharpe_ratio"), sortino("ret", risk_free).alias("sortino_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.max("recovered_after"), F.lit(0)).alias("max_drawdown_days"),
        F.max("_var").alias("var_95"), F.avg(F.when(r <= F.col("_var"), r)).alias("cvar_95"),
        win_rate().alias("win_rate"), profit_factor().alias("profit_factor"),
        F.max(r).alias("best_day"), F.min(r).alias("worst_day"), F.avg(r).alias("avg_daily_return"))
    return out.withColumn("calmar_ratio", F.coalesce(
        ratio(F.col("annualized_return"), F.abs("max_drawdown")), F.lit(0.0)))


def against_benchmark(returns: DataFrame, benchmark: DataFrame, risk_free: float = 0.0,
                      series: Series = DAILY) -> DataFrame:
    """Beta, alpha, information ratio and correlation with ``benchmark`` (date, ret_m).

    The benchmark has one row per date; whether it is broadcast is left to the
    planner, which knows its size.
    """
    df = returns.join(benchmark, series.order).filter(F.col("ret").isNotNull() & F.col("ret_m").isNotNull())
    a, b = F.col("ret"), F.col("ret_m")
    out = df.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("n"), ratio(F.covar_samp(a, b), F.var_samp(b)).alias("beta"),
        (F.avg(a) * TRADING_DAYS).alias("_a"), (F.avg(b) * TRADING_DAYS).alias("_b"),
        (F.stddev_samp(a - b) * _YEAR).alias("_te"),
        ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("correlation"),
        sharpe("ret_m", risk_free).alias("benchmark_sharpe"))
    beta = F.coalesce(F.col("beta"), F.lit(0.0))
    return out.select(
        *series.keys, "n", beta.alias("beta"),
        (F.col("_a") - (risk_free + beta * (F.col("_b") - risk_free))).alias("alpha"),
        F.coalesce(ratio(F.col("_a") - F.col("_b"), F.col("_te")), F.lit(0.0)).alias("information_ratio"),
        "correlation", "benchmark_sharpe")


def on_common_dates(returns: DataFrame, series: Series = DAILY) -> DataFrame:
    """The returns of the dates on which every asset has one."""
    assets = returns.agg(F.countDistinct("ticker")).scalar()
    dates = (returns.groupBy(series.order).agg(F.count("ret").alias("_n")).filter(F.col("_n") == assets).select(series.order))
    return returns.join(dates, series.order, "left_semi")


def portfolio_returns(returns: DataFrame, weights: DataFrame | None = None, series: Series = DAILY) -> DataFrame:
    """Daily return of constant weights (equal unless given as ticker, weight; assets without one weigh nothing).

    A date on which any asset has no return is left out.
    """
    common = on_common_dates(returns, series)
    value = F.avg("ret")
    if weights is not None:
        common = common.join(weights.select("ticker", "weight"), "ticker", "left")
        value = F.coalesce(F.sum(F.col("ret") * F.col("weight")), F.lit(0.0))
    return common.groupBy(series.order).agg(value.alias("ret")).select(F.lit("portfolio").alias("ticker"), series.order, "ret")


def asset_report(returns: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Figures of each asset over the dates that all of them share, and its weight (0 without one)."""
    out = report(on_common_dates(returns)).select("ticker", "total_return", "sharpe_ratio", "max_drawdown")
    if weights is not None:
        return out.join(weights.select("ticker", "weight"), "ticker", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    assets = returns.agg(F.countDistinct("ticker")).scalar()
    return out.withColumn("weight", ratio(F.lit(1.0), assets))
