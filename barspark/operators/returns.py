"""Daily and weekly returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import DAILY, WEEKLY, Series, following, previous
from ..functions.numeric import change


def daily_returns(df: DataFrame, series: Series = DAILY, close: str = "close", out: str = "ret_d") -> DataFrame:
    return df.withColumn(out, change(F.col(close), previous(close, series)))


def daily_derivatives(df: DataFrame, price_min: float, price_max: float, series: Series = DAILY) -> DataFrame:
    """Return, its size, the price change in dollars and the price-band flag."""
    before = previous("close", series)
    df = df.withColumn("_prev", before)
    r = change(F.col("close"), F.col("_prev"))
    return df.withColumns({
        "ret_d": r,
        "abs_ret_d": F.abs(r),
        "abs_change_d": F.abs(F.col("close") - F.col("_prev")),
        "close_in_band": F.col("close").between(price_min, price_max),
    }).drop("_prev")


def price_band(df: DataFrame, low: float, high: float, column: str = "close") -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def weekly_returns(daily: DataFrame) -> DataFrame:
    """Monday-anchored weeks: last close by date, week-on-week return, year and ISO week."""
    weeks = (daily
             .withColumn("week_start", F.to_date(F.date_trunc("week", F.col("date"))))
             .groupBy("ticker", "week_start")
             .agg(F.max_by("close", "date").alias("close_w")))
    before = previous("close_w", WEEKLY)
    weeks = weeks.withColumn("_prev", before)
    r = change(F.col("close_w"), F.col("_prev"))
    return weeks.withColumns({
        "ret_w": r,
        "abs_ret_w": F.abs(r),
        "abs_change_w": F.abs(F.col("close_w") - F.col("_prev")),
        "year": F.year("week_start"),
        "week": F.weekofyear("week_start"),
    }).drop("_prev")


def forward_returns(df: DataFrame, periods: tuple[int, ...] = (1, 5, 10), series: Series = DAILY) -> DataFrame:
    """``fwd_ret_{p}d``: close p rows ahead over close, minus one."""
    return df.withColumns({
        f"fwd_ret_{p}d": change(following("close", series, p), F.col("close")) for p in periods})


def returns_between(daily: DataFrame, tickers: list[str] | None = None, start: str | None = None,
                    end: str | None = None) -> DataFrame:
    """Bars of some tickers in an inclusive date range."""
    if tickers:
        daily = daily.filter(F.col("ticker").isin(tickers))
    if start:
        daily = daily.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        daily = daily.filter(F.col("date") <= F.lit(end).cast("date"))
    return daily
