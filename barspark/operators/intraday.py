"""Minute bars: resampling, session filter and ticker-day features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import DAILY, INTRADAY, Series, full, positioned, previous
from ..functions.numeric import change, ratio


def resample(minute: DataFrame, minutes: int = 5) -> DataFrame:
    """OHLCV bars, left-closed and left-labelled; only windows that hold a row."""
    return (minute
            .groupBy("ticker", F.window("dt", f"{minutes} minutes").alias("_w"))
            .agg(F.min_by("open", "dt").alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", "dt").alias("close"),
                 F.sum("volume").alias("volume"))
            .select("ticker", F.col("_w.start").alias("dt"), F.to_date(F.col("_w.start")).alias("date"),
                    "open", "high", "low", "close", "volume"))


def day_bars(minute: DataFrame) -> DataFrame:
    """One bar per ticker and day; open and close are by time, not by row order."""
    return minute.groupBy("ticker", "date").agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"))


def history(bars: DataFrame, ticker: str, limit: int = 100, rows_per_day: float | None = None) -> DataFrame:
    """A ticker's newest ``limit`` rows of a daily, weekly or minute table, newest first.

    With ``rows_per_day`` a table of dates is rolled up to one bar a day where the ticker has more rows a day than that on average; open and close are by
    ``dt`` where the table has it, and ``ret_d`` and ``abs_ret_d`` are those of the day's last row.
    """
    day = next(c for c in ("date", "week_start") if c in bars.columns)
    mine = bars.filter(F.col("ticker") == ticker)
    newest = [F.desc(day), *([F.desc("dt")] if "dt" in bars.columns else [])]
    if rows_per_day is None or day != "date":
        return mine.orderBy(*newest).limit(limit)
    at = "dt" if "dt" in bars.columns else "date"
    extra = [c for c in ("ret_d", "abs_ret_d") if c in bars.columns]
    rolled = mine.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), *[F.max_by(c, at).alias(c) for c in extra])
    # the ticker's days are few (see functions.frames), its raw rows may be many
    rolled = rolled.withColumn("_density", F.avg("_rows").over(DAILY.whole()))
    dense = rolled.filter(F.col("_density") > rows_per_day)
    thin = mine.join(rolled.filter(F.col("_density") <= rows_per_day), ["ticker", "date"], "left_semi")
    columns = ["ticker", "date", "open", "high", "low", "close", "volume", *extra]
    return dense.select(*columns).unionByName(thin.select(*columns)).orderBy(F.desc("date")).limit(limit)


def regular_session(minute: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """09:30 up to and including the 16:00 minute, local to the exchange; ``dt`` is UTC."""
    local = F.from_utc_timestamp(F.col("dt").cast("timestamp"), zone)
    at = F.hour(local) * 60 + F.minute(local)
    return minute.filter(at.between(9 * 60 + 30, 16 * 60))


def minute_returns(minute: DataFrame, series: Series = INTRADAY) -> DataFrame:
    """Returns over 1 and 4 rows (the second is known as the five-minute return), the highest
    close of the last five rows and the fall from it."""
    df = positioned(minute, series)
    peak = full(F.max("close").over(series.last(5)), 5)
    return df.withColumns({
        "ret_1m": change(F.col("close"), previous("close", series, 1)),
        "ret_5m": change(F.col("close"), previous("close", series, 4)),
        "rolling_max_5m": peak,
    }).withColumn("drawdown_5m", F.abs(ratio(F.col("close") - F.col("rolling_max_5m"), F.col("rolling_max_5m"))))\
        .drop("_pos")


def in_price_band(rows: DataFrame, daily: DataFrame, low: float, high: float) -> DataFrame:
    """Rows of ticker-days whose daily close lies in the band."""
    days = daily.filter(F.col("close").between(low, high)).select("ticker", "date")
    return rows.join(days, ["ticker", "date"], "left_semi")


def opening_minutes(zone: str | None = None) -> Column:
    """Minutes since midnight of ``dt``; the zone is UTC unless given."""
    at = F.col("dt") if zone is None else F.from_utc_timestamp(F.col("dt").cast("timestamp"), zone)
    return F.hour(at) * 60 + F.minute(at)


def day_features(minute: DataFrame, zone: str | None = None) -> DataFrame:
    """Ticker-day aggregates including the 5 and 15 minute opening ranges, in one grouping.

    The returns of ``minute_returns`` are computed first; their window and this
    grouping share the (ticker, date) exchange.
    """
    df = minute_returns(minute)
    since = opening_minutes(zone) - (9 * 60 + 30)
    ranges = {}
    for n in (5, 15):
        inside = (since >= 0) & (since < n)
        ranges[f"first_{n}m_high"] = F.max(F.when(inside, F.col("high")))
        ranges[f"first_{n}m_low"] = F.min(F.when(inside, F.col("low")))
    out = df.groupBy("ticker", "date").agg(
        F.min_by("open", "dt").alias("day_open"), F.max("high").alias("day_high"),
        F.min("low").alias("day_low"), F.max_by("close", "dt").alias("day_close"),
        F.sum("volume").alias("day_volume"), F.max("ret_1m").alias("max_1m_ret"),
        F.max("ret_5m").alias("max_5m_ret"), F.max("drawdown_5m").alias("max_drawdown_5m"),
        *[c.alias(n) for n, c in ranges.items()])
    extra = {"day_range_pct": ratio(F.col("day_high") - F.col("day_low"), F.col("day_open"))}
    for n in (5, 15):
        hi, lo = F.col(f"first_{n}m_high"), F.col(f"first_{n}m_low")
        extra[f"range_{n}m_pct"] = ratio(hi - lo, F.col("day_open"))
        extra[f"breakout_{n}m_up"] = F.coalesce(F.col("day_close") > hi, F.lit(False))
        extra[f"breakout_{n}m_down"] = F.coalesce(F.col("day_close") < lo, F.lit(False))
    return out.withColumns(extra)


def average_volume(daily: DataFrame, days: int = 20, series: Series = DAILY) -> DataFrame:
    """``avg_vol_prior``: mean volume of the last ``days`` rows, the current one included."""
    df = positioned(daily.select("ticker", "date", "volume"), series)
    return df.select("ticker", "date", full(F.avg("volume").over(series.last(days)), days).alias("avg_vol_prior"))


def with_volume_spike(features: DataFrame, daily: DataFrame, days: int = 20) -> DataFrame:
    df = features.join(average_volume(daily, days), ["ticker", "date"], "left")
    usual = F.when(F.col("avg_vol_prior") > 0, F.col("avg_vol_prior"))
    return df.withColumn("vol_spike", ratio(F.col("day_volume"), usual))


FEATURES = ["day_range_pct", "max_1m_ret", "max_5m_ret", "max_drawdown_5m", "vol_spike",
            "first_5m_high", "first_5m_low", "first_15m_high", "first_15m_low",
            "breakout_5m_up", "breakout_5m_down", "breakout_15m_up", "breakout_15m_down",
            "range_5m_pct", "range_15m_pct"]


def minute_features(minute: DataFrame, daily: DataFrame, days: int = 20,
                    band: tuple[float, float] | None = None, zone: str | None = None) -> DataFrame:
    if band is not None:
        minute = in_price_band(minute, daily, *band)
    return with_volume_spike(day_features(minute, zone), daily, days).select("ticker", "date", *FEATURES)
