"""MACD lines, zero crossings and their ticker-day summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ewm import ewm, memory
from ..functions.frames import DAILY, INTRADAY, Series, positioned, previous, unpositioned
from .long_series import over_blocks


def macd(df: DataFrame, series: Series = INTRADAY, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Add macd, signal and hist.  Rows without a close must be filtered out before."""
    close = F.col("close")
    df = positioned(df, series)
    df = ewm(df, {"_fast": (close, fast), "_slow": (close, slow)}, series)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm(df, {"signal": (F.col("macd"), signal)}, series)
    return unpositioned(df.withColumn("hist", F.col("macd") - F.col("signal")))


def macd_history(minute: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD over a ticker's whole minute history, with its zero crossings, block by block."""
    reach = memory(slow) + memory(signal) + 1
    return over_blocks(minute, lambda d, s: crossings(macd(d, s, fast, slow, signal), s),
                       ("ticker",), "dt", F.col("date"), before=reach)


def crossings(df: DataFrame, series: Series = INTRADAY, line: str = "hist") -> DataFrame:
    """Add the previous value and the 0/1 flags of crossing zero upwards and downwards."""
    df = df.withColumn(f"{line}_prev", previous(line, series))
    before, now = F.col(f"{line}_prev"), F.col(line)
    return df.withColumns({
        "cross_up": F.coalesce((before <= 0) & (now > 0), F.lit(False)).cast("int"),
        "cross_down": F.coalesce((before >= 0) & (now < 0), F.lit(False)).cast("int"),
    })


def day_summary(crossed: DataFrame, label: str) -> DataFrame:
    """Collapse bars with MACD and crossings to one row per ticker and day."""
    def last(c: str):
        return F.max_by(c, "dt")
    return crossed.groupBy("ticker", "date").agg(
        last("close").alias(f"close_last__{label}"), last("macd").alias(f"macd_last__{label}"),
        last("signal").alias(f"signal_last__{label}"), last("hist").alias(f"hist_last__{label}"),
        F.min("hist").alias(f"hist_min__{label}"), F.max("hist").alias(f"hist_max__{label}"),
        F.sum("cross_up").alias(f"hist_zero_cross_up_count__{label}"),
        F.sum("cross_down").alias(f"hist_zero_cross_down_count__{label}"))


def merge_timeframes(one: DataFrame, five: DataFrame) -> DataFrame:
    """Full outer join with one pair of key columns."""
    return one.join(five, ["ticker", "date"], "full_outer")


def daily_macd_features(minute: DataFrame, five: DataFrame) -> DataFrame:
    """Both summaries per ticker and day, each day smoothed on its own."""
    return merge_timeframes(day_summary(crossings(macd(minute)), "1m"), day_summary(crossings(macd(five)), "5m"))


def history_macd_features(minute: DataFrame, five: DataFrame) -> DataFrame:
    """Both summaries with smoothing across days.

    The two timeframes are stacked and turned into columns by one grouping, instead of
    joining two filtered copies to the distinct keys.
    """
    keys = ["ticker", "date"]
    needed = [*keys, "dt", "close"]
    stacked = macd_history(minute.select(*needed)).withColumn("tf", F.lit("1m")).unionByName(
        macd_history(five.select(*needed)).withColumn("tf", F.lit("5m")))
    aggs = []
    for tf in ("1m", "5m"):
        def mine(c, tf=tf):
            return F.when(F.col("tf") == tf, F.col(c))
        aggs += [F.max_by(mine(c), mine("dt")).alias(f"{c}_last__{tf}") for c in ("close", "macd", "signal", "hist")]
        aggs += [F.min(mine("hist")).alias(f"hist_min__{tf}"), F.max(mine("hist")).alias(f"hist_max__{tf}"),
                 F.sum(mine("cross_up")).alias(f"hist_zero_cross_up_count__{tf}"),
                 F.sum(mine("cross_down")).alias(f"hist_zero_cross_down_count__{tf}")]
    return stacked.groupBy(*keys).agg(*aggs)


def join_features(features: DataFrame, macd_day: DataFrame) -> DataFrame:
    """Minute features with MACD columns; names both sides carry are kept from the left."""
    twice = [c for c in macd_day.columns if c in features.columns and c not in ("ticker", "date")]
    return features.join(macd_day.drop(*twice), ["ticker", "date"], "left")


def daily_macd(daily: DataFrame) -> DataFrame:
    return crossings(macd(daily, DAILY), DAILY)
