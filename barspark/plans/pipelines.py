"""The tables of a bar archive, each derived from the feed or from an earlier table.

Every step reads tables and writes one table, so steps can be rerun alone; Parquet is
the hand-off and no step holds data on the driver.  Layout under ``root``:

    daily_all, weekly_all, daily_prefiltered, minute, minute_features, macd_day_features,
    events, technical_features, scoring_index, daily_filtered_scored   (all ``.parquet`` or folders)
    commits/<table>: the dates that are finished, see ``sources.increments``
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import indicators, intraday, labels, macd, returns, scoring, screens
from ..sources import bars as feeds, increments, sinks

YEAR_MONTH = ("year", "month")


def _with_year_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("date"), "month": F.month("date")})


def daily_table(raw: DataFrame, price_min: float = 1.0, price_max: float = 9.99, unit: str = "ns") -> DataFrame:
    return returns.daily_derivatives(feeds.daily_bars(raw, unit), price_min, price_max)


def build_daily(spark: SparkSession, feed: str | Sequence[str], root: str, **options) -> None:
    sinks.write_parquet(daily_table(feeds.read_feed(spark, feed), **options), f"{root}/daily_all.parquet", YEAR_MONTH)


def build_minute(spark: SparkSession, feed: str | Sequence[str], root: str, unit: str = "ns") -> None:
    minute = feeds.minute_bars(feeds.read_feed(spark, feed, lenient=True), unit, lenient=True, tradable=True)
    sinks.write_by_date(minute, f"{root}/minute.parquet")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return feeds.read_tables(spark, f"{root}/{name}.parquet")


def build_weekly(spark: SparkSession, root: str) -> None:
    sinks.write_parquet(returns.weekly_returns(_read(spark, root, "daily_all")), f"{root}/weekly_all.parquet", ("year",))


def build_prefiltered(spark: SparkSession, root: str, price_min: float = 1.0, price_max: float = 9.99,
                      min_avg_volume: float | None = None, min_days: int | None = None) -> None:
    df = screens.prefiltered(_read(spark, root, "daily_all"), price_min, price_max, min_avg_volume, min_days)
    sinks.write_parquet(df, f"{root}/daily_prefiltered.parquet", YEAR_MONTH)


def _increment(spark: SparkSession, root: str, target: str, write: Callable[[DataFrame], None]) -> None:
    """Computes the dates of the minute table that the log of a target lacks, or has with another content."""
    increments.run(spark, f"{root}/minute.parquet", f"{root}/{target}.parquet", f"{root}/commits/{target}", write)


def build_minute_features(spark: SparkSession, root: str, band: tuple[float, float] | None = (1.0, 9.99),
                          days: int = 20) -> None:
    """Only dates without features are computed; the daily table supplies the volume history."""
    def write(minute: DataFrame) -> None:
        out = intraday.minute_features(minute, _read(spark, root, "daily_all"), days, band)
        sinks.write_parquet(_with_year_month(out), f"{root}/minute_features.parquet", ("date",), tradable=False)

    _increment(spark, root, "minute_features", write)


def build_macd_day(spark: SparkSession, root: str) -> None:
    def write(minute: DataFrame) -> None:
        out = macd.daily_macd_features(minute, intraday.resample(minute))
        sinks.write_parquet(_with_year_month(out), f"{root}/macd_day_features.parquet", ("date",), tradable=False)

    _increment(spark, root, "macd_day_features", write)


def build_events(spark: SparkSession, root: str, move: float = 0.008, ahead: int = 30) -> None:
    def write(minute: DataFrame) -> None:
        sinks.write_by_date(labels.macd_events(minute, intraday.resample(minute), move, ahead), f"{root}/events.parquet")

    _increment(spark, root, "events", write)


def build_technical(spark: SparkSession, root: str) -> None:
    out = indicators.technical_features(_read(spark, root, "daily_all"))
    sinks.write_parquet(out, f"{root}/technical_features.parquet", ("year",), tradable=False)


def build_scoring_index(spark: SparkSession, root: str, **options) -> None:
    out = scoring.scoring_index(_read(spark, root, "daily_all"), **options)
    sinks.write_parquet(out, f"{root}/scoring_index.parquet", tradable=False, sort_within=())


def build_filtered(spark: SparkSession, root: str, min_score: float, **options) -> None:
    out = scoring.bars_of_best(_read(spark, root, "daily_all"), min_score, **options)
    sinks.write_parquet(out, f"{root}/daily_filtered_scored.parquet", YEAR_MONTH, tradable=False)


STEPS: dict[str, Callable[..., None]] = {
    "weekly": build_weekly, "prefiltered": build_prefiltered, "minute_features": build_minute_features,
    "macd_day": build_macd_day, "events": build_events, "technical": build_technical,
    "scoring_index": build_scoring_index,
}
