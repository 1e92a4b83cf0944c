"""Screening queries: pages, statistics, gates, views and ad-hoc SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.predicates import apply_filters
from ..functions.frames import DAILY
from ..functions.tickers import is_tradable, tradable_only
from .returns import price_band


def page(df: DataFrame, filters: dict | None = None, sort_by: str | None = None, descending: bool = False,
         offset: int = 0, limit: int | None = None, tiebreak: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """One page of the filtered table; ties are broken by key so that pages do not overlap."""
    df = apply_filters(df, filters)
    if sort_by is not None:
        first = F.desc(sort_by) if descending else F.asc(sort_by)
        df = df.orderBy(first, *[c for c in tiebreak if c in df.columns and c != sort_by])
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def page_total(df: DataFrame, filters: dict | None = None) -> DataFrame:
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("total"))


def newest_per_ticker(df: DataFrame, n: int, order: str = "date") -> DataFrame:
    w = Window.partitionBy(*DAILY.keys).orderBy(F.desc(order))
    # Spark prunes rows above n before the exchange (window group limit)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _long(row: DataFrame, names: list[str], columns: dict[str, str]) -> DataFrame:
    """One wide aggregate row -> one row per source column."""
    entries = [F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{k}").alias(a) for k, a in columns.items()])
               for n in names]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def column_info(df: DataFrame, check_nulls: bool = True) -> DataFrame:
    """Name, type and whether any value is NULL, from one pass over the table.

    Without ``check_nulls`` every column counts as nullable and no data is read.
    """
    names = df.columns
    if not check_nulls:
        kinds = [(f.name, f.dataType.simpleString(), True) for f in df.schema.fields]
        return df.sparkSession.createDataFrame(kinds, "column string, type string, nullable boolean")
    row = df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(f"{n}__nulls") for n in names])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return (_long(row, names, {"nulls": "nulls"})
            .select("column", types[F.col("column")].alias("type"), (F.col("nulls") > 0).alias("nullable")))


def column_stats(df: DataFrame, first_rows: int | None = None) -> DataFrame:
    """min, max, mean, sample deviation and NULL count of every numeric column, in one pass.

    The whole table is read; ``first_rows`` estimates from a limit instead.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if first_rows is not None:
        df = df.limit(first_rows)
    aggs = []
    for n in names:
        c = F.col(f"`{n}`").cast("double")
        aggs += [F.min(c).alias(f"{n}__min"), F.max(c).alias(f"{n}__max"), F.avg(c).alias(f"{n}__mean"),
                 F.when(F.count(c) > 1, F.stddev_samp(c)).alias(f"{n}__std"),
                 F.count_if(c.isNull()).alias(f"{n}__nulls")]
    kinds = {k: k for k in ("min", "max", "mean", "std", "nulls")}
    return _long(df.agg(*aggs), names, kinds)


def liquid_tickers(daily: DataFrame, min_avg_volume: float | None = None, min_days: int | None = None) -> DataFrame:
    stats = daily.groupBy("ticker").agg(F.avg("volume").alias("avg_volume"), F.count(F.lit(1)).alias("day_count"))
    tests = []
    if min_avg_volume is not None:
        tests.append(F.col("avg_volume") >= min_avg_volume)
    if min_days is not None:
        tests.append(F.col("day_count") >= min_days)
    return stats.filter(reduce(Column.__and__, tests)) if tests else stats


def prefiltered(daily: DataFrame, price_min: float, price_max: float, min_avg_volume: float | None = None,
                min_days: int | None = None) -> DataFrame:
    """In-band bars of liquid tickers; liquidity is judged on all bars, before the band."""
    if min_avg_volume is not None or min_days is not None:
        daily = daily.join(liquid_tickers(daily, min_avg_volume, min_days), "ticker", "left_semi")
    return price_band(daily, price_min, price_max)


def ticker_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("close").alias("avg_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
        F.avg("volume").alias("avg_volume"), F.stddev_samp("close").alias("close_std"))


def recent(daily: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return daily.filter(F.col("date") >= F.date_sub(as_of, days))


def high_volume_tickers(daily: DataFrame, as_of: Column, days: int = 90, min_avg_volume: float = 100_000) -> DataFrame:
    return (recent(daily, as_of, days).groupBy("ticker")
            .agg(F.avg("volume").alias("avg_volume"), F.avg("close").alias("avg_close"),
                 F.count(F.lit(1)).alias("days"))
            .filter(F.col("avg_volume") >= min_avg_volume).orderBy(F.desc("avg_volume"), "ticker"))


def latest_close(daily: DataFrame, date: str = "date", close: str = "close") -> DataFrame:
    return daily.groupBy("ticker").agg(F.max_by(close, date).alias("latest_close"), F.max(date).alias("latest_date"))


def search(daily: DataFrame, prefix: str, as_of: Column, min_volume: float = 0, min_price: float | None = None,
           max_price: float | None = None, limit: int = 20, days: int = 30) -> DataFrame:
    """Tickers starting with ``prefix``, by average volume of the last days."""
    found = (recent(daily, as_of, days).filter(F.col("ticker").startswith(prefix.upper())).groupBy("ticker")
             .agg(F.max_by("close", "date").alias("latest_close"), F.avg("volume").alias("avg_volume"),
                  F.count(F.lit(1)).alias("days")))
    if min_volume > 0:
        found = found.filter(F.col("avg_volume") >= min_volume)
    if min_price is not None:
        found = found.filter(F.col("latest_close") >= min_price)
    if max_price is not None:
        found = found.filter(F.col("latest_close") <= max_price)
    return found.orderBy(F.desc("avg_volume"), "ticker").limit(limit)


def ticker_detail(daily: DataFrame, ticker: str, since: Column, newest: int = 500, listed: int = 30) -> DataFrame:
    """One row for one ticker: points, newest bar and the newest ``listed`` bars as an array."""
    rows = (daily.filter((F.col("ticker") == ticker) & (F.col("date") >= since))
            .orderBy(F.desc("date")).limit(newest))
    bar = F.struct("date", "close", "volume")
    return rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("data_points"), F.max("date").alias("latest_date"),
        F.max_by("close", "date").alias("latest_close"),
        F.slice(F.sort_array(F.collect_list(bar), asc=False), 1, listed).alias("price_history"))


def clean_report(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Rows and tickers before and after dropping symbols that are not ordinary shares."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    per = per.withColumn("_ok", is_tradable(F.col(column)))
    rows_after = F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_rows"))), F.lit(0))
    return per.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_before"), rows_after.alias("rows_after"),
                   F.count(column).alias("tickers_before"), F.count_if("_ok").alias("tickers_after"))


def removed_tickers(df: DataFrame, column: str = "ticker", limit: int = 50) -> DataFrame:
    return df.filter(~is_tradable(F.col(column))).select(column).distinct().orderBy(column).limit(limit)


def clean(df: DataFrame, column: str = "ticker", dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The report on symbols that are not ordinary shares, and the table without them (as it is on a dry run)."""
    return clean_report(df, column), df if dry_run else tradable_only(df, column)


def distinct_count(column: str, approximate: bool = False) -> Column:
    """Aggregate: exact unless asked; the estimate keeps a small sketch instead of all values."""
    return F.approx_count_distinct(column) if approximate else F.countDistinct(column)


def register_views(daily: DataFrame, as_of: Column) -> None:
    """The standing views ``daily``, ``ticker_summary``, ``recent_daily`` and ``high_volume_tickers``."""
    daily.createOrReplaceTempView("daily")
    ticker_summary(daily).createOrReplaceTempView("ticker_summary")
    recent(daily, as_of).createOrReplaceTempView("recent_daily")
    high_volume_tickers(daily, as_of).createOrReplaceTempView("high_volume_tickers")


def recent_averages(daily: DataFrame, as_of: Column, days: int = 90, min_days: int = 40) -> DataFrame:
    """Mean close, volume (whole shares) and dollar range per ticker over the last days."""
    out = recent(daily, as_of, days).groupBy("ticker").agg(
        F.avg("close").alias("price"), F.avg("volume").alias("shares"),
        F.avg(F.col("high") - F.col("low")).alias("width"), F.count(F.lit(1)).alias("days"))
    return out.filter(F.col("days") >= min_days).withColumns({
        "avg_price": F.round("price", 2), "avg_volume": F.bround("shares").cast("long"), "avg_daily_range": F.round("width", 3)})


def volume_leaders(daily: DataFrame, as_of: Column, min_days: int = 40, top: int = 10) -> DataFrame:
    found = recent_averages(daily, as_of, min_days=min_days)
    return found.orderBy(F.desc("avg_volume"), "ticker").limit(top).select("ticker", "avg_volume", "days")


def cheap_and_liquid(daily: DataFrame, as_of: Column, min_days: int = 40, price: tuple[float, float] = (1, 10),
                     min_volume: float = 500_000, top: int = 20) -> DataFrame:
    found = recent_averages(daily, as_of, min_days=min_days).filter(
        F.col("price").between(*price) & (F.col("shares") > min_volume))
    return found.orderBy(F.desc("avg_volume"), "ticker").limit(top).select("ticker", "avg_price", "avg_volume", "days")


def widest_for_price(daily: DataFrame, as_of: Column, min_days: int = 40, price: tuple[float, float] = (1, 10),
                     min_volume: float = 100_000, top: int = 50) -> DataFrame:
    """Scoring candidates: the largest dollar range relative to the price."""
    found = recent_averages(daily, as_of, min_days=min_days).filter(
        F.col("price").between(*price) & (F.col("shares") > min_volume))
    return found.orderBy(F.desc(F.col("width") / F.col("price")), "ticker").limit(top).select(
        "ticker", "avg_price", "avg_volume", "avg_daily_range", "days")


def totals(daily: DataFrame) -> DataFrame:
    return daily.agg(F.count(F.lit(1)).alias("total_rows"), distinct_count("ticker").alias("unique_tickers"))


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """Any SELECT over the given tables; ``{name}`` stands for a table, ``:name`` for a value."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=values or None)
