"""Ticker metrics, weighted criteria and ranking.

Two metric dialects exist and differ on purpose:

============== ============================== ==============================
               ``sql``                        ``metrics``
============== ============================== ==============================
cut-off        one ``as_of`` day              each ticker's newest bar
range rows     all                            high > 0 and low > 0
median         interpolated                   upper middle value
mean range 0   variation 1.0                  variation 0.0
volumes        as they are                    truncated to whole shares
missing bound  0 below and 100 above          a comparison with the other bound
============== ============================== ==============================
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import DAILY
from ..functions.numeric import ratio
from ..functions.predicates import apply_filters

# Fixed values of the default screen.
TARGET_SHARES = 10_000
SWEET_SPOT = (0.20, 0.60)
LARGE_SWING = 0.20
DAYS_PER_MONTH = 30
MONTHS_BACK = 12
MIN_DAYS = 60
MIN_AVG_VOLUME = 750_000
MIN_AVG_VOLUME_SQL = 100_000
MAX_PRICE = 8.0
SQL_BOUNDS = (0.0, 100.0)


@dataclass(frozen=True)
class Criterion:
    name: str
    weight: float
    min_value: float | None = None
    max_value: float | None = None
    invert: bool = False


DEFAULT_CRITERIA = (
    Criterion("tradability_score", 3.0, 0.0, 100.0),
    Criterion("avg_daily_range_dollars", 2.5, 0.10, 1.00),
    Criterion("liquidity_multiple", 2.0, 0.0, 100.0),
    Criterion("sweet_spot_range_pct", 1.5, 0.0, 100.0),
    Criterion("daily_range_cv", 1.0, 0.0, 1.0, invert=True),
    Criterion("current_price", 10.0, 0.0, 8.0),
)


def is_default(criteria, months_back: int = MONTHS_BACK, min_days: int = MIN_DAYS) -> bool:
    """Do these settings match the precomputed index, whatever their order?"""
    return (set(criteria) == set(DEFAULT_CRITERIA) and len(criteria) == len(DEFAULT_CRITERIA)
            and (months_back, min_days) == (MONTHS_BACK, MIN_DAYS))


def normalised(c: Criterion, value: Column, dialect: str = "metrics") -> Column:
    """The criterion value on a 0..1 scale; NULL stays NULL."""
    if dialect == "sql":
        low, high = SQL_BOUNDS
        c = replace(c, min_value=low if c.min_value is None else c.min_value, max_value=high if c.max_value is None else c.max_value)
    if c.min_value is not None and c.max_value is not None:
        if c.max_value > c.min_value:
            x = (value - F.lit(c.min_value)) / F.lit(c.max_value - c.min_value)
            x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        else:
            x = F.lit(0.5)
    elif c.min_value is not None:
        x = F.when(value >= c.min_value, 1.0).otherwise(0.0)
    elif c.max_value is not None:
        x = F.when(value <= c.max_value, 1.0).otherwise(0.0)
    else:
        x = F.when(value != 0, 1.0).otherwise(0.0)
    if c.invert:
        x = F.lit(1.0) - x
    return F.when(value.isNotNull(), x)


def score(metrics: DataFrame, criteria=DEFAULT_CRITERIA, dialect: str = "metrics") -> DataFrame:
    """Add ``total_score`` and, per criterion, a struct of value, normalised value and score."""
    names = [c.name for c in criteria if c.name in metrics.columns]
    used = [c for c in criteria if c.name in names]
    parts, structs = [], []
    for c in used:
        value = F.col(c.name).cast("double")
        points = normalised(c, value, dialect) * F.lit(float(c.weight))
        parts.append(F.coalesce(points, F.lit(0.0)))
        structs.append(F.struct(value.alias("value"), normalised(c, value, dialect).alias("normalized"),
                                points.alias("score")).alias(c.name))
    total = reduce(add, parts) if parts else F.lit(0.0)
    out = metrics.withColumn("total_score", total)
    return out.withColumn("criterion_scores", F.struct(*structs)) if structs else out


def _tradability(liquidity: Column, avg_range: Column, cv: Column) -> Column:
    low, high = SWEET_SPOT
    range_points = (F.when(avg_range.between(low, high), 40.0)
                    .when(avg_range.between(0.10, low) | avg_range.between(high, 1.00), 25.0)
                    .when(avg_range < 0.10, 5.0).otherwise(10.0))
    steady = F.when(cv < 0.3, 20.0).when(cv < 0.5, 15.0).when(cv < 0.7, 10.0).otherwise(5.0)
    return F.least(liquidity / 10.0, F.lit(1.0)) * 40.0 + range_points + steady


def _dated(bars: DataFrame) -> DataFrame:
    """Weekly tables under the column names of daily ones."""
    return bars.withColumnsRenamed({"week_start": "date", "close_w": "close"}) if "week_start" in bars.columns else bars


def _complete(bars: DataFrame) -> DataFrame:
    """Tables may lack columns: what depends on a missing one becomes NULL, and without
    ``abs_ret_d`` the bar's range over its close stands in for the swing."""
    df = _dated(bars)
    if "abs_ret_d" not in df.columns and {"high", "low"} <= set(df.columns):
        df = df.withColumn("abs_ret_d", F.when(F.col("close") > 0, ratio(F.col("high") - F.col("low"), F.col("close"))))
    missing = [c for c in ("open", "high", "low", "volume", "ret_d", "abs_ret_d") if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df


def ticker_metrics(recent: DataFrame, dialect: str = "sql") -> DataFrame:
    """One row per ticker from one grouping; ``recent`` is already cut to the period.

    Needs ticker, date and close; other columns may be missing.  Bars are one per ticker
    and date, so the exact median below counts at most a calendar of values per ticker.
    """
    sql = dialect == "sql"
    recent = _complete(recent)
    dollars = F.col("high") - F.col("low")
    if not sql:
        dollars = F.when((F.col("high") > 0) & (F.col("low") > 0), dollars)
    df = recent.withColumns({"_range": dollars, "_days": F.datediff("date", F.lit("1970-01-01").cast("date"))})
    median = (F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY _range)") if sql
              else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _range DESC)"))
    m = df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days_analyzed"),
        F.max_by("close", "date").alias("current_price"), F.min_by("close", "date").alias("first_close"),
        F.min("close").alias("min_price"), F.max("close").alias("max_price"), F.avg("close").alias("avg_price"),
        F.stddev_samp("close").alias("price_std"),
        F.avg("volume").alias("avg_volume"), F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume"),
        F.avg("_range").alias("avg_daily_range_dollars"), F.stddev_samp("_range").alias("daily_range_std_dollars"),
        median.alias("median_daily_range_dollars"), F.min("_range").alias("min_daily_range_dollars"),
        F.max("_range").alias("max_daily_range_dollars"), F.count("_range").alias("_range_days"),
        F.count_if(F.col("_range").between(*SWEET_SPOT)).alias("sweet_spot_range_days"),
        F.avg("ret_d").alias("avg_return"), F.stddev_samp("ret_d").alias("volatility"),
        F.avg("abs_ret_d").alias("avg_daily_swing_pct"), F.max("abs_ret_d").alias("max_daily_swing_pct"),
        F.count_if(F.col("abs_ret_d") >= LARGE_SWING).alias("large_swing_days"), F.count("abs_ret_d").alias("_swings"),
        F.regr_slope("close", "_days").alias("_slope"))
    first, now, volume = F.col("first_close"), F.col("current_price"), F.col("avg_volume")
    mean_range, n = F.col("avg_daily_range_dollars"), F.col("days_analyzed")
    slope = F.coalesce(F.col("_slope"), F.lit(0.0))
    cv = F.when(mean_range > 0, F.col("daily_range_std_dollars") / mean_range)
    if sql:
        cv = F.when(mean_range > 0, cv).otherwise(1.0)
    else:
        cv = F.when(F.col("daily_range_std_dollars").isNotNull(), F.coalesce(cv, F.lit(0.0)))
    m = m.withColumns({
        "total_return_pct": F.when(first > 0, (ratio(now, first) - 1.0) * 100.0).otherwise(0.0),
        "sweet_spot_range_pct": ratio(F.col("sweet_spot_range_days"), n if sql else F.col("_range_days")) * 100.0,
        "liquidity_multiple": volume / F.lit(float(TARGET_SHARES)),
        "position_pct_of_volume": F.when(volume > 0, ratio(F.lit(float(TARGET_SHARES)), volume) * 100.0)
                                   .when(volume.isNotNull(), 100.0),
        "daily_range_cv": cv,
        "large_swing_frequency": ratio(F.col("large_swing_days"), n if sql else F.col("_swings")),
        "trend_slope": slope,
        "trend_pct": F.when(first > 0, ratio(slope * n, first) * 100.0).otherwise(0.0),
        "price_range_pct": F.when(F.col("min_price") > 0, ratio(F.col("max_price") - F.col("min_price"),
                                                                F.col("min_price")) * 100.0).otherwise(0.0),
    })
    liquidity = F.col("liquidity_multiple")
    m = m.withColumns({
        "profit_potential_score": F.when(volume > 0, mean_range * F.least(liquidity, F.lit(10.0)))
                                   .when(volume.isNotNull(), 0.0),
        "tradability_score": F.when(volume.isNotNull() & mean_range.isNotNull(),
                                    _tradability(liquidity, mean_range, F.col("daily_range_cv"))),
    })
    if not sql:
        m = m.withColumns({c: F.col(c).cast("long") for c in ("avg_volume", "min_volume", "max_volume")})
    return m.drop("_range_days", "_swings", "_slope")


def since(daily: DataFrame, as_of: Column, months_back: int = MONTHS_BACK) -> DataFrame:
    """Bars from ``as_of`` minus 30 days a month on: a plain predicate that reaches the scan."""
    return daily.filter(F.col("date") >= F.date_sub(as_of, months_back * DAYS_PER_MONTH))


def since_newest(daily: DataFrame, months_back: int = MONTHS_BACK) -> DataFrame:
    """As ``since``, counted back from each ticker's newest bar; adds ``_all_days`` and ``_newest``."""
    w = DAILY.whole()
    df = daily.withColumns({"_newest": F.max("date").over(w), "_all_days": F.count(F.lit(1)).over(w)})
    return df.filter(F.col("date") >= F.date_sub(F.col("_newest"), months_back * DAYS_PER_MONTH))


def _price_between(metrics: DataFrame, low: float | None, high: float | None) -> DataFrame:
    if low is not None:
        metrics = metrics.filter(F.col("current_price") >= low)
    if high is not None:
        metrics = metrics.filter(F.col("current_price") <= high)
    return metrics


def rank_tickers(daily: DataFrame, as_of: Column, months_back: int = MONTHS_BACK, min_days: int = MIN_DAYS,
                 min_avg_volume: float = MIN_AVG_VOLUME_SQL, min_price: float | None = None,
                 max_price: float | None = None, criteria=DEFAULT_CRITERIA, limit: int | None = 100,
                 tradability_first: bool = False) -> DataFrame:
    """Rank tickers by weighted criteria over the ``sql`` metrics.

    ``tradability_first`` keeps the ``limit`` most tradable tickers and then ranks those
    by total score; by default all gated tickers are ranked before limiting.
    """
    m = ticker_metrics(since(daily, as_of, months_back), "sql")
    m = m.filter((F.col("days_analyzed") >= min_days) & (F.col("avg_volume") >= min_avg_volume))
    m = _price_between(m, min_price, max_price)
    if tradability_first and limit is not None:
        m = m.orderBy(F.desc("tradability_score"), F.desc("avg_volume"), "ticker").limit(limit)
    ranked = score(m, criteria, "sql").orderBy(F.desc("total_score"), "ticker")
    return ranked if limit is None or tradability_first else ranked.limit(limit)


def scoring_index(daily: DataFrame, criteria=DEFAULT_CRITERIA, months_back: int = MONTHS_BACK,
                  min_days: int = MIN_DAYS, min_avg_volume: float = MIN_AVG_VOLUME,
                  price: tuple[float, float] = (0.0, MAX_PRICE), as_of: Column | None = None) -> DataFrame:
    """The precomputed index: ``metrics`` dialect, gates, scores and the table's newest date.

    ``min_days`` counts all bars of a ticker, the metrics only the recent ones.
    """
    recent = since_newest(daily, months_back).filter(F.col("_all_days") >= min_days)
    m = ticker_metrics(recent, "metrics")
    m = m.filter((F.col("avg_volume") >= min_avg_volume) & F.col("current_price").between(*price))
    newest = daily.agg(F.max("date")).scalar() if as_of is None else as_of
    return score(m, criteria).withColumn("last_updated", newest).orderBy(F.desc("total_score"), "ticker")


def score_filtered(daily: DataFrame, as_of: Column, filters: dict | None = None, criteria=DEFAULT_CRITERIA,
                   months_back: int = MONTHS_BACK, min_days: int = MIN_DAYS, min_avg_volume: float = 0.0,
                   price: tuple[float, float] | None = None) -> DataFrame:
    """Score on the fly; filters choose the bars, but the current price is that of all recent bars.

    A weekly table has no volumes, so its volume gate is left out.
    """
    if "volume" not in daily.columns:
        min_avg_volume = None
    recent = since(_dated(daily), as_of, months_back)
    prices = recent.groupBy("ticker").agg(F.max_by("close", "date").alias("_now"))
    m = ticker_metrics(apply_filters(recent, filters), "metrics").join(prices, "ticker")
    m = m.withColumn("current_price", F.col("_now")).drop("_now")
    m = m.filter(F.col("days_analyzed") >= min_days)
    if min_avg_volume is not None:
        m = m.filter(F.col("avg_volume") >= min_avg_volume)
    if price is not None:
        m = m.filter(F.col("current_price").between(*price))
    return score(m, criteria).orderBy(F.desc("total_score"), "ticker")


def bars_of_best(daily: DataFrame, min_score: float, min_daily_range: float = 0.0,
                 price: tuple[float, float] = (0.0, MAX_PRICE), min_avg_volume: float = MIN_AVG_VOLUME,
                 top: int | None = None, criteria=DEFAULT_CRITERIA, min_days: int = MIN_DAYS) -> DataFrame:
    """All bars of the tickers that pass price, volume, range and score gates (optionally the best ``top``)."""
    best = scoring_index(daily, criteria, min_days=min_days, min_avg_volume=min_avg_volume, price=price,
                         as_of=F.lit(None).cast("date"))
    best = best.filter((F.col("avg_daily_range_dollars") >= min_daily_range) & (F.col("total_score") >= min_score))
    if top is not None:
        best = best.orderBy(F.desc("total_score"), "ticker").limit(top)
    return daily.join(best.select("ticker"), "ticker", "left_semi")


@dataclass(frozen=True)
class Request:
    """What decides the result of :func:`scoring_index`; the defaults are the default screen."""

    criteria: tuple[Criterion, ...] = DEFAULT_CRITERIA
    dataset: str = "daily"
    months_back: int = MONTHS_BACK
    min_days: int = MIN_DAYS
    min_avg_volume: float = MIN_AVG_VOLUME
    price: tuple[float, float] = (0.0, MAX_PRICE)
    filters: dict | None = None

    def same(self, other: Request) -> bool:
        """Equal in everything but the order of the criteria; no filters and empty ones are the same."""
        def rest(r: Request) -> tuple:
            return (set(r.criteria), len(r.criteria), r.dataset, r.months_back, r.min_days, r.min_avg_volume, tuple(r.price), r.filters or {})
        return rest(self) == rest(other)


def ranked_or_index(request: Request, index: DataFrame | None, compute, built: Request = Request()) -> DataFrame:
    """The stored index when the request is all that it was built for, else ``compute()``."""
    return index if index is not None and request.same(built) else compute()
