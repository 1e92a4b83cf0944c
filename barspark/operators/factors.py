"""Factor evaluation in long form: many factors, horizons and dates in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import DAILY, Series, dealt, following
from ..functions.numeric import change, ratio
from ..sources.folders import written
from .ranking import PART_ROWS, RANGE_ROWS, average_ranks, quantiles

MIN_NAMES = 10
_BY_DAY = ["factor", "horizon", "date"]
_BY_NAME = ["factor", "ticker"]


def factor_rows(table: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(ticker, date, close, factor, value) without missing values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors])
    # an array keeps the table's partitions by ticker, which unpivot gives up
    return table.select("ticker", "date", "close", F.inline(pairs)).filter(F.col("value").isNotNull() & F.col("close").isNotNull())


def joined_prices(factor: DataFrame, prices: DataFrame) -> DataFrame:
    """Factor values with the close of the same ticker and date."""
    return factor.join(prices.select("ticker", "date", "close"), ["ticker", "date"])


def _ahead(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The return to each horizon in a column ``_f<h>`` of its own."""
    series = Series(tuple(_BY_NAME), "date", DAILY.max_rows)
    return rows.withColumns({f"_f{h}": change(following("close", series, h), F.col("close")) for h in horizons})


def with_forward(rows: DataFrame, horizons: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row per horizon with ``fwd``, the return to that many rows ahead (NULL at the end)."""
    ahead = _ahead(rows, horizons)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in horizons])
    kept = [c for c in rows.columns if c != "close"]
    return ahead.withColumn("_h", F.explode(pairs)).select(
        *kept, F.col("_h.horizon").alias("horizon"), F.col("_h.fwd").alias("fwd"))


def rank_correlation(a: str, b: str, n: Column | None = None) -> Column:
    """Aggregate: correlation of two rank columns, NULL when either side is constant; ``n`` is the number of pairs, all rows if not given.

    Ranks are multiples of one half, so the sums are exact and an unrelated pair gives
    exactly 0; their spread is of the order of their mean, so nothing cancels badly.
    """
    x, y, n = F.col(a), F.col(b), F.count(F.lit(1)) if n is None else n
    cross = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    spread_x = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    spread_y = n * F.sum(y * y) - F.sum(y) * F.sum(y)
    return ratio(cross, F.sqrt(spread_x) * F.sqrt(spread_y))


def daily_ic(pairs: DataFrame, min_names: int = MIN_NAMES, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of value and forward return per factor, horizon and date (and ``by``)."""
    group = [*_BY_DAY, *by]
    valid = pairs.filter(F.col("fwd").isNotNull()).select(*group, "value", "fwd")
    ranked = average_ranks(valid, group, {"value": "_rv", "fwd": "_rf"})
    return (ranked.groupBy(*group).agg(rank_correlation("_rv", "_rf").alias("ic"), F.count(F.lit(1)).alias("names"))
            .filter(F.col("names") >= min_names))


def ic_summary(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    group = ["factor", "horizon", *by]
    out = ic.groupBy(*group).agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count(F.lit(1)).alias("days"),
        ratio(F.count_if(F.col("ic") > 0), F.count(F.lit(1))).alias("positive_share"))
    t = ratio(F.col("mean_ic"), ratio(F.col("std_ic"), F.sqrt(F.col("days").cast("double"))))
    return out.withColumn("t_stat", F.coalesce(t, F.lit(0.0)))


def quantile_bins(rows: DataFrame, q: int = 5, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the 1-based quantile of ``value`` within its factor and date.

    Edges are exact interpolated quantiles, right-closed; equal edges are merged, and a
    date whose values are all equal has none.  A date of more than ``range_rows`` rows is ordered in ranges.
    The rows are dealt out by factor and name, as the returns that follow need them.
    """
    rows = written(rows, "quantiles")  # read for the edges and again for the rows
    return dealt(_binned(rows, _edges(rows, q, range_rows)), rows.count(), _BY_NAME, PART_ROWS)


def _edges(rows: DataFrame, q: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The merged edges of each factor and date; ``rows`` are stored."""
    edges = quantiles(rows, ["factor", "date"], "value", [i / q for i in range(q + 1)], "_edges", range_rows, stored=True)
    return edges.withColumn("_edges", F.array_distinct("_edges"))


def _binned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    below = F.size(F.filter("_edges", lambda e: e < F.col("value")))
    return rows.join(edges, ["factor", "date"]).withColumn("quantile", F.when(F.size("_edges") > 1, F.greatest(F.lit(1), below))).drop("_edges")


def quantile_returns(binned_pairs: DataFrame) -> DataFrame:
    """Mean forward return of each quantile over all dates; input is ``with_forward(quantile_bins(rows))``."""
    return (binned_pairs.filter(F.col("quantile").isNotNull())
            .groupBy("factor", "horizon", "quantile")
            .agg(F.avg("fwd").alias("mean_return"), F.count("fwd").alias("rows")))


def spread(by_quantile: DataFrame) -> DataFrame:
    """Mean return of the top quantile minus that of the bottom one; 0 with a single quantile."""
    top = F.max_by("mean_return", "quantile") - F.min_by("mean_return", "quantile")
    return by_quantile.groupBy("factor", "horizon").agg(
        F.when(F.count(F.lit(1)) >= 2, top).otherwise(0.0).alias("spread"))


def _by_horizon(df: DataFrame, keys: Sequence[str], horizons: Sequence[int], names: dict[str, str]) -> DataFrame:
    """Figures in one column per horizon (``names``: prefix -> name) as a row per horizon."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{p}{h}").alias(n) for p, n in names.items()]) for h in horizons])
    return df.select(*keys, F.inline(rows))


def evaluate(table: DataFrame, factors: Sequence[str], horizons: Sequence[int] = (1, 5, 10), q: int = 5) -> DataFrame:
    """IC summary and spread of every factor and horizon, best mean IC first.

    A row of a factor has the returns to all horizons beside each other, so the rows are written once and dealt out by date once
    for all of them (and once more, values only, for the edges); names are not needed after the returns.
    """
    group = ["factor", "date"]
    dated = factor_rows(table, factors).filter(F.col("date").isNotNull())
    rows = written(_ahead(dated, horizons).select(*group, "value", *[f"_f{h}" for h in horizons]), "evaluated")
    # the edges are written, so that their size is known before the rows meet them
    binned = _binned(rows, written(_edges(rows.select(*group, "value"), q), "edges")).filter(F.col("quantile").isNotNull())
    means = binned.groupBy("factor", "quantile").agg(*[F.avg(f"_f{h}").alias(f"_m{h}") for h in horizons])
    returns = _by_horizon(means, ["factor", "quantile"], horizons, {"_m": "mean_return"})

    valid = rows.select(*group, *[F.when(F.col(f"_f{h}").isNotNull(), F.col("value")).alias(f"_v{h}") for h in horizons], *[f"_f{h}" for h in horizons])
    ranked = average_ranks(valid, group, {f"_{c}{h}": f"_r{c}{h}" for h in horizons for c in "vf"}, stored=True)
    ics = ranked.groupBy(*group).agg(
        *[rank_correlation(f"_rv{h}", f"_rf{h}", F.count(f"_rv{h}")).alias(f"_ic{h}") for h in horizons],
        *[F.count(f"_rv{h}").alias(f"_n{h}") for h in horizons])
    ic = _by_horizon(ics, group, horizons, {"_ic": "ic", "_n": "names"}).filter(F.col("names") >= MIN_NAMES)
    out = ic_summary(ic).join(spread(returns), ["factor", "horizon"], "left")
    return out.orderBy(F.desc("mean_ic"), "factor", "horizon")


def factor_returns(pairs: DataFrame) -> DataFrame:
    """Return of holding each name by its demeaned, unit-gross factor value, per date."""
    valid = pairs.filter(F.col("fwd").isNotNull())
    stats = valid.groupBy(*_BY_DAY).agg(F.avg("value").alias("_mean"))
    df = valid.join(stats, _BY_DAY).withColumn("_w", F.col("value") - F.col("_mean"))
    return df.groupBy(*_BY_DAY).agg(
        ratio(F.sum(F.col("_w") * F.col("fwd")), F.sum(F.abs("_w"))).alias("factor_return"))


def cumulative_factor_returns(daily: DataFrame, gross: float = 1.0) -> DataFrame:
    """Running product of daily factor returns at a gross exposure; one row per factor, horizon and date."""
    w = Series(("factor", "horizon"), "date", DAILY.max_rows).running()
    growth = F.product(F.lit(1.0) + F.coalesce(F.col("factor_return") * gross, F.lit(0.0))).over(w)
    return daily.withColumn("cumulative_return", growth - 1.0)


def ranked(rows: DataFrame) -> DataFrame:
    """Rank of each name on its date and the rank it had on its row before."""
    rows = written(rows, "ranks")
    df = dealt(average_ranks(rows, ["factor", "date"], {"value": "rank"}, stored=True), rows.count(), _BY_NAME, PART_ROWS)
    series = Series(tuple(_BY_NAME), "date", DAILY.max_rows)
    return df.withColumn("rank_before", F.lag("rank").over(series.ordered()))


def rank_autocorrelation(rows: DataFrame, min_names: int = MIN_NAMES) -> DataFrame:
    df = ranked(rows).filter(F.col("rank_before").isNotNull())
    return (df.groupBy("factor", "date").agg(rank_correlation("rank", "rank_before").alias("autocorrelation"),
                                             F.count(F.lit(1)).alias("names"))
            .filter(F.col("names") >= min_names))


def rank_turnover(rows: DataFrame) -> DataFrame:
    df = ranked(rows).filter(F.col("rank_before").isNotNull())
    return df.groupBy("factor", "date").agg(F.avg(F.abs(F.col("rank") - F.col("rank_before"))).alias("turnover"))


def rolling_ic(ic: DataFrame, days: int = 60) -> DataFrame:
    """Mean IC of the last ``days`` dates, NULL until there are that many."""
    series = Series(("factor", "horizon"), "date", DAILY.max_rows)
    w = series.last(days)
    return ic.withColumn("rolling_ic", F.when(F.count(F.lit(1)).over(w) == days, F.avg("ic").over(w)))


def split_date(rows: DataFrame, share: float = 0.67) -> Column:
    """The date that starts the held-out part: sorted distinct dates, position ``int(n * share)``."""
    days = F.sort_array(F.collect_set("date"))  # bounded by the calendar
    return rows.agg(F.element_at(days, (F.floor(F.size(days) * share) + 1).cast("int"))).scalar()


def holdout_ic(ic: DataFrame, rows: DataFrame, share: float = 0.67) -> DataFrame:
    """IC summary before and from the split date on."""
    start = split_date(rows, share)
    part = F.when(F.col("date") < start, "in_sample").otherwise("out_of_sample")
    return ic_summary(ic.withColumn("sample", part), by=["sample"])
