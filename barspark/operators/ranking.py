"""Exact average ranks and quantiles inside groups of any size, by one plan.

``rank() over (partition by date order by x)`` sorts a whole group in one task, which suits
groups of up to ``RANGE_ROWS`` rows.  For each of the others, found by counting, a mergeable
quantile sketch gives range splitters, more of them for larger
groups; the rows between two splitters are ordered together, and the sizes of the ranges
are accumulated over the few ranges of a group.  Rows that equal a splitter (a value that
many rows share is one) need no order: their rank follows from the sizes alone, so they are
spread over tasks.  Splitters come from a sketch, ranks are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import dealt
from ..sources.folders import written

#: Rows of a partition, about, where each value takes one sort.
PART_ROWS = 250_000
#: Ranges of a group at most, rows of a range about, and the sketch's accuracy.
RANGES, RANGE_ROWS, ACCURACY = 64, 100_000, 1_000
_SPREAD = 64
_HASHED = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "date", "timestamp", "boolean")


def crowded(df: DataFrame, group: Sequence[str], values: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """The groups in which some value has more than ``rows`` rows, with ``_count_<i>`` of the i-th value."""
    counts = df.groupBy(*group).agg(*[F.count(v).alias(f"_count_{i}") for i, v in enumerate(values)])
    return written(counts.where(reduce(Column.__or__, [F.col(f"_count_{i}") > F.lit(int(rows)) for i in range(len(values))])), "crowded")


def splitters(df: DataFrame, group: Sequence[str], values: Sequence[str], rows: int = RANGE_ROWS, found: DataFrame | None = None) -> DataFrame:
    """One row per crowded group with the ascending range splitters ``_cuts_<i>`` of the i-th value; only the rows of such groups are sketched."""
    points = [i / RANGES for i in range(1, RANGES)]
    found = crowded(df, group, values, rows) if found is None else found
    counts = [f"_count_{i}" for i in range(len(values))]
    sketched = _same(df, found, group).groupBy(*group, *counts).agg(
        *[F.percentile_approx(v, points, ACCURACY).alias(f"_points_{i}") for i, v in enumerate(values)])

    def thinned(i: int) -> Column:
        ranges = F.least(F.lit(RANGES), F.ceil(F.col(f"_count_{i}") / max(int(rows), 1)))
        step = F.ceil(F.lit(RANGES) / F.greatest(ranges, F.lit(1)))
        some = F.filter(f"_points_{i}", lambda p, at: (at + 1) % step == 0)
        return F.array_distinct(F.coalesce(some, F.array().cast(sketched.schema[f"_points_{i}"].dataType)))

    return written(sketched.select(*group, *[thinned(i).alias(f"_cuts_{i}") for i in range(len(values))]), "splitters")


def _range(value: Column, cuts: Column) -> Column:
    """Even numbers for what lies between two splitters, odd ones for a splitter's own rows, NULL for NULL."""
    return F.when(value.isNotNull(), 2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int"))


def _same(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL; the other side's keys go."""
    other = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    return df.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]), how).drop(*[f"_other_{k}" for k in keys])


def _whole(df: DataFrame, group: list[str], values: list[str], size: int | None = None) -> DataFrame:
    """``placed`` for groups that one task can order: one exchange by group serves all values, each takes a sort.

    ``size`` is the number of rows; without it the session's number of partitions holds.
    """
    whole = Window.partitionBy(*group)
    out = df.repartition(*group) if size is None else dealt(df, size, group, PART_ROWS)
    for i, v in enumerate(values):
        there = F.col(v).isNotNull()
        nulls = F.count(F.lit(1)).over(whole) - F.count(v).over(whole)  # they come first
        out = out.withColumns({f"_below_{i}": F.when(there, F.rank().over(whole.orderBy(v)) - 1 - nulls),
                               f"_n_{i}": F.when(there, F.count(F.lit(1)).over(Window.partitionBy(*group, v))),
                               f"_total_{i}": F.when(there, F.count(v).over(whole))})
    return out


def _in_ranges(df: DataFrame, cuts: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """``placed`` for crowded groups: each value takes one exchange, by group, range and, for a splitter's own rows, a hash."""
    salted = [c for c, t in df.dtypes if t in _HASHED]
    ranged = _same(df, cuts, group).withColumns({f"_range_{i}": _range(F.col(v), F.col(f"_cuts_{i}")) for i, v in enumerate(values)})
    out = ranged.drop(*[f"_cuts_{i}" for i in range(len(values))])
    for i, v in enumerate(values):
        at = f"_range_{i}"
        whole = Window.partitionBy(*group)
        sizes = (ranged.where(F.col(at).isNotNull()).groupBy(*group, at).agg(F.count(F.lit(1)).alias("_size"))
                 .withColumns({"_before": F.coalesce(F.sum("_size").over(whole.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                               f"_total_{i}": F.sum("_size").over(whole)}))
        own = F.col(at) % 2 == 1
        out = (_same(out, sizes, [*group, at], "left")
               .withColumn("_salt", F.when(own | F.col(at).isNull(), F.pmod(F.xxhash64(*salted), F.lit(_SPREAD))).otherwise(F.lit(-1))))
        inside = Window.partitionBy(*group, at, "_salt")
        out = out.withColumns({f"_below_{i}": F.col("_before") + F.when(own, 0).otherwise(F.rank().over(inside.orderBy(v)) - 1),
                               f"_n_{i}": F.when(own, F.col("_size")).when(F.col(v).isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(*group, at, "_salt", v)))})
        out = out.drop("_size", "_before", "_salt", at)
    return out


def placed(df: DataFrame, group: Sequence[str], values: Sequence[str], rows: int = RANGE_ROWS, stored: bool = False) -> DataFrame:
    """The rows with, for the i-th value, ``_below_<i>`` (rows of the group under it), ``_n_<i>`` (rows with that value) and ``_total_<i>`` (rows with any).

    NULL has none of them.  The rows are written once (unless ``stored`` already) and read for the counts and the ranks, those of crowded groups
    for the sketch and the sizes of the ranges too.  Their number, which the files have, decides on the number of partitions.
    """
    group, values = list(group), list(values)
    df = df if stored else written(df, "ranking")
    found = crowded(df, group, values, rows)
    cuts = splitters(df, group, values, rows, found)
    return _whole(_same(df, found, group, "left_anti"), group, values, df.count()).unionByName(_in_ranges(df, cuts, group, values))


def average_ranks(df: DataFrame, group: Sequence[str], columns: dict[str, str], rows: int = RANGE_ROWS, stored: bool = False) -> DataFrame:
    """Add 1-based ranks (``columns``: value -> rank name), ties sharing their mean; NULL stays NULL."""
    out = placed(df, group, list(columns), rows, stored)
    return out.select(*df.columns, *[(F.col(f"_below_{i}") + (F.col(f"_n_{i}") + 1) / 2.0).alias(name) for i, name in enumerate(columns.values())])


def _at(index: Column, value: str) -> Column:
    return F.max(F.when((F.col("_below_0") <= index) & (index < F.col("_below_0") + F.col("_n_0")), F.col(value)))


def quantiles(df: DataFrame, group: Sequence[str], value: str, points: Sequence[float], out: str, rows: int = RANGE_ROWS, stored: bool = False) -> DataFrame:
    """One row per group with an array of exact, linearly interpolated quantiles; a group without values has none."""
    ranked = placed(df.filter(F.col(value).isNotNull()).select(*group, value), group, [value], rows, stored)
    aggs, picks = [], []
    for i, q in enumerate(points):
        h = F.lit(float(q)) * (F.col("_total_0") - 1)
        lo = F.floor(h)
        aggs += [_at(lo, value).alias(f"_lo{i}"), _at(F.ceil(h), value).alias(f"_hi{i}"),
                 F.max(h - lo).alias(f"_f{i}")]
        picks.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
    return ranked.groupBy(*group).agg(*aggs).select(*group, F.array(*picks).alias(out))
