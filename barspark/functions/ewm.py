"""Exponentially weighted means (span form, not bias-adjusted) as plain window sums.

The recursion ``e[0] = x[0]``, ``e[t] = a x[t] + r e[t-1]`` with ``a = 2/(span+1)``,
``r = 1-a`` unrolls to ``e[t] = r**t * sum(u[j] * r**-j)``.  The raw powers overflow
on long series, so the exponent is counted inside blocks of ``m`` rows:

    e[t] = r**k * ( sum over this block up to t  +  r**m * sum over the block before )

with ``k`` the position in the block.  Rows two or more blocks back weigh less than
``r**m``; ``m`` is chosen so that this is below the resolution of a double (1e-17),
hence the result is exact to rounding for any length.  Spans share an ``m`` and its
blocks if it suits them all, else each has its own, so neither spans that are far apart
nor series longer than declared overflow.  Both sums are JVM window functions over one
shared exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import BLOCK_COLUMN, POSITION, Series, positioned, unpositioned

BLOCK = 2_048
_NEGLIGIBLE = 40.0   # e**-40 is below the resolution of a double
_OVERFLOW = 600.0    # e**600 is well inside the range of a double


def decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _decay_column(span: float | Column) -> Column:
    """The decay, NULL for a span of 1 in a column."""
    return F.nullif(F.lit(1.0) - F.lit(2.0) / (span + F.lit(1.0)), F.lit(0.0)) if isinstance(span, Column) else F.lit(decay(span))


def memory(span: float) -> int:
    """Rows after which an older value no longer changes the mean."""
    r = decay(span)
    return 1 if r <= 0 else math.ceil(_NEGLIGIBLE / -math.log(r))


def width(span: float) -> int:
    """Rows of a block: no fewer than the memory, no more than a double holds."""
    per_row = -math.log(decay(span))
    return min(max(BLOCK, math.ceil(_NEGLIGIBLE / per_row)), int(_OVERFLOW / per_row))


def widths(spans: Iterable[float], known: Iterable[int] = ()) -> dict[float, int]:
    """Rows of a block for each span; spans share a width (a ``known`` one first) that none is too short or too long for.

    Each width takes a sort of its own.
    """
    known, out = sorted(known), {}
    for span in sorted(set(spans)):  # the shortest span holds the fewest rows
        most = int(_OVERFLOW / -math.log(decay(span)))
        out[span] = next((w for w in known if memory(span) <= w <= most), width(span))
        known += [out[span]] if out[span] not in known else []
    return out


def _width_column(span: Column) -> Column:
    per_row = -F.log(_decay_column(span))
    return F.least(F.greatest(F.lit(BLOCK), F.ceil(F.lit(_NEGLIGIBLE) / per_row)), F.floor(F.lit(_OVERFLOW) / per_row))


def ewm_short(df: DataFrame, means: dict[str, tuple[Column, float]], series: Series) -> DataFrame:
    """As ``ewm`` for series that lie within one block of every span by their construction: one running sum for each mean.

    A series that does not raises when it is computed, see ``width``.
    """
    had_position = POSITION in df.columns
    df = positioned(df, series)
    pos = F.col(POSITION)
    sums = {}
    for name, (value, span) in means.items():
        r = decay(span)
        if r > 0:
            share = F.when(pos == 0, F.lit(1.0)).otherwise(F.lit(1.0 - r))
            placed = F.when(pos < width(span), pos).otherwise(F.raise_error(F.lit("a series is longer than a block")).cast("int"))
            sums[name] = F.pow(F.lit(r), pos) * F.sum(value * share * F.pow(F.lit(1.0 / r), placed)).over(series.running())
        else:
            sums[name] = value.cast("double")
    df = df.withColumns(sums)
    return df if had_position else unpositioned(df)


def ewm(df: DataFrame, means: dict[str, tuple[Column, float | Column]], series: Series) -> DataFrame:
    """Add one smoothed column per entry of ``means``: name -> (non-null value, span of at least 1).

    A span may be a column that is constant in each series.  No length of a series is
    assumed.  On a ``positioned`` frame the block columns of fixed spans stay for further
    means, which then share their sort; ``unpositioned`` removes all.
    """
    if low := [span for _, span in means.values() if not isinstance(span, Column) and span < 1]:
        raise ValueError(f"spans {low} are below 1")
    had_position = POSITION in df.columns
    df = positioned(df, series)
    pos = F.col(POSITION)
    smoothed = {n: (v, s) for n, (v, s) in means.items() if isinstance(s, Column) or decay(s) > 0}
    blocks, rows = {}, {}
    had = [int(c.removeprefix(BLOCK_COLUMN)) for c in df.columns if c.startswith(BLOCK_COLUMN) and c.removeprefix(BLOCK_COLUMN).isdigit()]
    fixed = widths((s for _, s in smoothed.values() if not isinstance(s, Column)), had)
    for name, (_, span) in smoothed.items():
        rows[name] = _width_column(span) if isinstance(span, Column) else F.lit(fixed[span])
        blocks[name] = f"{BLOCK_COLUMN}_{name}" if isinstance(span, Column) else f"{BLOCK_COLUMN}{fixed[span]}"
    df = df.withColumns({blk: F.coalesce(F.floor(pos / rows[n]), F.lit(0)).cast("int")
                         for n, blk in blocks.items() if blk not in df.columns})
    place = {n: pos - F.col(blk) * rows[n] for n, blk in blocks.items()}

    weighted = {}
    for name, (value, span) in smoothed.items():
        r = _decay_column(span)
        share = F.when(pos == 0, F.lit(1.0)).otherwise(F.lit(1.0) - r)
        weighted[f"_u_{name}"] = value * share * F.pow(F.lit(1.0) / r, place[name])
    df = df.withColumns(weighted)

    def within(blk):
        return (Window.partitionBy(*series.keys, blk).orderBy(series.order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def before(blk):
        # blocks grow with the order, so this is the same row order and needs no sort of its own
        return (Window.partitionBy(*series.keys).orderBy(blk, series.order)
                .rowsBetween(Window.unboundedPreceding, -1))

    df = df.withColumns({f"_s_{n}": F.sum(f"_u_{n}").over(within(blk)) for n, blk in blocks.items()})
    # the newest finished block is the one before
    df = df.withColumns({f"_e_{n}": F.when(place[n] == rows[n] - 1, F.col(f"_s_{n}")) for n in blocks})
    df = df.withColumns({f"_p_{n}": F.coalesce(F.last(f"_e_{n}", ignorenulls=True).over(before(blk)), F.lit(0.0))
                         for n, blk in blocks.items()})

    out = {}
    for name, (value, span) in means.items():
        if name not in smoothed:  # a span of 1 has no memory
            out[name] = value.cast("double")
            continue
        r = _decay_column(span)
        mean = F.pow(r, place[name]) * (F.col(f"_s_{name}") + F.pow(r, rows[name]) * F.col(f"_p_{name}"))
        if isinstance(span, Column):
            mean = (F.when(span < 1, F.raise_error(F.lit("a span is below 1")).cast("double"))
                    .when(span.isNotNull() & r.isNull(), value).otherwise(mean))
        out[name] = mean
    df = df.withColumns(out)
    df = df.drop(*[f"_{p}_{n}" for n in means for p in "usep"], *[f"{BLOCK_COLUMN}_{n}" for n in means])
    return df if had_position else unpositioned(df)
