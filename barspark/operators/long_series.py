"""Windows over series of any length: cut into blocks, each with the rows it needs around it.

A plain ``partitionBy(ticker)`` window puts a ticker's whole minute history into one
task.  Here every series is numbered with a two-level count (per slice, then slice
offsets), cut into blocks of ``rows`` rows, and the last ``before`` rows of a block
are repeated at the head of the next one (``after`` likewise at its tail).  Window
frames that reach no further than that give the same result per block as over the
whole series, and no task ever holds more than ``rows + before + after`` rows of a
series however hot its ticker is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import Series

_BLOCK = "_block"


def numbered(df: DataFrame, keys: tuple[str, ...], order: str, slice_by: Column, out: str = "_n") -> DataFrame:
    """0-based row number per series without a per-series sort.

    ``slice_by`` must grow with ``order`` (for example its date): slice sizes are
    pre-aggregated, their running total is taken over the few slices of a series,
    and rows are only sorted inside their slice.
    """
    df = df.withColumn("_slice", slice_by)
    sizes = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (df.join(offsets, [*keys, "_slice"])
            .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
            .drop("_slice", "_offset"))


def over_blocks(df: DataFrame, operator: Callable[[DataFrame, Series], DataFrame], keys: tuple[str, ...],
                order: str, slice_by: Column, before: int, after: int = 0, rows: int = 16_384) -> DataFrame:
    """Apply ``operator(df, series)`` block by block; rows repeated at the edges are dropped again.

    ``operator`` must keep the row count and only look ``before`` rows back and
    ``after`` rows ahead.
    """
    if max(before, after) > rows:
        raise ValueError("a block must be longer than its edges")
    n = numbered(df, keys, order, slice_by)
    block = F.floor(F.col("_n") / F.lit(rows)).cast("long")
    place = F.pmod(F.col("_n"), F.lit(rows))
    homes = [F.struct(block.alias("id"), F.lit(True).alias("own"))]
    if before:
        homes.append(F.when(place >= rows - before, F.struct((block + 1).alias("id"), F.lit(False).alias("own"))))
    if after:
        homes.append(F.when((place < after) & (block > 0),
                            F.struct((block - 1).alias("id"), F.lit(False).alias("own"))))
    spread = (n.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
              .withColumns({_BLOCK: F.col("_home.id"), "_own": F.col("_home.own")})
              .drop("_home", "_n"))
    series = Series((*keys, _BLOCK), order, rows + before + after)
    return operator(spread, series).filter("_own").drop("_own", _BLOCK)
