"""How a price series is keyed, ordered and framed.

All series operators build their windows from one ``Series`` value, so a chain of
them shares one exchange and, where the order agrees, one sort.

Group sizes.  A bar is unique per (ticker, time), so the rows of one group are
bounded by the calendar, however large its share of the raw ticks is:

* ``DAILY``    one ticker, one bar per day: under 37 000 rows in a century;
* ``WEEKLY``   a seventh of that;
* ``INTRADAY`` one ticker and day, one bar per minute: at most 1 440 rows.

Whole minute histories have no such small bound; ``operators.long_series`` cuts
them into blocks and passes a ``Series`` with a block key instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: str
    max_rows: int

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def running(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.ordered().rowsBetween(-(n - 1), Window.currentRow)

    def next(self, n: int) -> WindowSpec:
        """The n rows after the current one."""
        return self.ordered().rowsBetween(1, n)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def with_keys(self, *more: str, max_rows: int | None = None) -> Series:
        return replace(self, keys=(*self.keys, *more), max_rows=max_rows or self.max_rows)


DAILY = Series(("ticker",), "date", 36_600)
WEEKLY = Series(("ticker",), "week_start", 5_300)
INTRADAY = Series(("ticker", "date"), "dt", 1_440)

#: Rows of a partition, about, for what is sorted by several windows in one task.
PART_ROWS = 50_000


def dealt(df: DataFrame, rows: int, keys: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Rows of a key in one partition, as windows by these keys (or more) need them; a partition's size does not grow with the table.

    ``rows`` is the table's size, or a bound of it; a fixed number of partitions would make each task's sorts grow with it.
    """
    return df.repartition(max(2, math.ceil(rows / part_rows)), *keys)


POSITION = "_pos"
BLOCK_COLUMN = "_blk"


#: Rows from which blocks cost less than a frame that looks at its whole width for each row.
WIDE = 64


def positioned(df: DataFrame, series: Series) -> DataFrame:
    """Add the 0-based row position in the series, once."""
    if POSITION in df.columns:
        return df
    return df.withColumn(POSITION, F.row_number().over(series.ordered()) - 1)


def unpositioned(df: DataFrame) -> DataFrame:
    """Drop the position and what was derived from it."""
    return df.drop(POSITION, *[c for c in df.columns if c.startswith(BLOCK_COLUMN)])


def full(value: Column, n: int, offset: int = 0) -> Column:
    """NULL until ``n`` rows are there (``offset`` rows later for layered windows)."""
    return F.when(F.col(POSITION) >= n - 1 + offset, value)


def previous(column: str | Column, series: Series, n: int = 1) -> Column:
    return F.lag(column, n).over(series.ordered())


def following(column: str | Column, series: Series, n: int = 1) -> Column:
    return F.lead(column, n).over(series.ordered())


def extremes(df: DataFrame, wanted: dict[str, tuple[str, str]], n: int, series: Series, ahead: bool = False,
             wide: int = WIDE) -> DataFrame:
    """Add ``name: (column, "max" or "min")`` over the last ``n`` rows, or the next ``n`` (NULL unless all exist).

    From ``wide`` rows on the work per row doesn't depend on ``n``: the series is cut into
    blocks of ``n`` rows, and any ``n`` neighbouring rows are the end of one block and the
    start of the next, so their extreme is that of a running one from the block's end and
    a running one from the next block's start.
    """
    pick = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    if n < wide:
        rows = series.next(n) if ahead else series.last(n)
        found = {name: pick[kind][0](column).over(rows) for name, (column, kind) in wanted.items()}
        there = F.count(F.lit(1)).over(rows) == n
        return df.withColumns({name: F.when(there, c) for name, c in found.items()} if ahead else found)
    had_position = POSITION in df.columns
    df = positioned(df, series)
    block = f"{BLOCK_COLUMN}_extremes"
    df = df.withColumn(block, F.floor(F.col(POSITION) / n))
    inside = Window.partitionBy(*series.keys, block)
    running = (Window.unboundedPreceding, Window.currentRow)
    start = inside.orderBy(series.order).rowsBetween(*running)
    end = inside.orderBy(F.desc(series.order)).rowsBetween(*running)
    df = df.withColumns({f"_start_{name}": pick[kind][0](c).over(start) for name, (c, kind) in wanted.items()})
    df = df.withColumns({f"_end_{name}": pick[kind][0](c).over(end) for name, (c, kind) in wanted.items()})
    out = {}
    for name, (_, kind) in wanted.items():
        # a row without n - 1 before it lies in the first block, whose start is all there is
        both = ((following(f"_end_{name}", series), following(f"_start_{name}", series, n)) if ahead
                else (previous(f"_end_{name}", series, n - 1), F.col(f"_start_{name}")))
        value = pick[kind][1](*both)
        out[name] = F.when(following(POSITION, series, n).isNotNull(), value) if ahead else value
    df = df.withColumns(out).drop(block, *[f"_{side}_{name}" for name in wanted for side in ("start", "end")])
    return df if had_position else df.drop(POSITION)
