"""Arithmetic with one NULL policy: a ratio over zero is NULL, never inf or an ANSI error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TRADING_DAYS = 252


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(now: Column, before: Column) -> Column:
    """now / before - 1."""
    return ratio(now, before) - F.lit(1.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, for reports and engine-to-engine comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            # + 0.0 turns a rounded -0.0 into 0.0
            c = (F.round(c, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)
