"""Filter documents compiled to one Column, so that Catalyst can push them into the scan."""

from __future__ import annotations

from functools import reduce
from numbers import Number
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _one(column: Column, kind: T.DataType, wanted) -> Column | None:
    text = isinstance(kind, T.StringType)
    if isinstance(wanted, dict):
        parts = []
        if wanted.get("min") is not None:
            parts.append(column >= wanted["min"])
        if wanted.get("max") is not None:
            parts.append(column <= wanted["max"])
        if wanted.get("value") is not None:
            parts.append(column == wanted["value"])
        return reduce(and_, parts) if parts else None
    if isinstance(wanted, (list, tuple)):
        return column.isin(list(wanted))
    if isinstance(wanted, bool):
        return column == F.lit(wanted)
    if isinstance(wanted, Number):
        return column.contains(str(wanted)) if text else column == F.lit(wanted)
    if text:
        return column.rlike(str(wanted))
    if isinstance(kind, T.NumericType):
        try:
            return column == F.lit(float(wanted))
        except ValueError:
            return None
    return column == F.lit(wanted)


def compile_filters(schema: T.StructType, document: dict | None) -> Column | None:
    """``{column: scalar | list | {min, max, value}}`` as a Column; None when nothing applies.

    Unknown columns and null values are ignored.  On a string column a number means
    "contains these digits" and a string is a regular expression.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = []
    for name, wanted in (document or {}).items():
        if name in kinds and wanted is not None:
            part = _one(F.col(name), kinds[name], wanted)
            if part is not None:
                parts.append(part)
    return reduce(and_, parts) if parts else None


def apply_filters(df: DataFrame, document: dict | None) -> DataFrame:
    condition = compile_filters(df.schema, document)
    return df if condition is None else df.filter(condition)
