"""Named datasets, freshness and what is still to be processed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .bars import read_tables


class UnknownDataset(KeyError):
    pass


def read_if_there(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame | None:
    """The table, or None when the path does not exist or holds no file yet."""
    try:
        return read_tables(spark, paths)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass
class Datasets:
    """Dataset name -> candidate path groups, tried in order.

    A group is one path, a glob or a list that is concatenated; the first group that
    exists wins.  This covers "one all-years file, else the yearly files" and
    "the new name, else the old one".
    """
    groups: dict[str, list[str | list[str]]] = field(default_factory=dict)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.groups:
            raise UnknownDataset(f"{name}; known: {', '.join(sorted(self.groups))}")
        for group in self.groups[name]:
            found = read_if_there(spark, group)
            if found is not None:
                return found
        raise FileNotFoundError(f"dataset {name}: none of {self.groups[name]} exists")

    def register(self, spark: SparkSession, *names: str) -> None:
        for name in names or self.groups:
            self.load(spark, name).createOrReplaceTempView(name)


def market_data(root: str) -> Datasets:
    """The usual layout under one folder."""
    return Datasets({
        "daily": [f"{root}/daily_all.parquet", f"{root}/daily_2*.parquet"],
        "weekly": [f"{root}/weekly_all.parquet", f"{root}/weekly_2*.parquet"],
        "filtered": [f"{root}/daily_filtered_scored.parquet", f"{root}/daily_filtered.parquet"],
        "minute": [f"{root}/minute.parquet"],
        "minute_features": [f"{root}/minute_features_all.parquet", f"{root}/minute_features.parquet"],
        "macd_day": [f"{root}/macd_day_features.parquet"],
        "events": [f"{root}/events.parquet"],
        "technical": [f"{root}/technical_features.parquet"],
        "scoring_index": [f"{root}/scoring_index.parquet"],
    })


def listing(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: rows and number of columns."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
               .select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_date(*tables: DataFrame, column: str = "date") -> DataFrame:
    """One row: the newest date over all tables, NULL when there is none."""
    newest = [t.agg(F.max(column).alias("latest_date")) for t in tables]
    out = newest[0]
    for t in newest[1:]:
        out = out.unionByName(t)
    return out.agg(F.max("latest_date").alias("latest_date"))


def last_trading_day(today: Column) -> Column:
    """The weekday before ``today``; from Sunday and Monday that is Friday."""
    day = F.weekday(today)  # Monday is 0
    return F.date_sub(today, F.when(day == 0, 3).when(day == 6, 2).otherwise(1))


def freshness(tables: dict[str, DataFrame], today: Column, column: str = "date") -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.max(column).alias("latest_date")).select(
            F.lit(name).alias("name"), "latest_date", last_trading_day(today).alias("expected_date"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("is_fresh", F.coalesce(F.col("latest_date") >= F.col("expected_date"), F.lit(False)))


def not_yet_done(inputs: DataFrame, done: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Input rows whose key has no output yet."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def file_date(path: Column) -> Column:
    """The date in a name such as ``…/2025-01-02.csv.gz``."""
    return F.to_date(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit("")))


def needs_rebuild(inputs: DataFrame, outputs: DataFrame, column: str = "date") -> DataFrame:
    """One row: newest input, newest output and whether the output is behind."""
    a = inputs.agg(F.max(column).alias("latest"), F.lit("input").alias("side"))
    b = outputs.agg(F.max(column).alias("latest"), F.lit("output").alias("side"))
    row = a.unionByName(b).agg(
        F.max(F.when(F.col("side") == "input", F.col("latest"))).alias("input_date"),
        F.max(F.when(F.col("side") == "output", F.col("latest"))).alias("output_date"))
    behind = F.col("input_date").isNotNull() & (
        F.col("output_date").isNull() | (F.col("input_date") > F.col("output_date")))
    return row.withColumn("rebuild", behind)


def listed_files(listing_lines: DataFrame, column: str = "value", end: Column | None = None) -> DataFrame:
    """File names out of storage-listing lines: last of at least four tokens, base name only."""
    tokens = F.split(F.trim(F.col(column)), r"\s+")
    name = F.substring_index(F.element_at(tokens, -1), "/", -1)
    out = listing_lines.filter(F.size(tokens) >= 4).select(name.alias("file")).distinct()
    if end is not None:
        day = file_date(F.col("file"))
        out = out.filter(day <= end)
    return out


def missing_and_extra(expected: DataFrame, present: DataFrame, column: str = "file") -> DataFrame:
    """Both set differences as rows (file, status)."""
    missing = expected.join(present, column, "left_anti").select(column, F.lit("missing").alias("status"))
    extra = present.join(expected, column, "left_anti").select(column, F.lit("extra").alias("status"))
    return missing.unionByName(extra)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that can serve as a factor."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
