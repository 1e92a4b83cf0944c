"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.tickers import tradable_only

CODECS = ("zstd", "snappy", "gzip", "lz4", "none")


def rebalanced(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows brought together by partition folder, in tasks of even size.

    Adaptive execution merges small folders into one task and splits a heavy one over
    several, so a folder ends in a few well-sized files, never one per upstream task.
    """
    columns = ", ".join(f"`{k}`" for k in keys)
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({columns}) */ * FROM {{rows}}", rows=df)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd",
                  tradable: bool = True, mode: str = "overwrite", rows_per_file: int = 20_000_000,
                  sort_within: Sequence[str] = ("ticker", "date", "dt")) -> None:
    """Write a bar table; symbols that are not ordinary shares are left out on the way.

    Rows are sorted by ticker inside each file, so that row-group statistics let later
    reads of one ticker skip most of the data.
    """
    if compression not in CODECS:
        raise ValueError(f"compression {compression}; one of {CODECS}")
    if tradable and "ticker" in df.columns:
        df = tradable_only(df)
    if partition_by:
        df = rebalanced(df, partition_by)
    order = [*partition_by, *[c for c in sort_within if c in df.columns and c not in partition_by]]
    if order:
        df = df.sortWithinPartitions(*order)
    writer = (df.write.mode(mode).option("compression", compression)
              .option("maxRecordsPerFile", rows_per_file))
    if partition_by:
        # a rerun replaces the partitions it produces and keeps the others
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_by_date(df: DataFrame, path: str, mode_label: str | None = None, batch: int | None = None) -> None:
    """One folder per date (``mode=…/date=…/batch=…``), replaced folder by folder.

    With a ``batch`` number only that batch's part of a date is replaced.
    """
    keys = ["date"]
    if mode_label is not None:
        df = df.withColumn("mode", F.lit(mode_label))
        keys.insert(0, "mode")
    if batch is not None:
        df = df.withColumn("batch", F.lit(batch))
        keys.append("batch")
    write_parquet(df, path, partition_by=keys, tradable=False)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("ticker",),
                   order: Sequence[str] = ("date",), path: str | None = None, mode: str = "overwrite") -> None:
    """A catalog table whose files are hashed by ``keys`` and sorted.

    Per-ticker windows, groupings and joins over such a table need no exchange at all,
    which is what a large archive that is read every day should be stored as.
    """
    writer = (df.repartition(buckets, *keys).write.mode(mode).format("parquet").option("compression", "zstd")
              .bucketBy(buckets, *keys).sortBy(*keys, *order))
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def _readable(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, dates ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _readable(df).write.mode(mode).json(path, ignoreNullFields=False)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _readable(df).write.mode(mode).csv(path, header=True)
