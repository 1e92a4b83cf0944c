"""Flat-file bar feeds: gzip CSV, one file per trading date, or any Parquet layout."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.tickers import tradable_only

# Column names of the feed and the names they are known by here.
ALIASES = {"symbol": "ticker", "timestamp": "window_start", "t": "window_start"}
PRICES = ("open", "high", "low", "close")
TICKS_PER_MICRO = {"ns": (1, 1_000), "us": (1, 1), "ms": (1_000, 1), "s": (1_000_000, 1)}


def epoch_to_timestamp(value: Column, unit: str = "ns") -> Column:
    times, per = TICKS_PER_MICRO[unit]
    if per > 1:
        # whole division, rounding down also before 1970
        micros = F.call_function("div", value - F.pmod(value, F.lit(per)), F.lit(per))
    else:
        micros = value * F.lit(times)
    return F.timestamp_micros(micros)


def normalise(raw: DataFrame, unit: str = "ns", lenient: bool = False) -> DataFrame:
    """Alias, cast and date raw feed rows.

    Strict mode fails on a bad number; lenient mode nulls it and drops rows whose
    time does not parse.
    """
    present = {a: n for a, n in ALIASES.items() if a in raw.columns and n not in raw.columns}
    df = raw.withColumnsRenamed(present)

    def cast(name: str, kind: str) -> Column:
        c = F.col(name)
        return c.try_cast(kind) if lenient else c.cast(kind)

    casts = {p: cast(p, "double") for p in PRICES if p in df.columns}
    if "volume" in df.columns:
        casts["volume"] = cast("volume", "long")
    casts["window_start"] = cast("window_start", "long")
    df = df.withColumns(casts)
    if lenient:
        df = df.filter(F.col("window_start").isNotNull())
    return df.withColumn("dt", epoch_to_timestamp(F.col("window_start"), unit))


#: Bytes of a file within which its header has to end, and files that are looked at together.
_HEADER_BYTES, _TOGETHER = 1 << 16, 16
#: Columns that a feed file must have.
REQUIRED = ("ticker", "window_start", *PRICES, "volume")


def _header(spark: SparkSession, name: str) -> str:
    """The first line with text in the first block of a file, read through the file system and codec that Spark itself uses."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        opened = codec.createInputStream(stream) if codec else stream
        some = jvm.com.google.common.io.ByteStreams.limit(opened, _HEADER_BYTES)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(some, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return (line or "").removeprefix("\ufeff").strip()
    finally:
        stream.close()


def headers(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """The header of each file ("" of an empty or unreadable one); one short read of each file, several at a time."""
    def read(name: str) -> str:
        try:
            return _header(spark, name)
        except Py4JJavaError:
            return ""

    with ThreadPoolExecutor(_TOGETHER) as pool:
        return dict(zip(files, pool.map(read, files)))


def columns_of(header: str) -> list[str]:
    """Names in a header, known by their usual names."""
    names = [n.strip().strip('"') for n in header.split(",")]
    return [ALIASES[n] if n in ALIASES and ALIASES[n] not in names else n for n in names]


def read_files(spark: SparkSession, files: Sequence[str], lenient: bool = False, known: dict[str, str] | None = None) -> DataFrame:
    """CSV files as rows of strings, each layout by its own header and all put together by the known names of their columns.

    A further column is NULL where a layout lacks it; a feed column that only some layouts have raises. ``known`` has headers read before.
    """
    known = known if known is not None else headers(spark, files)
    layouts = defaultdict(list)
    for name in sorted(files):
        layouts[known[name]].append(name)
    feed = {c for header in layouts for c in columns_of(header)} & set(REQUIRED)
    reader = (spark.read.option("header", True).option("enforceSchema", False)
              .option("mode", "PERMISSIVE" if lenient else "FAILFAST"))
    parts = []
    for header, names in layouts.items():
        if lacks := sorted(feed - set(columns_of(header))):
            raise ValueError(f"{names[0]} lacks the columns {lacks} of other files")
        # a file's name is no pattern
        raw = reader.csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names])
        parts.append(raw.withColumnsRenamed({a: n for a, n in ALIASES.items() if a in raw.columns and n not in raw.columns}))
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)


def feed_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Names of the CSV files under some paths; nothing is read."""
    listed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").text([path] if isinstance(path, str) else list(path))
    return [unquote(f) for f in listed.inputFiles()]


def read_feed(spark: SparkSession, path: str | Sequence[str], lenient: bool = False) -> DataFrame:
    """Raw CSV rows as strings; no type inference pass and no pass over the rows to find the layouts, see :func:`read_files`."""
    files = feed_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no CSV file under {path}")
    return read_files(spark, files, lenient)


def daily_bars(raw: DataFrame, unit: str = "ns") -> DataFrame:
    df = normalise(raw, unit).withColumn("date", F.to_date("dt"))
    keep = [c for c in ("date", "ticker", *PRICES, "volume") if c in df.columns]
    return df.select(*keep).withColumns({"year": F.year("date"), "month": F.month("date")})


def minute_bars(raw: DataFrame, unit: str = "ns", lenient: bool = False, tradable: bool = False) -> DataFrame:
    df = normalise(raw, unit, lenient).withColumn("date", F.to_date("dt"))
    keep = [c for c in ("date", "dt", "ticker", *PRICES, "volume") if c in df.columns]
    df = df.select(*keep)
    if tradable:
        df = tradable_only(df)
    return df.withColumns({"hour": F.hour("dt"), "minute": F.minute("dt"),
                           "year": F.year("date"), "month": F.month("date")})


def read_tables(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One path, a list or a glob of Parquet; lists are concatenated by column name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)


FEED_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("volume", T.StringType()),
    *[T.StructField(p, T.StringType()) for p in PRICES],
    T.StructField("window_start", T.StringType()),
])
