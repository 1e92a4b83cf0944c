"""Structured Streaming over a growing folder of bar files.

Files already processed are remembered by the query's checkpoint, which replaces
"skip a date whose output exists".  ``available_now`` handles what is there and stops;
the same plans run continuously with another trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ewm import decay
from ..sources import bars as feeds
from ..sources.sinks import write_by_date


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
REJECTED_SCHEMA = "path string, header string, reason string, batch long"


def feed_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The names of new CSV files of the flat-file feed as they come; their content is not read."""
    return (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv*").option("maxFilesPerTrigger", files_per_batch).load(path).select("path"))


def _unfit(header: str) -> str | None:
    """Why a file cannot be read by its header."""
    names = feeds.columns_of(header)
    if not header:
        return "no readable header"
    if lacks := sorted(set(feeds.REQUIRED) - set(names)):
        return f"lacks {', '.join(lacks)}"
    return "repeats a column" if len({n.lower() for n in names}) < len(names) else None


def ingest_days(spark: SparkSession, source: str, target: str, checkpoint: str, unit: str = "ns",
                files_per_batch: int = 100, rejected: str | None = None) -> None:
    """Append new feed files to a minute table in folders ``date=…/batch=…``.

    The stream is one of file names. Every batch looks at the headers of its files and reads them layout by layout, columns by name; files
    that lack a feed column or have no readable header are set aside: their names, headers and reasons go to ``rejected`` (beside the target
    unless given), in a folder for each batch. A batch that is retried after a failure replaces what it wrote before and nothing else, so files of one date
    may arrive in any number of batches.
    """
    aside = rejected or f"{target.rstrip('/')}_rejected"

    def write(batch: DataFrame, number: int) -> None:
        known = feeds.headers(spark, [r["path"] for r in batch.collect()])  # files_per_batch at most
        unfit = {name: reason for name, header in known.items() if (reason := _unfit(header))}
        if unfit:
            rows = [(name, known[name], reason, number) for name, reason in sorted(unfit.items())]
            spark.createDataFrame(rows, REJECTED_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{aside}/batch={number}")
        files = [name for name in known if name not in unfit]
        if files:
            raw = feeds.read_files(spark, files, lenient=True, known=known)
            write_by_date(feeds.minute_bars(raw, unit, lenient=True, tradable=True), target, batch=number)

    query = (feed_files(spark, source, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def resampled(bars: DataFrame, minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Streaming OHLCV bars; a bar is emitted once the watermark passes its end, later rows are dropped.

    Open and close need an order inside the bar: rows carry ``dt`` or a finer ``at``.
    """
    at = "at" if "at" in bars.columns else "dt"
    return (bars.withWatermark("dt", lateness)
            .groupBy("ticker", F.window("dt", f"{minutes} minutes").alias("w"))
            .agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
            .select("ticker", F.col("w.start").alias("dt"), "open", "high", "low", "close", "volume"))


CROSS_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("dt", T.TimestampType()),
    T.StructField("event_type", T.StringType()), T.StructField("hist", T.DoubleType()),
    T.StructField("hist_prev", T.DoubleType()), T.StructField("entry_close", T.DoubleType())])

STATE_SCHEMA = T.StructType([
    T.StructField("last", T.LongType()), T.StructField("fast", T.DoubleType()), T.StructField("slow", T.DoubleType()),
    T.StructField("signal", T.DoubleType()), T.StructField("hist", T.DoubleType())])


def _smooth(values: pd.Series, start: float | None, span: int) -> pd.Series:
    """Continue an exponentially weighted mean from ``start``."""
    if start is not None:
        values = pd.concat([pd.Series([start]), values], ignore_index=True)
    out = values.ewm(span=span, adjust=False).mean()
    return out if start is None else out.iloc[1:].reset_index(drop=True)


def _crosses(fast: int, slow: int, signal: int):
    assert 0 < decay(fast) < decay(slow)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, f, s, g, h = state.get if state.exists else (None,) * 5
        # one ticker's rows of one micro-batch; the batch size is bounded by the source options
        rows = pd.concat(list(batches)).sort_values("dt", kind="stable").drop_duplicates("dt")
        at = rows["dt"].astype("datetime64[us]").astype("int64")
        if last is not None:
            rows, at = rows[at > last], at[at > last]  # older than what the means already contain
        if rows.empty:
            return
        rows = rows.reset_index(drop=True)
        close = rows["close"].astype(float)
        fasts, slows = _smooth(close, f, fast), _smooth(close, s, slow)
        line = fasts - slows
        signals = _smooth(line, g, signal)
        hist = line - signals
        before = hist.shift(1)
        if h is not None:
            before.iloc[0] = h
        up, down = (before <= 0) & (hist > 0), (before >= 0) & (hist < 0)
        state.update((int(at.iloc[-1]), float(fasts.iloc[-1]), float(slows.iloc[-1]), float(signals.iloc[-1]),
                      float(hist.iloc[-1])))
        hit = up | down
        if hit.any():
            yield pd.DataFrame({
                "ticker": key[0], "dt": rows["dt"][hit], "event_type": up[hit].map({True: "cross_up", False: "cross_down"}),
                "hist": hist[hit], "hist_prev": before[hit], "entry_close": close[hit]})

    return step


def macd_crosses(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Streaming histogram crossings; the state per ticker is three means, the last histogram and time."""
    return (bars.select("ticker", "dt", "close").groupBy("ticker")
            .applyInPandasWithState(_crosses(fast, slow, signal), CROSS_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.NoTimeout))


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available into a Parquet table and stop."""
    (stream.writeStream.format("parquet").outputMode(mode).option("path", target)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
