"""Increments of date-partitioned tables: a log of finished dates beside the partition metadata of the source.

What is pending is decided from folder names and folder summaries alone, no file of the source or the target is opened
for it; the dates that are left become a partition filter, so that the files of other dates are never read.  A date is logged
when its output is written, empty outputs too, with a mark of what its input was; a changed input makes it pending again.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .datasets import read_if_there

LOG_SCHEMA = "date date, mark string, at timestamp"


def _filesystem(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def partitions(spark: SparkSession, path: str, key: str = "date") -> dict[datetime.date, tuple[str, list[str]]]:
    """The dates of a table in folders ``…/date=…``, each with a mark of its content and its folders; one entry for each day at most."""
    fs, place = _filesystem(spark, path)
    found: dict[datetime.date, tuple[str, list[str]]] = {}
    todo = [place] if fs.exists(place) else []
    while todo:
        for status in fs.listStatus(todo.pop()):
            name = status.getPath().getName()
            if not status.isDirectory() or name.startswith(("_", ".")):
                continue
            if not name.startswith(f"{key}="):
                todo.append(status.getPath())
                continue
            try:
                day = datetime.date.fromisoformat(name[len(key) + 1:])
            except ValueError:  # rows without a date
                continue
            summary = fs.getContentSummary(status.getPath())
            mark = f"{summary.getFileCount()}:{summary.getLength()}:{status.getModificationTime()}"
            before, folders = found.get(day, ("", []))
            found[day] = ("|".join(sorted([*filter(None, before.split("|")), mark])), [*folders, status.getPath().toString()])
    return found


def finished(spark: SparkSession, log: str) -> dict[datetime.date, str]:
    """The mark with which each date was finished last."""
    rows = read_if_there(spark, log)
    if rows is None:
        return {}
    last = rows.groupBy("date").agg(F.max_by("mark", "at").alias("mark"))
    return {r["date"]: r["mark"] for r in last.collect()}


def pending(spark: SparkSession, source: str, log: str, key: str = "date") -> dict[datetime.date, str]:
    """Dates of the source that the log lacks or has with another content."""
    done = finished(spark, log)
    return {day: mark for day, (mark, _) in sorted(partitions(spark, source, key).items()) if done.get(day) != mark}


def of_dates(table: DataFrame, dates: list[datetime.date], key: str = "date") -> DataFrame:
    """The rows of some dates; on a partitioned table a filter of folders."""
    return table.filter(F.col(key).isin(dates))


def run(spark: SparkSession, source: str, target: str, log: str, write: Callable[[DataFrame], None], key: str = "date") -> list[datetime.date]:
    """Computes what is pending: ``write`` gets the source's rows of those dates and writes their output; the dates are returned.

    The log is written last, so a run that fails is done again in full; writers that replace folders give the same result then.
    Folders that an earlier content of a date left in the target are removed first, since its new output may be empty.
    """
    todo = pending(spark, source, log, key)
    if not todo:
        return []
    done, old = finished(spark, log), partitions(spark, target, key)
    for day in todo:
        if day in done:
            for folder in old.get(day, ("", []))[1]:
                fs, place = _filesystem(spark, folder)
                fs.delete(place, True)
    dates = list(todo)
    write(of_dates(spark.read.parquet(source), dates, key))
    rows = spark.createDataFrame(list(todo.items()), "date date, mark string").withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(log)
    return dates
