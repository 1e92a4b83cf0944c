"""Session settings the plans are written for."""

from __future__ import annotations

# Adaptive execution coalesces small shuffle partitions, splits skewed join partitions and
# turns joins into broadcasts by measured size, so the plans carry no size hints.  On a
# cluster, start from many shuffle partitions (a few per core) and let it coalesce.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",            # bar times are naive UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown.enabled": "true",  # max(date) from file footers
}
