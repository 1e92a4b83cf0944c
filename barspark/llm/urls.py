"""URL filters with dated lists: validity intervals and an as-of join of captures by fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, written

#: Kinds of list patterns; the first one with an active entry decides.
KINDS = ("path", "host", "domain")


def host(url: Column) -> Column:
    """The host in lower case; NULL where the address has none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def patterns(url: Column) -> dict[str, Column]:
    """What each kind of entry is compared with: host and first folder, host, and the last two labels of the host."""
    name = host(url)
    folder = F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^/?#]+)", 1)
    domain = F.regexp_extract(name, r"([^.]+\.[^.]+)\.?$", 1)
    return {"path": F.when(folder != "", F.concat(name, F.lit("/"), folder)), "host": name, "domain": F.when(domain != "", domain)}


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until, blocked): each entry holds from its day to the day before the pattern's next entry.

    Of several entries of a pattern on one day, one that blocks wins. Entries without pattern, kind or day are left out. A pattern has at
    most one row for each day, which bounds the window.
    """
    days = (entries.where("kind IS NOT NULL AND pattern IS NOT NULL AND listed IS NOT NULL")
            .groupBy("kind", "pattern", F.col("listed").cast("date").alias("since")).agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked")))
    return days.withColumn("until", F.lead("since").over(Window.partitionBy("kind", "pattern").orderBy("since")))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds to every capture listed_kind, listed_pattern, listed_since and blocked, by the list as it was on the day of the fetch.

    ``captures``: ``url`` and ``fetched`` (date); ``entries``: ``kind`` (path, host, domain), ``pattern`` in lower case, ``listed``
    (date) and ``action`` (block or allow). The most specific kind with an active entry decides; without one the three columns are NULL and the
    capture is not blocked, and so it is for NULL or damaged addresses and NULL days. Repeated captures keep a row each, an empty list
    blocks nothing, and columns of the four names are replaced.

    Intervals are cut at months and joined on (pattern, month): a capture meets at most a month's intervals of its pattern, and a host
    with a third of all captures is spread over months; what is still skewed is split by the join itself. Only native operations.
    """
    base = captures.drop(*[c for c in captures.columns if c.lower() in ("listed_kind", "listed_pattern", "listed_since", "blocked")])
    list_rows = written(intervals(entries), "list-intervals")
    first, last = base.agg(F.min(F.col("fetched").cast("date")), F.max(F.col("fetched").cast("date"))).first()
    in_range = list_rows.where((F.col("since") <= F.lit(last)) & (F.col("until").isNull() | (F.col("until") > F.lit(first))))
    months = F.sequence(F.greatest(_month(F.col("since")), _month(F.lit(first))),
                        F.least(_month(F.coalesce(F.date_sub("until", 1), F.lit(last))), _month(F.lit(last))))
    cut = in_range.withColumn("month", F.explode(months))
    month, *keys = fresh(base, "month", *[f"key_{k}" for k in KINDS])
    out = base.withColumn(month, _month(F.col("fetched").cast("date")))
    found = []
    for kind, key in zip(KINDS, keys):
        (match,) = fresh(base, f"match_{kind}")
        p, m, s, u = fresh(out, "p", "m", "s", "u")
        of = cut.where(F.col("kind") == kind).select(F.col("pattern").alias(p), F.col("month").alias(m), F.col("since").alias(s), F.col("until").alias(u),
                                                     F.struct(F.lit(kind).alias("kind"), "pattern", "since", "blocked").alias(match))
        day = F.col("fetched").cast("date")
        out = (out.withColumn(key, patterns(F.col("url"))[kind])
               .join(of, (F.col(key) == F.col(p)) & (F.col(month) == F.col(m)) & (day >= F.col(s)) & (F.col(u).isNull() | (day < F.col(u))), "left")
               .drop(key, p, m, s, u))
        found.append(match)
    (best,) = fresh(base, "best")
    out = out.withColumn(best, F.coalesce(*found))
    return (out.withColumn("listed_kind", F.col(best)["kind"]).withColumn("listed_pattern", F.col(best)["pattern"]).withColumn("listed_since", F.col(best)["since"])
            .withColumn("blocked", F.coalesce(F.col(best)["blocked"], F.lit(False))).drop(best, month, *found))
