"""Benchmark passages in training texts: a broadcast hash set of the benchmark's n-grams, scanned natively."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, written

# Fixed separators of words: everything in ASCII but digits and lower-case letters (upper case is lowered first).
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of a benchmark table that are sent to every task, as measured on its written rows; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters unchanged."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def spaced(text: Column, between: str = _BETWEEN) -> Column:
    """The words of a text with one space between them; empty without words or text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), between, " "))


def count_words(text: Column) -> Column:
    s = spaced(text, _BETWEEN_ANY_CASE)
    return F.when(s == "", F.lit(0)).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("long")


def grams(words: Column, n: Column | int) -> Column:
    """All runs of n words of an array; none if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _anchor(n: int) -> int:
    """Any n consecutive words hold one of the runs of this many words that start at its multiples."""
    return (n + 1) // 2


def _limited(small: DataFrame) -> DataFrame:
    """The benchmark's rows for a join: broadcast if the bytes of their texts and numbers allow it."""
    size = reduce(Column.__add__, [F.octet_length(c) + 16 if t == "string" else F.lit(16) for c, t in small.dtypes])
    return F.broadcast(small) if (small.select(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else small.hint("merge")


def benchmark_windows(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(size, win, w): every distinct window of n words (one of all words in shorter items) with a number; (w, item): the items that have it."""
    words = F.split(spaced(lowered(F.col("text"))), " ")
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.element_at("words", 1) != "")
    b = b.withColumn("size", F.least(F.size("words"), F.lit(n)))
    listed = written(b.select("item", "size", F.explode(grams(F.col("words"), F.col("size"))).alias("win")), "item-windows")
    windows = written(listed.select("size", "win").distinct().withColumn("w", F.monotonically_increasing_id()), "benchmark-windows")
    return windows, listed.where("item IS NOT NULL").join(windows, ["size", "win"]).select("w", "item").distinct()


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Adds to every document n_words, n_hit (words inside any occurrence of a benchmark window), hit_words (their
    places, from 0) and items (sorted ids of the items with an occurring window).

    ``docs`` has a column ``text``, ``benchmark`` has ``item_id`` and ``text``. Words are lower-cased in A-Z; NULL and empty texts have none. An item of
    fewer than n words is one window, one without words none. Items without id count as hits but are not listed; ids that repeat are listed once.
    Repeated documents each keep their row, columns of the four names are replaced, and an empty table on either side gives no hits.

    All texts are cut into runs of half a window's words at multiples of that number, of which every occurrence of a window
    holds one whole; only the distinct texts with such a run in the benchmark are searched at every place, on
    the exact words. The benchmark's windows are sent to all tasks if their measured bytes allow it, and joined by a shuffle otherwise, with the same result;
    texts are shuffled only when they are candidates.
    Everything is native.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_hit", "hit_words", "items")])
    windows, items = benchmark_windows(benchmark, n)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # n at most
    k1, k2 = fresh(docs, "key1", "key2")
    keys = [F.xxhash64("text").alias(k1), F.xxhash64("text", F.lit(1)).alias(k2)]
    keyed = docs.select("*", *keys)
    if not sizes:
        return docs.select("*", count_words(F.col("text")).alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"))

    candidates = []
    for a in sorted({_anchor(s) for s in sizes}):
        of = windows.where(F.col("size").isin([s for s in sizes if _anchor(s) == a]))
        anchors = of.select(F.explode(grams(F.split("win", " "), a)).alias("g")).select(F.xxhash64("g").alias("g")).distinct()
        # only A-Z change on both sides: what lower() makes of other letters may depend on their neighbours
        runs = F.regexp_extract_all(spaced(lowered(F.col("text"))), F.lit("[^ ]+" if a == 1 else f"(?:[^ ]+ ){{{a - 1}}}[^ ]+"), F.lit(0))
        found = docs.where("text IS NOT NULL").select(*keys, F.explode(runs).alias("g")).select(k1, k2, F.xxhash64("g").alias("g"))
        candidates.append(found.join(_limited(written(anchors, "anchors")), "g", "left_semi").select(k1, k2))
    chosen = written(reduce(DataFrame.unionAll, candidates).distinct(), "candidate-texts")

    texts = keyed.select(k1, k2, "text").join(chosen, [k1, k2], "left_semi").groupBy(k1, k2).agg(F.first("text").alias("text"))
    words = texts.select(k1, k2, F.split(spaced(lowered(F.col("text"))), " ").alias("words"))
    table = _limited(windows)
    places = reduce(DataFrame.unionAll, [words.select(k1, k2, F.lit(s).alias("size"), F.posexplode(grams(F.col("words"), s)).alias("pos", "win")) for s in sizes])
    hits = written(places.join(table, ["size", "win"]).select(k1, k2, "pos", "size", "w"), "hits")
    covered = (hits.select(k1, k2, F.sequence("pos", F.col("pos") + F.col("size") - 1).alias("at")).groupBy(k1, k2)
               .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hit_words")))
    # a window that many items share meets each text once, however often it occurs in it
    named = hits.select(k1, k2, "w").distinct().join(items, "w").groupBy(k1, k2).agg(F.array_sort(F.collect_set("item")).alias("items"))
    # written, so that the last join deals out both sides anew and a text with many copies can be split
    verdict = written(covered.join(named, [k1, k2], "left"), "verdicts")
    return (keyed.withColumn("n_words", count_words(F.col("text"))).join(verdict, [k1, k2], "left")
            .withColumn("hit_words", F.coalesce("hit_words", F.array().cast("array<int>")))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
            .withColumn("n_hit", F.size("hit_words").cast("long")).drop(k1, k2))


def without_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    if not {"n_words", "n_hit", "hit_words", "items"} & {c.lower() for c in docs.columns}:
        return find(docs, benchmark, n).where("n_hit = 0").select(*docs.columns)
    (whole,) = fresh(docs, "whole")
    return find(docs.select("text", F.struct("*").alias(whole)), benchmark, n).where("n_hit = 0").select(f"{whole}.*")
