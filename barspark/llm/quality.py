"""A quality classifier made of sparse rules: tree paths over text statistics, weighted by a lasso logistic fit."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text, all between native expressions; empty texts give zeros."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    words = F.array_remove(F.split(t, r"\s+"), "")
    n = F.size(words).cast("double")
    share = lambda part, of: F.when(of > 0, part / of).otherwise(F.lit(0.0))
    gone = lambda pattern: chars - F.length(F.regexp_replace(t, pattern, ""))
    return {
        "words": n,
        "word_length": share(chars, n),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), n),
        "upper": share(gone(r"\p{Lu}+"), chars),
        "letters": share(gone(r"\p{L}+"), chars),
        "digits": share(gone(r"[0-9]+"), chars),
        "marks": share(gone(r"[#$%&*|!~^<>{}=+\\@]+"), chars),
        "lone_marks": share(F.regexp_count(t, F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")).cast("double"), n),
        "stops": share(gone(r"[.,;:?]+"), n),
        "twins": share(F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s\1(?!\S)")).cast("double"), n),
        "lines": share(gone(r"\n+"), n),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    at_most: bool
    bound: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.name] <= self.bound if self.at_most else values[self.name] > self.bound


Rule = tuple[Condition, ...]


def _paths(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """The conditions from the root to every node below it: inner nodes give the shorter rules."""
    found = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, bound = names[split.featureIndex()], float(split.threshold())
        found += _paths(node.leftChild(), names, (*path, Condition(name, True, bound)))
        found += _paths(node.rightChild(), names, (*path, Condition(name, False, bound)))
    return found


def _tidy(rule: Rule) -> Rule:
    """Only the tightest bound of each side of a statistic, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for c in rule:
        k = (c.name, c.at_most)
        best[k] = c.bound if k not in best else (min if c.at_most else max)(best[k], c.bound)
    return tuple(Condition(n, m, b) for (n, m), b in sorted(best.items()))


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions of bounds on statistics; ``score`` compiles them into one Spark column."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, values: dict[str, Column]) -> Column:
        """The probability of label 1."""
        terms = [F.when(reduce(Column.__and__, (c.column(values) for c in rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(self.intercept))))


def labelled(docs: DataFrame, labels: DataFrame, bound: int, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(text, label) of at most about ``bound`` labelled documents, those whose keys hash lowest.

    A key with several labels gets the more frequent one (1 in a tie); NULL keys and labels are left out. Only the keys
    and labels are counted and thinned; the texts are fetched for the chosen keys alone, whose number has that bound.
    """
    one = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key"))
           .agg((F.avg(label) >= 0.5).cast("double").alias("label")))
    n = one.count()
    if n > bound:
        cut = int(2**63 * (2 * bound / n - 1))  # hashes lie evenly between -2**63 and 2**63
        one = one.where(F.xxhash64("key", F.lit(7)) < cut)
    return docs.select(F.col(key).alias("key"), "text").join(F.broadcast(one), "key").select("text", "label")


def fit(sample: DataFrame, trees: int = 12, depth: int = 4, strength: float = 0.0005, seed: int = 5) -> RuleEnsemble:
    """Rules from a forest of shallow trees over the statistics, and their weights from a logistic fit with an L1 penalty.

    Rules with weight zero are dropped. Without both labels in the sample the ensemble has no rules, and its score is
    the share of label 1 (0.5 without any row).
    """
    values = statistics(F.col("text"))
    names = list(values)
    # one statistic is used by many rules: computed once, in the order of the names
    rows = sample.select("label", *[v.alias(n) for n, v in values.items()]).cache()
    try:
        count, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < ones < count:
            p = min(max((ones + 0.5) / (count + 1), 0.01), 0.99)
            return RuleEnsemble(math.log(p / (1 - p)), ())
        table = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features", *names)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed,
                                        minInstancesPerNode=20 if count > 400 else 1).fit(table)
        rules = sorted({_tidy(r) for t in forest.trees for r in _paths(t._call_java("rootNode"), names)}, key=str)
        if not rules:
            p = ones / count
            return RuleEnsemble(math.log(p / (1 - p)), ())
        cols = {n: F.col(n) for n in names}
        hits = F.array(*[F.when(reduce(Column.__and__, (c.column(cols) for c in r)), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules])
        from pyspark.ml.functions import array_to_vector
        fired = rows.select("label", array_to_vector(hits).alias("features"))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=strength, standardization=False, maxIter=60).fit(fired)
        weights = lasso.coefficients.toArray()
        return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0.0))
    finally:
        rows.unpersist()


def _scored(df: DataFrame, model: RuleEnsemble, text: str, threshold: float, **fixed: Column) -> tuple[DataFrame, list[str]]:
    """The table with statistics, score and predicted, and the names of the helper columns."""
    values = statistics(F.col(text))
    names = dict(zip(values, fresh(df, *values)))
    # columns of their own: many rules use each of them
    out = df.select("*", *[v.alias(names[n]) for n, v in values.items()], *[c.alias(n) for n, c in fixed.items()])
    out = out.withColumn("score", model.score({n: F.col(c) for n, c in names.items()}))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), [*names.values(), *fixed]


def score(df: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (probability of label 1) and ``predicted`` (1 from the threshold on) to every row, by native expressions.

    NULL and empty texts are scored as texts without words. Columns of these names are replaced, other columns stay; repeated rows
    get the same score; an empty table gives an empty one. Nothing is shuffled.
    """
    out, helpers = _scored(df, model, text, threshold)
    return out.drop(*helpers)


def accepted(df: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that :func:`score` predicts as 1, with their own columns, whatever their names; NULL and empty texts are judged as texts without words.

    A filter on ``predicted`` would be moved below the statistics and write each of them into every rule. A row number stands beside them here
    and takes part in the condition; filters are not moved below it, so each statistic is computed once a row.
    """
    whole, row = fresh(df, "whole", "row")
    kept = df.select(F.col(text).alias("text"), F.struct("*").alias(whole))
    out, _ = _scored(kept, model, "text", threshold, **{row: F.monotonically_increasing_id()})
    return out.where((F.col("predicted") == 1) & (F.col(row) >= 0)).select(f"{whole}.*")


def held_out(key: Column) -> Column:
    """Documents that take no part in learning: the CRC-32 of the key as text leaves no remainder by five."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0
