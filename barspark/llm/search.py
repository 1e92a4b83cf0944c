"""Exact top-k search by inner product with pivot tables: distances to pivots bound every score from above."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_path, written

#: Rows from which pivots are chosen and first thresholds taken, and queries that are sent to the tasks together.
SAMPLE, PIVOTS, QUERY_BLOCK = 512, 16, 5_000
_LOW = np.iinfo(np.int64).min


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; NULL for vectors that are NULL or hold NULL or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    return np.sqrt(np.stack([((a - p) ** 2).sum(axis=1) for p in b], axis=1)) if len(b) else np.zeros((len(a), 0))


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each is the row farthest from those before it; fewer where rows repeat."""
    chosen = [rows[0]]
    gap = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(rows[int(gap.argmax())])
        gap = np.minimum(gap, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return np.stack(chosen)


@dataclass
class Queries:
    """A block of queries with their distances to the pivots and scores that their k-th best result reaches at least."""

    ids: np.ndarray
    vectors: np.ndarray
    distances: np.ndarray
    least: np.ndarray


class Best:
    """The k best candidates of each query that one task has seen so far."""

    def __init__(self, q: Queries, k: int):
        self.q, self.k = q, k
        self.scores = np.full((len(q.ids), k), _LOW, np.int64)
        self.ids = np.full((len(q.ids), k), np.iinfo(np.int64).max, np.int64)
        self.least = q.least.copy()
        self.norms = (q.vectors ** 2).sum(axis=1)

    def add(self, ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray) -> None:
        """Candidates in the order of their bounds, until no bound reaches the k-th score."""
        q = self.q
        norms = (vectors ** 2).sum(axis=1)
        whole = np.abs(vectors).max(initial=0.0) * np.abs(q.vectors).max(initial=0.0) * max(1, vectors.shape[1]) < 2.0**53
        step = max(1, 2_000_000 // max(1, len(ids)))
        for a in range(0, len(q.ids), step):
            far = np.zeros((min(step, len(q.ids) - a), len(ids)))
            for p in range(distances.shape[1]):  # the largest of all lower bounds of the distance
                np.maximum(far, np.abs(q.distances[a:a + step, p, None] - distances[None, :, p]), out=far)
            both = self.norms[a:a + step, None] + norms[None, :]
            bound = 0.5 * (both - far * far) + 1e-9 * both + 1e-6
            for i in range(len(far)):
                self._one(a + i, ids, vectors, bound[i], whole)

    def _one(self, i: int, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, whole: bool) -> None:
        alive = np.flatnonzero(bound >= self.least[i])
        alive = alive[np.argsort(-bound[alive], kind="stable")]
        at, step = 0, 64
        while at < len(alive) and bound[alive[at]] >= self.least[i]:
            some = alive[at:at + step]
            at, step = at + step, min(4096, step * 2)
            if whole:
                score = np.rint(vectors[some] @ self.q.vectors[i]).astype(np.int64)
            else:  # beyond the whole numbers of a double; kept within a long
                exact = vectors[some].astype(np.int64).astype(object) @ self.q.vectors[i].astype(np.int64).astype(object)
                score = np.array([max(_LOW + 1, min(-_LOW - 1, int(s))) for s in exact], np.int64)
            good = (score >= self.least[i]) & (ids[some] != self.q.ids[i])
            if good.any():
                s, x = np.concatenate([self.scores[i], score[good]]), np.concatenate([self.ids[i], ids[some][good]])
                top = np.lexsort((x, ~s))[: self.k]
                self.scores[i], self.ids[i] = s[top], x[top]
                self.least[i] = max(self.least[i], float(self.scores[i, -1]))

    def rows(self) -> pa.RecordBatch:
        n, r = np.nonzero(self.scores > _LOW)
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[n]), pa.array(self.ids[n, r]), pa.array(self.scores[n, r])], ["query_id", "vec_id", "score"])


def _sample_thresholds(ids, vectors, sample_ids, sample, k) -> np.ndarray:
    """The k-th best score of each query among the sampled rows; a little less, to be safe against rounding."""
    least = np.full(len(ids), -np.inf)
    if len(sample) > k:
        scores = vectors @ sample.T
        scores[ids[:, None] == sample_ids[None, :]] = -np.inf
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        least = kth - 1e-9 * np.abs(kth) - 1
    return least


def top_k(df: DataFrame, is_query: Callable[[Column], Column], k: int = 5, key: str = "vec_id", vector: str = "vector", sample: int = SAMPLE,
          pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For every row whose key meets the condition ``is_query`` the k other rows with the highest inner product:
    query_id, rank, vec_id, score; ties go to the smaller id, and all are returned where there are fewer than k.

    ``vector`` holds whole numbers (array of long). Rows without key or vector take no part, rows that repeat key and vector count once, and
    vectors are only compared with others of their length. An empty table gives an empty result.

    Pivots are chosen farthest-first from ``sample`` rows with the lowest hashes (that bound is the only sampling; any pivots give the
    exact result). The table with its distances to all pivots is written once. By the triangle inequality the largest difference of two rows' distances
    to a pivot bounds their distance from below, and so their product from above; each task evaluates candidates in the order of
    that bound and stops when it falls below the k-th score. Queries are sent to the tasks in blocks of ``query_block``, one
    after the other: what a block's tasks found (at most k rows for one query and task) is written and its broadcast destroyed before the next
    block is collected, so that neither the driver nor a task holds more than one block.
    """
    spark = df.sparkSession
    rows = (df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
            .groupBy("id", "v").agg(F.first(F.size("v")).alias("width")))
    rows = written(rows, "vectors")
    partial_schema, out = "query_id long, vec_id long, score long", shared_path(spark, "best-of-tasks")
    spark.createDataFrame([], partial_schema).write.parquet(out)
    for width in sorted(r["width"] for r in rows.select("width").distinct().collect()):
        of = rows.where(F.col("width") == width).select("id", "v")
        some = of.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
        sample_ids, near = np.array([r["id"] for r in some], np.int64), np.array([r["v"] for r in some], np.float64).reshape(len(some), width)
        centres = farthest_first(near, pivots)

        def measured(batches: Iterator[pa.RecordBatch], centres=centres, width=width) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _distances(_matrix(b.column(1), width, np.float64), centres)
                lists = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], d.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "v", "d"])

        table = written(of.mapInArrow(measured, "id long, v array<long>, d array<double>"), "pivot-table")
        queries = table.where(is_query(F.col("id")))
        blocks = math.ceil(queries.count() / query_block)
        for n in range(blocks):
            asked = queries.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == n).collect()
            if not asked:
                continue
            ids, vectors = np.array([r["id"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64).reshape(len(asked), width)
            block = Queries(ids, vectors, np.array([r["d"] for r in asked], np.float64).reshape(len(asked), -1), _sample_thresholds(ids, vectors, sample_ids, near, k))
            sent = spark.sparkContext.broadcast(block)

            def partial(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
                best = Best(sent.value, k)
                for b in batches:
                    d = b.column(2)
                    best.add(b.column(0).to_numpy(), _matrix(b.column(1), width, np.float64), _matrix(d, len(d.flatten()) // len(d), np.float64))
                yield best.rows()

            table.mapInArrow(partial, partial_schema).write.mode("append").parquet(out)
            sent.destroy()
    found = spark.read.schema(partial_schema).parquet(out)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

