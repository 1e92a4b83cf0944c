"""Hard negatives of anchors: a secondary sort by score, read as a stream that opens windows at positives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_path, written

#: Anchors that are sent to the tasks together, and products that a task holds at a time.
ANCHOR_BLOCK, _PRODUCTS = 4_096, 2_000_000
_LOW = np.iinfo(np.int64).min
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _scores(vectors: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows with all anchors; beyond a long they stay at its ends."""
    width = max(1, vectors.shape[1])
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * width < 2.0**53:
        return np.rint(anchors.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ vectors.astype(object).T
    return np.array([[max(_LOW + 1, min(-_LOW - 1, int(s))) for s in row] for row in exact], np.int64).reshape(len(anchors), len(vectors))


class Anchors:
    """A block of anchors; ``windows`` has, for each of them, the scores of its positives, highest first."""

    def __init__(self, rows: list):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)
        self.windows: list[np.ndarray] = []


class Best:
    """The k highest (score, id) of each slot that a task has seen, ties to smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = np.full((slots, k), _LOW, np.int64)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max, np.int64)

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.scores[slot, -1]
        if good.any():
            s, i = np.concatenate([self.scores[slot], scores[good]]), np.concatenate([self.ids[slot], ids[good]])
            top = np.lexsort((i, ~s))[: self.k]
            self.scores[slot], self.ids[slot] = s[top], i[top]


def _parts(batches: Iterator[pa.RecordBatch], block: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Ids, labels, number of the first anchor, and scores by anchor and row, of as many anchors at a time as fit."""
    for b in batches:
        if not len(b):
            continue
        ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
        vectors = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        step = max(1, _PRODUCTS // len(b))
        for a in range(0, len(block.ids), step):
            yield ids, labels, a, _scores(vectors, block.vectors[a:a + step])


def _keyed(n: list, score: list, kind: int, ids: list) -> pa.RecordBatch:
    """Rows under the key (anchor, descending score, positives first, id); the first score is the pair's, the second the sort's."""
    score = np.array(score, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.array(n, np.int32)), pa.array(~score), pa.array(np.full(len(score), kind, np.int8)), pa.array(np.array(ids, np.int64))],
                                      ["n", "down", "kind", "id"])


_KEYS = "n int, down long, kind byte, id long"


def _positives(sent, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of each anchor's label in this task."""
        block: Anchors = sent.value
        best = Best(len(block.ids), k)
        for ids, labels, a, scores in _parts(batches, block):
            for i in range(len(scores)):
                same = (labels == block.labels[a + i]) & (ids != block.ids[a + i]) & (scores[i] >= best.scores[a + i, -1])
                if same.any():
                    best.add(a + i, scores[i][same], ids[same])
        n, place = np.nonzero(best.scores > _LOW)
        yield _keyed(n.tolist(), best.scores[n, place], 0, best.ids[n, place])
    return rows


def _negatives(sent, low: int, high: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of other labels in each window, as far as this task has them; a row in several windows once."""
        block: Anchors = sent.value
        most = max(map(len, block.windows), default=0)
        best = Best(len(block.ids) * max(1, most), k)
        for ids, labels, a, scores in _parts(batches, block):
            for i in range(len(scores)):
                windows = block.windows[a + i]
                if not len(windows):
                    continue
                # whole numbers of Python: 100 times a score may pass the end of a long
                ends = [(-((-low * int(w)) // 100), high * int(w) // 100) for w in windows]
                first, last = min(e[0] for e in ends), max(e[1] for e in ends)
                some = np.flatnonzero((labels != block.labels[a + i]) & (scores[i] >= max(first, _LOW)) & (scores[i] <= min(last, -_LOW - 1)))
                for j, (least, greatest) in enumerate(ends):
                    if least <= greatest:
                        inside = some[(scores[i][some] >= least) & (scores[i][some] <= greatest)]
                        best.add((a + i) * most + j, scores[i][inside], ids[inside])
        slot, place = np.nonzero(best.scores > _LOW)
        found = np.unique(np.stack([slot // max(1, most), best.scores[slot, place], best.ids[slot, place]]), axis=1)
        yield _keyed(found[0].tolist(), found[1], 1, found[2])
    return rows


def _sorted(pairs: DataFrame) -> DataFrame:
    """The shuffle: partitions by anchor, sorted within by the packed key."""
    return pairs.repartition("n").sortWithinPartitions("n", "down", "kind", "id")


def _first(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first k distinct rows of each anchor in a sorted stream."""
        now, seen, last = None, 0, None
        for b in batches:
            keep = []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                if key[0] != now:
                    now, seen = key[0], 0
                if seen < k and key != last:
                    keep.append(i)
                    seen += 1
                last = key
            yield b.take(pa.array(keep, pa.int64()))
    return rows


def _stream(low: int, high: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the sorted pairs: a positive opens a window below its score, negatives go into all windows open at their score.

        Only the open windows of one anchor are held: at most one for each positive.
        """
        now, windows, last = None, [], None
        for b in batches:
            out: list[tuple] = []
            for n, down, kind, i in zip(*[c.to_pylist() for c in b.columns]):
                score = ~down
                if n != now:
                    now, windows = n, []
                if (n, down, kind, i) == last:  # tasks that were run twice, and rows that repeat
                    continue
                last = (n, down, kind, i)
                if kind == 0:
                    windows.append([i, score, 0])
                    continue
                windows = [w for w in windows if w[2] < k and low * w[1] <= 100 * score]
                for w in windows:
                    if 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((n, w[0], w[2], i, w[1], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                                 ["n", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return rows


def mine(df: DataFrame, is_anchor, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, block: int = ANCHOR_BLOCK) -> DataFrame:
    """For every anchor (a row whose key meets the condition ``is_anchor``) and each of its ``positives`` best rows of the same label, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. ``high`` is at most 100.

    Scores are inner products of vectors of whole numbers (array of long); higher ones come first, ties by smaller key; all are returned where there are
    fewer. Rows without key, label or vector take no part, rows that repeat all three count once, the rows of an anchor's own key are neither
    positives nor negatives of it, and vectors are compared with those of their length only. An empty table gives an empty result; other columns are not read.

    Anchors go to the tasks block by block; a block's result is written and its broadcast destroyed before the next one, so neither the driver nor the tasks
    hold more than one block. Every task scores its rows against the block and keeps, for each anchor, the best rows that it has: first of
    the anchor's label, then of other labels in the windows of the positives, both with few rows for each anchor and task. These are shuffled under the
    key (anchor, descending score, id), as repartitionAndSortWithinPartitions does, and a pass over each sorted partition takes the
    first positives, or opens a window at each positive and emits negatives, without holding the pairs of an anchor.
    """
    if high > 100 or low < 0:
        raise ValueError("windows end at the positive's score and start at a share of it")
    spark = df.sparkSession
    rows = (df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
            .groupBy("id", "label", "v").agg(F.first(F.size("v")).alias("width")))
    rows = written(rows, "labelled-vectors")
    out = shared_path(spark, "negatives")
    spark.createDataFrame([], _OUT).write.parquet(out)
    for width in sorted(r["width"] for r in rows.select("width").distinct().collect()):
        of = rows.where(F.col("width") == width).select("id", "label", "v")
        anchors = of.where(is_anchor(F.col("id")))
        blocks = math.ceil(anchors.count() / block)
        for b in range(blocks):
            asked = anchors.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == b).orderBy("id", "label", "v").collect()
            if asked:
                _block(of, Anchors(asked), positives, negatives, low, high).write.mode("append").parquet(out)
    return spark.read.schema(_OUT).parquet(out)


def _block(of: DataFrame, block: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = of.sparkSession
    sent = spark.sparkContext.broadcast(block)
    best = written(_sorted(of.mapInArrow(_positives(sent, positives), _KEYS)).mapInArrow(_first(positives), _KEYS), "positives")
    windows: list[list[int]] = [[] for _ in block.ids]
    for r in best.collect():  # positives for each anchor of the block at most
        windows[r["n"]].append(~r["down"])
    sent.destroy()
    block.windows = [np.array(sorted(w, reverse=True), np.int64) for w in windows]
    sent = spark.sparkContext.broadcast(block)
    pairs = of.mapInArrow(_negatives(sent, low, high, negatives), _KEYS).unionAll(best)
    found = written(_sorted(pairs).mapInArrow(_stream(low, high, negatives), "n int, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "windows")
    sent.destroy()
    names = spark.createDataFrame(pd.DataFrame({"n": np.arange(len(block.ids)), "anchor_id": block.ids}), "n int, anchor_id long")
    return found.join(names, "n").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(key: Column, label: Column) -> Column:
    """The label of op12's table: every seventh key has the next one of ten."""
    return F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
