"""Passages that repeat: suffix automata of reference shards, on which texts are matched word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _INVERSE, _WORD, fresh, mixed, powers, sliding_min, utf8, window_hashes, word_hashes, written

#: Words of an anchor; windows of a stretch at most (bits of a mask); stretches of one automaton at most.
_ANCHOR, _STRETCH, _SHARD = 8, 32, 4_000


def stretches(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content, first window, number of windows and own repeats of each stretch of a text.

    The anchor of a window is the smallest hash of the anchor-long runs in it, a stretch is a row of windows with one
    anchor. Equal windows have equal anchors, so they meet under one anchor wherever they stand.
    """
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    anchor = sliding_min(window_hashes(words, min(_ANCHOR, window)), window - min(_ANCHOR, window) + 1)
    change = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    start = np.flatnonzero(change)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    first = np.flatnonzero(change | (place % _STRETCH == 0))
    count = np.diff(np.append(first, n))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_WORD, len(words)), out=total[1:])
    end = first + count + window - 1
    content = mixed((total[end] - total[first]) * powers(_INVERSE, len(words))[first] + count.astype(np.uint64))
    each = window_hashes(words, window)
    owner = np.repeat(np.arange(len(first)), count)
    order = np.lexsort((each, owner))
    twice = (owner[order][1:] == owner[order][:-1]) & (each[order][1:] == each[order][:-1])
    inner = np.zeros(len(first), bool)
    inner[owner[order][1:][twice]] = True
    return anchor[first].view(np.int64), content.view(np.int64), first, count, inner


def _occurrences(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                found, size = [], []
                for text in utf8(part.column(1)):
                    found.append(stretches(word_hashes(text)[0], window))
                    size.append(len(found[-1][0]))
                key = np.repeat(part.column(0).to_numpy(), size)
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.concatenate([f[i] for f in found])) for i in range(5)]], ["key", "m", "s", "at", "n", "inner"])
    return rows


class Automaton:
    """A suffix automaton of several word rows, with the weighted number of places at which each state's words end."""

    def __init__(self, rows: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        for row, weight in zip(rows, weights):
            last = 0
            for w in row:
                last = self._extend(last, w)
                self.places[last] += weight
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[v]] += self.places[v]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def repeated(self, row: list[int], window: int) -> int:
        """Bits of the windows of a row that occur at two places or more; the row is one of the automaton's."""
        mask, state = 0, 0
        for i, w in enumerate(row):
            state = self.next[state][w]
            while self.length[self.link[state]] >= window and state:
                state = self.link[state]  # the shortest suffix that is still a window or longer
            if i + 1 >= window and self.places[state] > 1:
                mask |= 1 << (i + 1 - window)
        return mask


def _judged(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verdict(shard: list) -> Iterator[tuple]:
            automaton = Automaton([r[3] for r in shard], [min(2, r[2]) for r in shard])
            return ((m, s, automaton.repeated(row, window)) for m, s, c, row in shard if c == 1)

        shard: list = []
        for b in batches:
            out: list = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if shard and shard[0][0] != row[0]:
                    out += verdict(shard)
                    shard = []
                shard.append(row)
            yield pa.RecordBatch.from_pylist([{"m": m, "s": s, "mask": k} for m, s, k in out], schema=_MASKS)
        if shard:
            yield pa.RecordBatch.from_pylist([{"m": m, "s": s, "mask": k} for m, s, k in verdict(shard)], schema=_MASKS)
    return rows


_MASKS = pa.schema([("m", pa.int64()), ("s", pa.int64()), ("mask", pa.int64())])


def _words_of(window: int):
    """The words of chosen stretches, from the texts that hold them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, s, c, words = [], [], [], []
            for text, chosen in zip(utf8(b.column(0)), b.column(1)):
                h = word_hashes(text)[0].view(np.int64)
                for x in chosen.as_py():
                    m.append(x["m"])
                    s.append(x["s"])
                    c.append(x["c"])
                    words.append(h[x["at"]:x["at"] + x["n"] + window - 1])
            ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
            flat = np.concatenate(words) if words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(s, pa.int64()), pa.array(c, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["m", "s", "c", "words"])
    return rows


def _windows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, s, c, bit, h = [], [], [], [], []
            for mm, ss, cc, words in zip(*(b.column(i).to_pylist() for i in range(4))):
                each = window_hashes(np.array(words, np.int64).view(np.uint64), window).view(np.int64).tolist()
                m += [mm] * len(each)
                s += [ss] * len(each)
                c += [cc] * len(each)
                bit += range(len(each))
                h += each
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (m, s, c, bit, h)], ["m", "s", "c", "bit", "h"])
    return rows


def repeated_stretches(docs: DataFrame, window: int) -> DataFrame:
    """(key, at, n, mask) for the stretches of all texts (key, text) that hold a repeated window: bit i stands for window at + i."""
    every = written(docs.mapInArrow(_occurrences(window), "key long, m long, s long, at long, n long, inner boolean"), "stretches")
    each = every.groupBy("m", "s").agg(F.count("*").alias("c"), F.max("inner").alias("inner"), F.min(F.struct("key", "at", "n")).alias("one"))
    each = written(each, "distinct-stretches")
    anchors = each.groupBy("m").agg(F.sum("c").alias("all"), F.count("*").alias("kinds"), F.max("inner").alias("any_inner")).where((F.col("all") > 1) | F.col("any_inner"))
    known = written(each.join(anchors, "m").select("m", "s", "c", "kinds", "one", "inner"), "anchored")
    full = known.where("c > 1").withColumn("mask", F.lit(-1).cast("long"))  # the whole stretch repeats
    # stretches seen once that share an anchor with others, with those others as the reference
    shards = known.where((F.col("kinds") > 1) | (F.col("c") == 1) & F.col("inner"))
    asked = shards.groupBy("one.key").agg(F.collect_list(F.struct("m", "s", F.least("c", F.lit(2)).alias("c"), F.col("one.at").alias("at"), F.col("one.n").alias("n"))).alias("chosen"))
    texts = docs.dropDuplicates(["key"]).join(asked, "key").select("text", "chosen")
    words = texts.mapInArrow(_words_of(window), "m long, s long, c long, words array<long>")
    words = written(words.join(known.groupBy("m").agg(F.first("kinds").alias("kinds")), "m"), "reference")
    small = words.where(F.col("kinds") <= _SHARD).select("m", "s", "c", "words")
    judged = small.repartition("m").sortWithinPartitions("m").mapInArrow(_judged(window), "m long, s long, mask long")
    # anchors of a passage with very many surroundings: their windows are counted, each task adding up its own first
    counted = words.where(F.col("kinds") > _SHARD).select("m", "s", "c", "words").mapInArrow(_windows(window), "m long, s long, c long, bit long, h long")
    counted = written(counted, "windows")
    again = counted.groupBy("h").agg(F.sum("c").alias("k")).where("k > 1").select("h")
    large = counted.where("c = 1").join(again, "h").groupBy("m", "s").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"))
    masks = written(full.select("m", "s", "mask").unionAll(judged).unionAll(large).where("mask <> 0"), "masks")
    return every.join(masks, ["m", "s"]).select("key", "at", "n", "mask")


def remove(docs: DataFrame, window: int = 35) -> DataFrame:
    """Adds to every document n_words, n_removed and kept (its words that no repeated window covers, joined by one space).

    ``docs`` has ``text``; words are runs of anything but ASCII white space. A window of ``window`` words is repeated if its words also
    start anywhere else, in the same document too; all windows are judged on the input. NULL and empty texts have no words; copies of a text lose all that
    is in a window; columns of the three names are replaced, repeated rows keep a row each, an empty table gives an empty one. Words are compared by 64-bit hashes.

    Every window has an anchor, and neighbours with one anchor form a stretch. Only stretches whose anchor occurs again can hold a
    repeated window. Equal stretches are counted first; those seen once form the shard of their anchor with the others
    of it, and are matched against the shard's suffix automaton, whose states know how often their words occur. A shard goes to the one task that needs
    it instead of to all; anchors with more than a fixed number of surroundings are settled by counting their windows.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept")])
    key, lists, out = fresh(base, "key", "lists", "out")
    keyed = base.withColumn(key, F.xxhash64("text"))  # equal texts have equal results
    texts = keyed.where("text IS NOT NULL").select(F.col(key).alias("key"), "text")
    found = repeated_stretches(texts, window).distinct().groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("at", "n", "mask")).alias(lists))

    @F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, stretch in zip(text, found):
            words = t.encode("utf-8", "surrogatepass").split() if t else []
            n, gone = len(words), 0
            if stretch is not None and len(words):
                start = np.zeros(n + 1, np.int64)
                for x in stretch:
                    mask = int(x["mask"])
                    for i in range(int(x["n"])):
                        if mask >> i & 1:
                            at = int(x["at"]) + i
                            start[at] += 1
                            start[min(n, at + window)] -= 1
                covered = np.cumsum(start[:n]) > 0
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist()) if not c]
            rows.append((n, gone, b" ".join(words).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    joined = keyed.join(found, key, "left").withColumn(out, cut("text", F.col(lists)))
    return joined.select(*base.columns, f"{out}.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

