"""Spelling variants: words one letter apart, found in a trie of letter-group counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Levels of the trie (letter groups), the bits of a count, words of a block, leaves that are compared without going further down.
LEVELS, _BITS, BLOCK, _BUCKET = 12, 5, 20_000, 24
_MOST = (1 << _BITS) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, one_in: int = 199) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, with their number of occurrences.

    Of every run whose document and letters have a CRC-32 that ``one_in`` divides, one letter is deleted: the place is that number modulo the length.
    NULL and empty texts have no words; a row without doc_id counts as one with an empty id. Repeated rows count each time.
    """
    runs = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0)))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    rows = docs.where("text IS NOT NULL").select(key.alias("key"), runs.alias("run"))
    h = F.crc32(F.concat("key", "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return rows.select(F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def letter_groups(words: DataFrame, levels: int = LEVELS) -> list[str]:
    """The letters of the words, dealt out to groups of about the same number of occurrences; one count a letter reaches the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    groups, load = [""] * levels, [0] * levels
    for r in sorted(letters.collect(), key=lambda r: (-r["n"], r["letter"])):
        g = load.index(min(load))
        groups[g] += r["letter"]
        load[g] += r["n"]
    return groups


def packed_counts(word: Column, groups: list[str]) -> Column:
    """The counts of all letter groups in one long, the first group in the highest bits; counts end at 31, which keeps neighbours neighbours."""
    out = F.lit(0).cast("long")
    for k, letters in enumerate(groups):
        n = F.least(F.length(word) - F.length(F.translate(word, letters, "")), F.lit(_MOST)).cast("long")
        out = out + F.shiftleft(n, _BITS * (len(groups) - 1 - k))
    return out


def _unpacked(packed: np.ndarray, levels: int) -> np.ndarray:
    return np.stack([(packed >> (_BITS * (levels - 1 - k))) & _MOST for k in range(levels)], axis=1)


def _moves(levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The changes of counts within the budget, one more and one less, that lead to the same or a later leaf; and the groups (more, less), -1 for none."""
    unit = [1 << (_BITS * (levels - 1 - k)) for k in range(levels)]
    found = [(0, -1, -1)] + [(unit[m], m, -1) for m in range(levels)] + [(-unit[d], -1, d) for d in range(levels)]
    found += [(unit[m] - unit[d], m, d) for m in range(levels) for d in range(levels) if m != d]
    found = [f for f in found if f[0] >= 0]
    return np.array([f[0] for f in found], np.int64), np.array([f[1:] for f in found], np.int64)


def _routes(blocks: np.ndarray, starts: np.ndarray, ends: np.ndarray, levels: int):
    """(block, word, n, packed): every word goes to the blocks that hold a leaf within its budget, its own or a later one."""
    change, groups = _moves(levels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                packed = part.column(2).to_numpy()
                counts = _unpacked(packed, levels)
                target = packed[:, None] + change[None, :]
                possible = np.ones(target.shape, bool)
                for k in range(levels):
                    possible &= ~((groups[None, :, 0] == k) & (counts[:, k, None] == _MOST)) & ~((groups[None, :, 1] == k) & (counts[:, k, None] == 0))
                # blocks are ranges of leaves in order; a large leaf may fill several
                first, last = np.searchsorted(ends, target, "left"), np.searchsorted(starts, target, "right") - 1
                row, move = np.nonzero(possible & (first <= last))
                if not len(row):
                    continue
                reach = np.stack([row, first[row, move], last[row, move]], axis=1)
                reach = np.unique(reach, axis=0)
                size = reach[:, 2] - reach[:, 1] + 1
                which = np.repeat(reach[:, 0], size)
                block = np.repeat(reach[:, 1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                pairs = np.unique(np.stack([which, block], axis=1), axis=0)
                taken = part.take(pa.array(pairs[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[pairs[:, 1]]), *taken.columns], ["block", "word", "n", "packed"])
    return rows


class Words:
    """Letters of words as numbers, from the front and from the back, as wide as the longest one that is not very long."""

    WIDE = 32

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        wide = min(self.WIDE, int(self.size.max(initial=1)))
        some = [w if len(w) <= wide else "" for w in words]
        codes = np.frombuffer("".join(w.ljust(wide, "\0") for w in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), wide)
        turned = np.frombuffer("".join(w[::-1].ljust(wide, "\0") for w in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), wide)
        kind = np.uint8 if codes.max(initial=0) < 256 else np.uint32
        self.front, self.back = codes.astype(kind), turned.astype(kind)


def one_apart(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def verified(a: Words, b: Words, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of a's words x and b's words y are exactly one letter apart."""
    wide = min(a.front.shape[1], b.front.shape[1])
    good = np.abs(a.size[x] - b.size[y]) <= 1
    short = np.minimum(a.size[x], b.size[y])
    long = np.maximum(a.size[x], b.size[y])
    inside = good & (long <= wide)
    at = np.flatnonzero(inside)
    for s in range(0, len(at), 50_000):
        p = at[s:s + 50_000]
        same = a.front[x[p], :wide] == b.front[y[p], :wide]
        front = np.where(same.all(axis=1), wide, same.argmin(axis=1))
        same = a.back[x[p], :wide] == b.back[y[p], :wide]
        back = np.where(same.all(axis=1), wide, same.argmin(axis=1))
        # what is equal from both ends leaves one letter of the longer word; equal words agree in all
        good[p] = (np.minimum(front, short[p]) + np.minimum(back, short[p]) >= long[p] - 1) & ((front < short[p]) | (a.size[x[p]] != b.size[y[p]]))
    for p in np.flatnonzero(good & (long > wide)):
        good[p] = one_apart(a.words[x[p]], b.words[y[p]])
    return good


def near_leaves(stored: np.ndarray, asked: np.ndarray, bucket: int = _BUCKET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in asked, place in stored) of count vectors that differ by at most one more and one less.

    ``stored`` is sorted: its rows are the leaves of a trie whose levels are the letter groups. The trie is gone through depth-first, once for all
    vectors asked: each subtree is entered with those that can still pay for the way, having spent at most one surplus and one deficit.
    A subtree of few leaves is compared at once.
    """
    levels = stored.shape[1]
    work = [(0, 0, len(stored), np.arange(len(asked)), np.zeros(len(asked), np.int8), np.zeros(len(asked), np.int8))]
    while work:
        level, low, high, who, more, less = work.pop()
        if not len(who) or low == high:
            continue
        if high - low <= bucket or level == levels:
            rest = stored[low:high, level:].astype(np.int16)
            for s in range(0, len(who), 4096):
                w = who[s:s + 4096]
                gap = asked[w, None, level:].astype(np.int16) - rest[None]
                up = np.maximum(gap, 0).sum(axis=2) + more[s:s + 4096, None]
                down = np.maximum(-gap, 0).sum(axis=2) + less[s:s + 4096, None]
                i, j = np.nonzero((up <= 1) & (down <= 1))
                if len(i):
                    yield w[i], low + j
            continue
        column = stored[low:high, level]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [high - low]))
        values = asked[who, level].astype(np.int16)
        for a, b in zip(cuts[:-1], cuts[1:]):
            gap = values - int(column[a])
            up, down = more + np.maximum(gap, 0), less + np.maximum(-gap, 0)
            able = np.flatnonzero((up <= 1) & (down <= 1))
            if len(able):
                work.append((level + 1, low + int(a), low + int(b), who[able], up[able].astype(np.int8), down[able].astype(np.int8)))


def _leaves(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first row of each (rows being sorted), and their number of rows."""
    return np.unique(packed, return_index=True, return_counts=True)


class _Side:
    """Words of one side of a block: number of near words, and the best one by the other side's order of preference."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        #: 0 for the most frequent word, ties in the order of code points
        self.place = np.empty(len(rows), np.int64)
        self.place[rows.sort_values(["n", "word"], ascending=[False, True], kind="stable").index.to_numpy()] = np.arange(len(rows))
        self.near, self.best = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max, np.int64)

    def found(self, mine: np.ndarray, other: _Side, theirs: np.ndarray) -> None:
        np.add.at(self.near, mine, 1)
        np.minimum.at(self.best, mine, other.place[theirs])

    def result(self, other: _Side) -> pd.DataFrame:
        has = np.flatnonzero(self.near)
        by_place = np.argsort(other.place)
        best = other.rows.iloc[by_place[self.best[has]]]
        return pd.DataFrame({"word": self.rows["word"].to_numpy()[has], "n_near": self.near[has], "form_n": best["n"].to_numpy(), "form": best["word"].to_numpy()})


def _compared(levels: int, at_once: int = 400_000):
    def compare(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """For each word with a pair in this block: its near words, and the most frequent of them (the first in order in a tie)."""
        stored, asked = (d.sort_values(["packed", "word"], kind="stable", ignore_index=True) for d in (stored, asked))
        of, by, have, want = Words(stored["word"].tolist()), Words(asked["word"].tolist()), _Side(stored), _Side(asked)
        order = pd.Index(sorted({*of.words, *by.words}))
        of_order, by_order = order.get_indexer(of.words), order.get_indexer(by.words)
        leaf, leaf_from, leaf_n = _leaves(stored["packed"].to_numpy())
        ask, ask_from, ask_n = _leaves(asked["packed"].to_numpy())
        for i, j in near_leaves(_unpacked(leaf, levels), _unpacked(ask, levels)):
            i, j = i[leaf[j] >= ask[i]], j[leaf[j] >= ask[i]]
            # all words of one leaf with all of the other, a bounded number of pairs at a time
            first, row = ask_from[i], np.repeat(np.arange(len(i)), ask_n[i])
            x = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(ask_n[i]) - ask_n[i], ask_n[i])
            size = leaf_n[j[row]]
            total = np.cumsum(size)
            at = 0
            while at < len(x):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_once, "right")))
                m = size[at:to]
                xs = np.repeat(x[at:to], m)
                ys = np.repeat(leaf_from[j[row[at:to]]], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                once = (asked["packed"].to_numpy()[xs] < stored["packed"].to_numpy()[ys]) | (by_order[xs] < of_order[ys])
                xs, ys = xs[once], ys[once]
                good = verified(by, of, xs, ys)
                want.found(xs[good], have, ys[good])
                have.found(ys[good], want, xs[good])
                at = to
        return pd.concat([want.result(have), have.result(want)], ignore_index=True)
    return compare


def near_words(words: DataFrame, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) of every word that has others one letter apart: their number, and the most frequent of them.

    ``words`` has distinct ``word`` and ``n``. The counts of letter groups are the levels of a trie; a change of one letter spends at most one surplus and one
    deficit. The leaves in order are cut into blocks of about ``block`` words, large leaves too; a word is sent to the blocks that hold a
    leaf within its budget (later ones only, so each pair is found once), and each block's trie is gone through depth-first with all words
    sent to it. Pairs of words are verified letter by letter and added up within the block. The first and last leaf of each block are
    sent to all tasks: 20 bytes for every ``block`` words.
    """
    spark = words.sparkSession
    number = max(1, math.ceil(words.count() / block))
    groups = letter_groups(words, levels)
    placed = written(words.select("word", "n", packed_counts(F.col("word"), groups).alias("packed")).repartitionByRange(number, "packed", "word")
                     .withColumn("block", F.spark_partition_id()), "words-by-leaf")
    found = placed.groupBy("block").agg(F.min("packed").alias("low"), F.max("packed").alias("high")).orderBy("low", "high", "block").collect()
    if not found:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    blocks, starts, ends = (np.array([r[c] for r in found], t) for c, t in (("block", np.int32), ("low", np.int64), ("high", np.int64)))
    asked = placed.select("word", "n", "packed").mapInArrow(_routes(blocks, starts, ends, levels), "block int, word string, n long, packed long")
    pairs = (placed.select("block", "word", "n", "packed").groupBy("block").cogroup(asked.groupBy("block"))
             .applyInPandas(_compared(levels), "word string, n_near long, form_n long, form string"))
    best = F.min(F.struct((-F.col("form_n")).alias("down"), "form"))
    return (pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.down")).alias("form_n"), F.col("best.form").alias("form")))


def group(words: DataFrame, least: int = 5, length: int = 6, times: int = 5, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``length`` code points and ``least`` occurrences.

    Words are near if one code point is inserted, deleted or replaced. ``form`` is the most frequent near word (the first in the order of code points in a
    tie) if it is at least ``times`` as frequent, else NULL, as form_n; ``root`` is where the forms lead in the end, the word itself without one; n_near is 0
    without near words. ``words`` has ``word`` and ``n``; rows that repeat a word are added up, those without one or both are left out, other columns are not
    read, and an empty table gives an empty result. Forms grow by a factor, so chains are short: their ends are found by doubling steps.
    """
    words = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.length("word") >= length))
    words = written(words, "words")
    near = near_words(words, levels, block)
    known = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                            *[F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]), "forms")
    step = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(step.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    return known.join(step.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
