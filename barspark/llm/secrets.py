"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import tidy, utf8

#: Kinds in the order in which spans that start together are listed.
BASE, ADDED = ("assign", "access", "hex"), "markov"
KINDS = (*BASE, ADDED)

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Characters that the models know; 0 stands for every other one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_N = len(ALPHABET) + 1
_SEPARATORS = "+/_=-"
_JOINS = np.isin(np.arange(_N), [ALPHABET.index(c) + 1 for c in _SEPARATORS])
#: Shortest string that the models judge (at 12 they take ordinary words in capitals), and shortest identifier that they learn from.
SHORTEST, IDENTIFIER = 16, 8


def runs(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of known characters that has the least length."""
    out = np.concatenate(([-1], np.flatnonzero(code == 0), [len(code)]))
    long = np.flatnonzero(np.diff(out) > least)
    return out[long] + 1, out[long + 1]


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's place, end, start of the value, end of the value) of the base kinds."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def _hex(run: str, at: int) -> list[tuple[int, int, int, int, int]]:
    return [(at + m.start(), 2, at + m.end(), at + m.start(), at + m.end()) for m in _HEX.finditer(run) if m.end() - m.start() >= 24]


def _all_base(text: str, data: bytes, code: np.ndarray) -> tuple[list, list]:
    """Base spans of a text, and its long runs as (start, end) in code points."""
    starts, ends = runs(code, SHORTEST)
    found, long, shift, done = base_spans(text), [], 0, 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        shift += (s - done) - len(data[done:s].decode("utf-8", "replace"))
        done = s
        long.append((s - shift, e - shift))
        found += _hex(text[s - shift:e - shift], s - shift)
    return found, long


@dataclass(frozen=True)
class Models:
    """Log probabilities of each character after another (row 0: at the start) in the two kinds of strings."""

    ratio: np.ndarray  # log of random over ordinary, by codes
    per_letter: float = 0.5
    total: float = 15.0

    def is_random(self, run: str) -> bool:
        code = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        score = float(self.ratio[np.concatenate(([0], code[:-1])), code].sum())
        return score >= self.total and score >= self.per_letter * len(run)

    def random_parts(self, run: str) -> list[tuple[int, int]]:
        """Start and end of the random strings of a run: all of it, or else its maximal segments above ``per_letter`` a character.

        No longer segment that holds a maximal one scores more (Ruzzo and Tompa), so ordinary characters around a key do not weigh
        against it. Separators tell nothing, and a string starts anew after one. A key's first or last characters may look ordinary: a
        segment reaches to the separators around it, and over padding at the end. Short numbers are no keys.
        """
        if len(run) < 20 and run.isdigit():
            return []
        if self.is_random(run):
            return [(0, len(run))]
        code = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        joins = _JOINS[code]
        scores = np.where(joins, 0.0, self.ratio[np.concatenate(([0], np.where(joins, 0, code)[:-1])), code]).tolist()
        found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
        total = 0.0
        for i, score in enumerate(scores):
            before, total = total, total + score - self.per_letter
            if total <= before:
                continue
            start, low, at = i, before, len(found)
            while at:
                at -= 1
                if found[at][2] < low:
                    if found[at][3] < total:
                        start, low = found[at][0], found[at][2]
                        del found[at:]
                        at = len(found)
                        continue
                    break
            found.append((start, i + 1, low, total))
        parts: list[tuple[int, int]] = []
        for a, b, *_ in found:
            if sum(scores[a:b]) < self.total:
                continue
            while a and run[a].isalnum() and run[a - 1].isalnum():
                a -= 1
            while b < len(run) and run[b - 1].isalnum() and run[b].isalnum():
                b += 1
            if not run[b:].strip("="):
                b = len(run)
            if parts and a <= parts[-1][1]:
                a, _ = parts.pop()
            parts.append((a, b))
        return [(a, b) for a, b in parts if b - a >= SHORTEST and not (b - a < 20 and run[a:b].isdigit())]


def uncovered(text: str, start: int, end: int, covers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the given spans, in order of start, leave of a run, without the separator at a cut, as far as the models judge it."""
    cut = False
    for a, b in [*covers, (end, end)]:
        stop = min(a, end)
        first = start + (cut and start < stop and text[start] in _SEPARATORS)
        last = stop - (a < end and first < stop and text[stop - 1] in _SEPARATORS)
        if last - first >= SHORTEST:
            yield first, last
        start, cut = max(start, b), True



def _transitions(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of (before, character) within the given runs."""
    if not len(starts):
        return np.zeros(_N * _N, np.int64)
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge[:-1]) > 0
    before = np.concatenate(([0], code[:-1]))
    before[starts] = 0
    return np.bincount((before * _N + code)[inside], minlength=_N * _N)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of a partition: label 1 values of base spans, label 0 other identifiers."""
    tidy()
    counts = np.zeros((2, _N * _N), np.int64)
    for batch in batches:
        for data in utf8(batch.column(0)):
            code = _CODE[np.frombuffer(data, np.uint8)]
            text = data.decode("utf-8", "replace")
            spans, _ = _all_base(text, data, code)
            if spans:
                taken = code.copy()
                for start, _, end, a, b in spans:
                    at = len(text[:start].encode())
                    taken[at:at + len(text[start:end].encode())] = 0
                    value = _CODE[np.frombuffer(text[a:b].encode(), np.uint8)]
                    counts[1] += _transitions(value, *runs(value, 6))
                code = taken
            counts[0] += _transitions(code, *runs(code, IDENTIFIER))
    label, cell = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[label, cell], pa.int64())], ["label", "cell", "n"])


def train(df: DataFrame, text: str = "text", even: float = 0.5, per_letter: float = 0.5, total: float = 15.0) -> Models:
    """Both models from all texts: the values that the base patterns find are the samples of random strings, the
    other runs of eight and more known characters those of ordinary identifiers.

    Each partition sends its transition counts, at most two for each pair of characters, which are added up in Spark;
    the result has the size of the alphabet squared whatever the input. The random model is mixed with evenly spread
    characters by the share ``even`` (all of it where there is no sample), the ordinary one by a thousandth.
    """
    rows = df.select(text).mapInArrow(_samples, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, _N, _N))
    for r in rows:
        counts[r["label"], r["cell"] // _N, r["cell"] % _N] = r["n"]
    flat = 1 / (_N - 1)
    total_of = counts.sum(axis=2, keepdims=True)
    share = np.where(total_of > 0, counts / np.maximum(total_of, 1), flat)
    share[1], share[0] = (1 - even) * share[1] + even * flat, 0.999 * share[0] + 0.001 * flat
    ratio = np.zeros((_N, _N))
    ratio[:, 1:] = np.log(share[1, :, 1:]) - np.log(share[0, :, 1:])
    return Models(ratio, per_letter, total)


def spans_of(text: str, models: Models | None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in order; the models add the random strings in what base spans leave of the long runs."""
    data = text.encode("utf-8", "replace")
    base, long = _all_base(text, data, _CODE[np.frombuffer(data, np.uint8)])
    found = [s[:3] for s in base]
    if models is not None:
        covers = sorted((s, e) for s, _, e, *_ in base)
        for start, end in long:
            for a, b in uncovered(text, start, end, [c for c in covers if c[0] < end and start < c[1]]):
                found += [(a + x, 3, a + y) for x, y in models.random_parts(text[a:b])]
    return sorted(found)


def spans(text: Column, models: Models | None) -> Column:
    """``kind:start:end`` of every secret, comma-joined in order of start and kind; offsets in code points, end exclusive."""

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tidy()
        for texts in batches:
            yield pd.Series(["" if t is None else ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans_of(t, models)]) for t in texts], dtype=object)

    return find(text)


def scan(df: DataFrame, models: Models | None = None, text: str = "text") -> DataFrame:
    """Adds ``spans``, the secrets of each whole text (see :func:`spans`), to every row.

    Null and empty texts have none. Without ``models`` only the base patterns are used. A column ``spans`` that the table already
    has is replaced; repeated rows each keep their result, an empty table gives an empty one. There is no shuffle.
    """
    return df.withColumn("spans", spans(F.col(text), models))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each span of ``spans`` (overlapping ones together) replaced by a mark; other texts unchanged."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, lists):
            if t is not None and found:
                parts, done = [], 0
                for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in found.split(",")):
                    if b <= done:
                        continue
                    parts += [t[done:a], mark] if a >= done else []
                    done = b
                t = "".join([*parts, t[done:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return F.when(found == "", text).otherwise(replace(text, found))


def digest(df: DataFrame) -> DataFrame:
    """Counts and digests of the spans of :func:`scan`."""
    parts = F.filter(F.split("spans", ","), lambda s: s != "")
    base = F.filter(parts, lambda s: ~s.startswith(ADDED))
    count = lambda k: F.size(F.filter(parts, lambda s: s.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(count, BASE), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), "spans")
