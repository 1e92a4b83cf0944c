"""What the text operators share: the shared folder, word hashing and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Step of the multipliers of a word's places, and odd multiplier of the polynomial over the words of a window.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
#: White space of the word rules, as a table over bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LOCAL: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, named by the cluster in spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a folder of its own; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
        folder = _LOCAL[0]
    return f"{folder.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _POWERS[base] = have = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size - 1, base, np.uint64))))
    return have[:n]


_PLACES = [np.zeros(0, np.uint64)]


def places(n: int) -> np.ndarray:
    """Odd multipliers of the places of a word. They are no powers: powers of one number cancel modulo 2**64 in long words of two letters (Thue-Morse)."""
    if len(_PLACES[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _PLACES[0] = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BYTE)) | np.uint64(1)
    return _PLACES[0][:n]


def word_hashes(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, words being runs of bytes other than ASCII white space."""
    a = np.frombuffer(text, np.uint8)
    if lower:
        a = np.where((a >= 65) & (a <= 90), a + np.uint8(32), a)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~_SPACE[a]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    keep = inside[1:-1].view(bool)
    size = end - start
    letters = a[keep]
    first = np.cumsum(size) - size
    nth = np.arange(len(letters)) - np.repeat(first, size)
    value = _TABLE[letters] * places(int(size.max()))[nth]
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64)), start, end


_INVERSE = pow(_WORD, -1, 2**64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words, from their hashes: equal windows have equal values, wherever they are."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_WORD, len(words)), out=run[1:])
    return mixed((run[n:] - run[:-n]) * powers(_INVERSE, m) + np.uint64(n))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    size, out = 1, v
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - size:]) if len(v) >= w else v[:0]


def tidy() -> None:
    """Gives back memory that earlier work of this Python worker has freed: workers are used again, and both allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each string; those of a null are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for v in column.cast(pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary()):
        yield v.as_buffer().to_pybytes() if v.is_valid else b""
