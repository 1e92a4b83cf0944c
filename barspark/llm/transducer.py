"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 state machine."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Remembered pieces and states of one worker (beyond, all are forgotten together), and characters that are handled at a time.
_PIECES, _STATES, _BLOCK = 1_000_000, 200_000, 1_000_000
#: Bytes of a long pre-token after which its settled tokens are emitted.
_AHEAD = 4096
_NEVER = 1 << 60


def merged(token: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The merges on a short string: the lowest rank first, from the left."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 1:
        ranks = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        best = min(ranks)
        if best == _NEVER:
            break
        i = ranks.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def edges(token: bytes, rank: dict[bytes, int]) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
    """The parts that stand at the left and at the right edge while a token is merged: (part, from, to).

    Times are the highest rank merged so far: a merge waits for all of lower rank, so whatever becomes possible at a time and has a
    lower rank than the next merge happens before it.
    """
    parts, now = [token[i:i + 1] for i in range(len(token))], -1
    sides: tuple[list, list] = ([], [])
    born = [-1, -1]
    while len(parts) > 1:
        ranks = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        best = min(ranks)
        if best == _NEVER:
            break
        now, i = max(now, best), ranks.index(best)
        for side, at_edge, part in ((0, i == 0, parts[0]), (1, i == len(ranks) - 1, parts[-1])):
            if at_edge:
                sides[side].append((part, born[side], now))
                born[side] = now
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    sides[0].append((parts[0], born[0], _NEVER))
    sides[1].append((parts[-1], born[1], _NEVER))
    return sides


class Ranks:
    """Tokens of a rank file, a trie of those that merges make of their own bytes, and the pre-token pattern; sent to every worker.

    The classes of letters, numbers and white space are those of the library that belongs to the file; code points on which the pattern
    module differs are written into the pattern.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte-level vocabulary is needed")
        self.token = {i: t for t, i in self.rank.items()}
        #: children by byte, and the token that ends there, of every node of the trie
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.depth: list[int] = [0]
        for t, i in sorted(self.rank.items()):
            if len(merged(t, self.rank)) == 1:
                node = 0
                for b in t:
                    if b not in self.children[node]:
                        self.children[node][b] = len(self.children)
                        self.children.append({})
                        self.ends.append(None)
                        self.depth.append(self.depth[node] + 1)
                    node = self.children[node][b]
                self.ends[node] = i
        self.pattern = pattern
        self.odd, self.classes = _differences()

    def splitter(self):
        """The pre-tokens of a text."""
        usual = regex.compile(self.pattern).findall
        own = self.pattern
        for name, members in self.classes.items():
            own = own.replace(name, members)
        # inside a class the negated letters stand as they are: a set of sets needs the newer syntax
        special, unusual = regex.compile("(?V1)" + own).findall, self.unusual()
        return lambda text: special(text) if unusual(text) else usual(text)

    def unusual(self):
        """Whether a text has a code point that the library and Python put into different classes."""
        search = re.compile(f"[{self.odd}]").search if self.odd else lambda text: None
        return lambda text: not text.isascii() and search(text)


def _ranges(points: Iterable[int]) -> str:
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _differences() -> tuple[str, dict[str, str]]:
    """Code points that the library puts into other classes than the pattern module, and the library's classes written out."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    odd: set[int] = set()
    classes = {}
    for name, negated in ((r"\p{L}", None), (r"\p{N}", None), (r"\s", r"\S")):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(name, every))
        odd |= {ord(c) for c in theirs ^ ours}
        if name == r"\p{L}":  # str.isalpha finds words without the pattern
            odd |= {ord(c) for c in theirs ^ {c for c in every if c.isalpha()}}
        members = f"[[{name}--[{_ranges(map(ord, ours - theirs))}]]{_ranges(map(ord, theirs - ours))}]" if ours - theirs else f"[{name}{_ranges(map(ord, theirs - ours))}]"
        if theirs != ours:
            classes[name] = members
            if negated:
                classes[negated] = "[^" + members[1:]
    return _ranges(odd), classes


class State(dict):
    """A state of the transducer: byte -> (next state, last token of the text up to there), filled in as bytes come.

    ``items`` are the readings that are still open: the token before an unfinished one, and the place of that one in the trie, longest first.
    The last item stands at the root: the text up to here, read whole.
    """

    __slots__ = ("machine", "items")

    def __init__(self, machine: Transducer, items: tuple):
        self.machine, self.items = machine, items

    def __missing__(self, byte: int) -> tuple[State, int]:
        self[byte] = found = self.machine.step(self.items, byte)
        return found


class Transducer:
    """The merges as a transducer from bytes to tokens, made deterministic state by state as texts need it.

    Tokens may follow each other if the merges on both together leave them as they are. A sequence of tokens that merges make of their own
    bytes is the merges' result exactly if all its neighbours may: the first merge across a border would also happen to the two alone.
    So every prefix of a text has one right reading, and the last token of each prefix is enough to find it. A nondeterministic machine guesses
    tokens in the trie and checks each border; the states here are sets of its open readings, none of which is longer than the longest token.
    Tokens are emitted when all open readings agree on them, which is looked up at the end and every ``_AHEAD`` bytes.
    """

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.length = {i: len(t) for i, t in ranks.token.items()}
        self.fit: dict[tuple[int | None, int], bool] = {}
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.fit.clear()
        self.start = self.state(((None, 0),))

    def state(self, items: tuple) -> State:
        found = self.states.get(items)
        if found is None:
            self.states[items] = found = State(self, items)
        return found

    def fits(self, a: int | None, b: int) -> bool:
        """Whether the merges on both tokens together leave them as they are: no merge across the border comes before those inside."""
        if a is None:
            return True
        if a not in self.right:
            _, self.right[a] = edges(self.ranks.token[a], self.ranks.rank)
        if b not in self.left:
            self.left[b], _ = edges(self.ranks.token[b], self.ranks.rank)
        right, left, rank = self.right[a], self.left[b], self.ranks.rank
        i = j = 0
        while True:
            (x, x_from, x_to), (y, y_from, y_to) = right[i], left[j]
            across = rank.get(x + y)
            if across is not None:
                first, end = max(across, x_from, y_from), min(x_to, y_to)
                if first < end:
                    return False
                if first == end:  # the place decides
                    x, y = self.ranks.token[a], self.ranks.token[b]
                    return merged(x + y, rank) == [x, y]
            if x_to <= y_to:
                i += 1
                if i == len(right):
                    return True
            else:
                j += 1

    def step(self, items: tuple, byte: int) -> tuple[State, int]:
        children, ends, fit = self.ranks.children, self.ranks.ends, self.fit
        following, last = [], None
        for before, node in items:
            to = children[node].get(byte)
            if to is not None:
                token = ends[to]
                if token is not None and last is None:
                    good = fit.get((before, token))
                    if good is None:
                        fit[before, token] = good = self.fits(before, token)
                    if good:
                        last = token
                if children[to]:
                    following.append((before, to))
        following.append((last, 0))
        return self.state(tuple(following)), last

    def tokens(self, data: bytes) -> list[int]:
        """The tokens of one pre-token: a string of the vocabulary as it is, others through the transducer."""
        known = self.ranks.rank.get(data)
        if known is not None:
            return [known]
        if len(self.states) > _STATES:
            self.forget()
        out: list[int] = []
        lasts: list[int] = []
        state = self.start
        if len(data) <= _AHEAD:
            for byte in data:
                state, last = state[byte]
                lasts.append(last)
            end, length = len(data), self.length
            while end:
                last = lasts[end - 1]
                out.append(last)
                end -= length[last]
            out.reverse()
            return out
        for at in range(0, len(data), _AHEAD):
            for byte in data[at:at + _AHEAD]:
                state, last = state[byte]
                lasts.append(last)
            if at + _AHEAD < len(data):
                self.emit(lasts, [len(lasts) - self.ranks.depth[node] for _, node in state.items], out)
        self.emit(lasts, [len(lasts)], out)
        return out

    def emit(self, lasts: list[int], starts: list[int], out: list[int]) -> None:
        """Moves the tokens that the readings with these starts have in common from the buffer to the output."""
        length = self.length
        paths = []
        for end in starts:
            path = [end]
            while end:
                end -= length[lasts[end - 1]]
                path.append(end)
            paths.append(path)
        agreed = paths[0] if len(paths) == 1 else sorted(set(paths[0]).intersection(*paths[1:]), reverse=True)
        ends = [e for e in paths[0] if 0 < e <= agreed[0]]  # one reading of each prefix: what is agreed has the same tokens in all
        out += [lasts[e - 1] for e in reversed(ends)]
        del lasts[:agreed[0]]


class Encoder:
    """Ids of whole texts as bytes of 32-bit numbers; pieces of texts are remembered."""

    def __init__(self, ranks: Ranks):
        self.machine, self.split, self.unusual = Transducer(ranks), ranks.splitter(), ranks.unusual()
        self.spaced: dict[str, bytes | None] = _Known(self.piece)
        self.plain: dict[str, bytes] = _Known(lambda t: array("i", self.machine.tokens(t.encode())).tobytes())

    def piece(self, piece: str) -> bytes | None:
        """What stands between two spaces, with the space before it; None if white space at its edges joins the spaces outside."""
        if piece.isalpha() and not self.unusual(piece):
            return array("i", self.machine.tokens(b" " + piece.encode())).tobytes()
        return None if not piece or piece[0].isspace() or piece[-1].isspace() else self.exact(" " + piece)

    def exact(self, text: str) -> bytes:
        """By pre-tokens; words with a space before them are remembered with the pieces."""
        return b"".join([self.spaced[t[1:]] if t[0] == " " and t[1:].isalpha() and not self.unusual(t) else self.plain[t] for t in self.split(text)])

    def text(self, text: str) -> bytes:
        if len(self.spaced) + len(self.plain) > _PIECES:
            self.spaced.clear()
            self.plain.clear()
        first, *pieces = text.split(" ")
        # a space between other characters starts a pre-token; white space at the edge of a piece joins it
        if first and not first[-1].isspace():
            try:
                return self.exact(first) + b"".join(map(self.spaced.__getitem__, pieces))
            except TypeError:
                pass
        return self.exact(text) if text else b""


class _Known(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = found = self.make(key)
        return found


#: Lead bytes of UTF-8: bytes that follow, and the range of the first of them (fixed by the format).
_LEADS = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)} \
    | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
_BAD = "�"


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, str]:
    """One byte of a UTF-8 stream: what is still open after it, and the characters that it completes (U+FFFD for each broken sequence)."""
    if pending:
        need, low, high = _LEADS[pending[0]]
        if len(pending) > 1:
            low, high = 0x80, 0xBF
        if low <= byte <= high:
            pending += bytes([byte])
            return (b"", pending.decode()) if len(pending) > need else (pending, "")
        after, out = utf8_step(b"", byte)
        return after, _BAD + out
    return (b"", chr(byte)) if byte < 0x80 else (bytes([byte]), "") if byte in _LEADS else (b"", _BAD)


class Stream(dict):
    """A state of the decoder: token -> (characters that it completes, next state); there is one state for each open sequence of bytes."""

    def __init__(self, token: dict[int, bytes], pending: bytes = b"", states: dict | None = None):
        super().__init__()
        self.token, self.pending, self.states = token, pending, states if states is not None else {}
        self.states[pending] = self

    def __missing__(self, i: int) -> tuple[str, Stream]:
        pending, out = self.pending, []
        for byte in self.token[i]:
            pending, more = utf8_step(pending, byte)
            out.append(more)
        self[i] = found = ("".join(out), self.states.get(pending) or Stream(self.token, pending, self.states))
        return found

    def text(self, ids: Iterable[int]) -> str:
        """All tokens, and U+FFFD for what is open at the end."""
        state, out = self, []
        for i in ids:
            more, state = state[i]
            out.append(more)
        return "".join(out) + (_BAD if state.pending else "")


_WORKER: dict = {}


def _at_work(ranks, path: str) -> tuple[Encoder, Stream]:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Encoder(ranks.value), Stream(ranks.value.token)
    return _WORKER[path]


def _blocks(batch: pa.RecordBatch, place: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with their texts, as many at a time as have about the characters of a block; bytes that are no UTF-8 become U+FFFD."""
    at = 0
    column = batch.column(place).cast(pa.large_binary() if pa.types.is_large_string(batch.column(place).type) else pa.binary())
    while at < len(batch):
        texts, size = [], 0
        while at + len(texts) < len(batch) and size < _BLOCK:
            texts.append((column[at + len(texts)].as_py() or b"").decode("utf-8", "replace"))
            size += len(texts[-1])
        yield batch.slice(at, len(texts)), texts
        at += len(texts)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int): the tokens of each whole text as the library of the rank file gives them, without special tokens.

    With ``decoded`` also the text that these ids give again, decoded in the same worker. NULL and empty texts have no ids. A column ``ids`` (and
    ``decoded``) of the table is replaced, others stay; repeated rows keep one result each, an empty table gives an empty one. Texts are
    handled in blocks of bounded size, pieces and states are remembered up to a fixed number, nothing is shuffled.
    """
    ranks = df.sparkSession.sparkContext.broadcast(Ranks(path, pattern))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    base = df.drop(*[c for c in df.columns if c.lower() in {f.name for f in added} and c != text])
    place, labels = base.columns.index(text), [*base.columns, *[f.name for f in added]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream = _at_work(ranks, path)
        for batch in batches:
            for part, texts in _blocks(batch, place):
                found = [encoder.text(t) for t in texts]
                ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b in found]))).astype(np.int32)
                columns = [*part.columns, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), np.int32)))]
                if decoded:
                    columns.append(pa.array([stream.text(memoryview(b).cast("i")) for b in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, labels)

    return base.mapInArrow(rows, T.StructType([*base.schema.fields, *added]))


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids: NULL gives NULL, no ids the empty text, broken UTF-8 the replacement character; an unknown id raises.

    A column ``to`` is replaced; rows stay as they are.
    """
    with open(path, "rb") as f:
        token = df.sparkSession.sparkContext.broadcast({int(b): base64.b64decode(a) for a, b in map(bytes.split, f)})
    base = df.drop(to) if to != ids else df
    place, labels = base.columns.index(ids), [*base.columns, to]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(token.value)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [stream.text(x.as_py()) if x.is_valid else None for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], labels)

    return base.mapInArrow(rows, T.StructType([*base.schema.fields, T.StructField(to, T.StringType())]))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, the number of ids, and the SHA-256 of the decimal ids joined by commas and of the decoded text."""
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))
