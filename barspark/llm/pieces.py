"""SentencePiece encoding and decoding: one forward pass over the trie of all distinct marked words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidy

MARK = "▁"
#: A marked word: spaces and what follows them. No piece of a fitting model goes on after a letter with a mark, and none has a line feed.
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Remembered pieces of text of a worker, remembered words in them, pairs of pieces and steps, and characters that are split into words at a time.
_WORDS, _STEMS, _PAIRS, _BLOCK = 500_000, 250_000, 600_000, 1_000_000
_NEVER = float("-inf")


class Model:
    """Pieces and scores of a SentencePiece BPE file with byte fallback and marks at the front; sent to every worker."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        scores = {names[i]: sp.get_score(i) for i in plain}
        # merges prefer high scores: those of a BPE file are the negative places of its merges
        merged = [scores[names[i]] for i in plain if len(names[i]) > 1]
        if not all(sp.is_byte(i) for i in self.bytes) or not all(s == int(s) for s in merged) or any(MARK in t.lstrip(MARK) or "\n" in t for t in scores):
            raise ValueError("a BPE model with byte fallback and words marked at the front is needed")
        if sp.encode("a  b", out_type=str)[0][0] != MARK or sp.decode(sp.encode(" Ａﬁ  b ")) != " Ａﬁ  b ":
            raise ValueError("a model without normalisation and with a mark before the text is needed")
        self.score, self.id = scores, {names[i]: i for i in plain}
        #: Pieces that the merges make of their own letters.
        self.alone = {t for t in scores if len(t) == 1 or len(self.merged(t)) == 1}
        #: Neighbours in some piece: no merge goes over two other characters, so a word may be cut between them.
        self.beside = {t[i:i + 2] for t in scores for i in range(len(t) - 1)}
        #: What such pieces begin with.
        self.begins = {t[:n] for t in self.alone for n in range(1, len(t) + 1)}
        unknown = " ⁇ ".encode()
        byte = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.output = [byte.get(i) or (unknown if sp.is_unknown(i) else b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode()) for i in range(n)]

    def merged(self, text: str) -> list[str]:
        """The merges on a short text: the highest score first, from the left."""
        parts, score = list(text), self.score.get
        values = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while values:
            best = max(values)
            if best == _NEVER:
                break
            i = values.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del values[i]
            if i:
                values[i - 1] = score(parts[i - 1] + parts[i], _NEVER)
            if i < len(values):
                values[i] = score(parts[i] + parts[i + 1], _NEVER)
        return parts

    def ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]


class _Piece(dict):
    """The last piece of a path, with what may follow it."""

    __slots__ = ("text", "size", "ids", "owner")

    def __init__(self, text: str, owner: Encoder):
        self.text, self.size, self.ids, self.owner = text, len(text), owner.m.ids(text), owner

    def __missing__(self, piece: str) -> bool:
        self.owner.made += 1
        self[piece] = good = not self.text or self.owner.m.merged(self.text + piece) == [self.text, piece]
        return good


class _State(dict):
    """The longest end of what was read that begins a piece (or the last character); a character leads to the next state.

    ``ends`` has the pieces that end here, longest first.
    """

    __slots__ = ("text", "ends", "owner")

    def __init__(self, text: str, owner: Encoder):
        alone = owner.m.alone
        self.text, self.owner = text, owner
        self.ends = tuple((n, text[-n:], owner.piece(text[-n:])) for n in range(len(text), 0, -1) if n == 1 or text[-n:] in alone)

    def __missing__(self, letter: str) -> _State:
        text, owner = self.text + letter, self.owner
        while len(text) > 1 and text not in owner.m.begins:
            text = text[1:]
        self[letter] = found = owner.state(text)
        owner.made += 1
        return found


class _Halves:
    """Remembered ids in two halves: what comes again moves from the old half to the new one, and when the new one is full it takes the place of the old one.

    So frequent entries stay however many rare ones a worker meets.
    """

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self, most: int) -> bool:
        full = len(self.new) > most // 2
        if full:
            self.old, self.new = self.new, {}
        return full

    def missing(self, wanted: set[str]) -> list[str]:
        """What neither half has; the rest is in the new one then."""
        new, old = self.new, self.old
        absent = [p for p in wanted if p not in new]
        new.update((p, old[p]) for p in absent if p in old)
        return [p for p in absent if p not in old]


class Encoder:
    """Ids of what stands between two spaces (with the mark before it), as bytes of 32-bit numbers.

    ``wrong`` has the pieces of text whose ids don't give them again. A text is the sequence of its pieces, and every piece
    is encoded and decoded by itself, so the round trip of a text is right if those of its pieces are.

    The forward pass keeps, for every prefix of a word, the last piece of its best path. A piece may follow another only if the
    merges on both together leave them as they are; under that rule each prefix has exactly one path, the one that the
    merges give, so the pass is Viterbi's with admissibility as the score. Paths of a prefix do not
    depend on what follows, hence words sorted into a trie share them: the pass goes depth-first and starts each word
    where it leaves the one before. An automaton over all pieces, whose steps are made as words need them, names those that end at a letter.

    Both the pieces of text and the words in them (without a last character that no merge joins, such as a comma) are remembered.
    """

    def __init__(self, model: Model):
        self.m = model
        self.known, self.stems = _Halves(), _Halves()
        self.wrong: set[str] = set()
        self._begin()

    def _begin(self) -> None:
        self.pieces: dict[str, _Piece] = {}
        self.states: dict[str, _State] = {}
        self.made = 0

    def piece(self, text: str) -> _Piece:
        found = self.pieces.get(text)
        if found is None:
            self.pieces[text] = found = _Piece(text, self)
        return found

    def state(self, text: str) -> _State:
        found = self.states.get(text)
        if found is None:
            self.states[text] = found = _State(text, self)
        return found

    def words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of marked words, in one traversal of their trie."""
        out = {}
        last = [self.piece("")]  # last piece of the path to each prefix of the current word
        states = [self.state("")]
        before = ""
        for word in sorted(words):
            n, shared = len(word), 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], states[shared + 1:]
            state, end = states[shared], shared
            for letter in word[shared:]:
                state = state[letter]
                states.append(state)
                end += 1
                for size, text, piece in state.ends:
                    if last[end - size][text]:
                        break
                last.append(piece)
            before = word
            path, end = [], n
            while end:
                piece = last[end]
                path.append(piece)
                end -= piece.size
            out[word] = array("i", [i for piece in reversed(path) for i in piece.ids]).tobytes()
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Adds pieces of text that are not yet known, each with the mark before it, and proves their round trip."""
        beside, split = self.m.beside, {}
        for p in pieces:
            split[p] = words = []
            for w in _WORD.findall(MARK + p):
                if len(w) > 1 and w[-2:] not in beside:
                    words.append(w[:-1])
                    w = w[-1]
                words.append(w)
        self.stems.turn(_STEMS)
        ids = self.stems.new
        ids.update(self.words(self.stems.missing({w for words in split.values() for w in words})))
        output, known = self.m.output, self.known.new
        for p, words in split.items():
            known[p] = found = ids[words[0]] if len(words) == 1 else b"".join(map(ids.__getitem__, words))
            if b"".join(map(output.__getitem__, memoryview(found).cast("i"))) != b" " + p.replace(MARK, " ").encode():
                self.wrong.add(p)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether they give it again; the marks stand for spaces, and one is put before a text that is not empty."""
        if self.known.turn(_WORDS):
            self.wrong.intersection_update(self.known.old)
        if self.made > _PAIRS:
            self._begin()
        split = [_pieces(t) if t else [] for t in texts]
        self.learn(self.known.missing(set().union(*split)))
        known = self.known.new
        found = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return found, [self.wrong.isdisjoint(pieces) if self.wrong else True for pieces in split]


def _pieces(text: str) -> list[str]:
    """What stands between two spaces or marks; of several in a row all but one belong to the piece after them."""
    if MARK in text:
        text = text.replace(MARK, " ")
    pieces = text.split(" ")
    if "" in pieces:
        out, spaces = [], ""
        for p in pieces[:-1]:
            if p:
                out.append(spaces + p)
                spaces = ""
            else:
                spaces += MARK
        return [*out, spaces + pieces[-1]]
    return pieces


_WORKER: dict = {}


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), the pieces of each whole text as the library gives them without begin and end pieces.

    NULL and empty texts have no pieces. Other columns stay as they are, a column ``ids`` is replaced; repeated rows keep one result each,
    an empty table gives an empty one. Texts are split into marked words in blocks of bounded size; a worker remembers a bounded number of
    words. There is no shuffle.
    """
    return _with_ids(df, path, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _with_ids(df: DataFrame, path: str, text: str, added: list[T.StructField]) -> DataFrame:
    """The table with ids and, where asked for, whether they give the text again; a task holds the ids of one block of texts."""
    model = df.sparkSession.sparkContext.broadcast(Model(path))
    names = {f.name for f in added}
    base = df.drop(*[c for c in df.columns if c.lower() in names and c != text])
    place = base.columns.index(text)
    labels = [*base.columns, *[f.name for f in added]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        if path not in _WORKER:
            _WORKER.clear()
            _WORKER[path] = Encoder(model.value)
        for batch in batches:
            at = 0
            while at < len(batch):
                block, size = [], 0
                while at + len(block) < len(batch) and size < _BLOCK:
                    block.append(batch.column(place)[at + len(block)].as_py())
                    size += len(block[-1] or "")
                found, same = _WORKER[path].encode(block)
                ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b in found]))).astype(np.int32)
                columns = [*batch.slice(at, len(block)).columns, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), np.int32)))]
                if len(added) > 1:
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, labels)
                at += len(block)

    return base.mapInArrow(rows, T.StructType([*base.schema.fields, *added]))


def _text(ids: list[int], output: list[bytes]) -> str:
    return b"".join(map(output.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; NULL gives NULL, no ids the empty text, and bytes that are no UTF-8 the replacement character."""
    output = df.sparkSession.sparkContext.broadcast(Model(path).output)

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([None if x is None else _text(x.tolist(), output.value) for x in lists], dtype=object)

    return df.withColumn(to, text(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_pieces`` and ``same``: whether decoding gives the text again (marks in it become spaces).

    Rows are handled as by :func:`encode` and :func:`decode`, both in one worker, so that a task holds the pieces once; each distinct piece of text
    is decoded once.
    """
    out = _with_ids(df.drop("n_pieces"), path, text, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])
    return out.withColumn("n_pieces", F.size("ids").cast("long"))
