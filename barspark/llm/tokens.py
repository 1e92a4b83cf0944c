"""Token counts of a byte-level BPE vocabulary, with whole tokens counted without merging."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

_REMEMBERED = 1_200_000  # pieces of one worker; beyond, all are forgotten together
_NEVER = 1 << 60


def byte_letters() -> dict[int, str]:
    """The letter of each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Merges, pre-token pattern and whole tokens of a byte-level BPE file; small enough to be sent to every worker.

    ``whole`` holds the vocabulary strings that were proved, by running the merges on them, to be one token when they
    stand alone. Letters and digits are those of the library that belongs to the file, which may know fewer code
    points than the pattern module: those it does not know are taken out of the classes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.letter = byte_letters()
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.letters, self.digits = _unknown(r"\p{L}", "a", split), _unknown(r"\p{N}", "1", split)
        byte = {v: k for k, v in self.letter.items()}
        self.whole: set[str] = set()
        for t in spec["model"]["vocab"]:
            if all(c in byte for c in t) and len(self.merged(t)) == 1:
                try:
                    self.whole.add(bytes(byte[c] for c in t).decode())
                except UnicodeDecodeError:  # part of a character: never a pre-token
                    pass

    def splitter(self):
        """The pre-tokens of a text, with the library's own letters and digits."""
        letter = rf"[\p{{L}}--[{self.letters}]]" if self.letters else r"\p{L}"
        digit = rf"[\p{{N}}--[{self.digits}]]" if self.digits else r"\p{N}"
        form = r"'s|'t|'re|'ve|'m|'ll|'d| ?{0}+| ?{1}+| ?[^\s{0}{1}]+|\s+(?!\S)|\s+"
        usual, own = regex.compile(form.format(r"\p{L}", r"\p{N}")).findall, regex.compile("(?V1)" + form.format(letter, digit)).findall
        if not self.letters + self.digits:
            return usual
        unknown = re.compile(f"[{self.letters}{self.digits}]").search
        return lambda text: usual(text) if text.isascii() or not unknown(text) else own(text)

    def merged(self, letters: str) -> list[str]:
        """The tokens of one pre-token given in byte letters: the earliest merge first, from the left."""
        parts, rank = list(letters), self.rank.get
        ranks = [rank(p, _NEVER) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NEVER)
        return parts


def _unknown(kind: str, like: str, split) -> str:
    """Code points of a class that the library's splitter does not join to one of that class, as ranges."""
    member = regex.compile(kind)
    odd = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and member.match(chr(c)) and len(split(like + chr(c))) > 1]
    ranges: list[list[int]] = []
    for c in odd:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Counter(dict):
    """Tokens of each piece of text seen so far; a piece is what stands between two spaces, with the space before it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.split = vocabulary, vocabulary.splitter()

    def __missing__(self, piece: str) -> int | None:
        # white space at an edge joins the space outside: the text has to be split as one
        n = None if not piece or piece[0].isspace() or piece[-1].isspace() else self.exact(" " + piece)
        self[piece] = n
        return n

    def exact(self, text: str) -> int:
        """By pre-tokens: whole tokens count one, the others are merged."""
        tokens, whole, letter = self.split(text), self.v.whole, self.v.letter
        rest = [t for t in tokens if t not in whole]
        return len(tokens) - len(rest) + sum(len(self.v.merged("".join([letter[b] for b in t.encode()]))) for t in rest)

    def ordinary(self, text: str) -> int:
        """Of a text without special strings."""
        first, *pieces = text.split(" ")
        n = self.exact(first) if first and not first[-1].isspace() else None if pieces or first else 0
        try:
            return n + sum(map(self.__getitem__, pieces))
        except TypeError:  # an edge of white space
            return self.exact(text)

    def text(self, text: str) -> int:
        """Special strings are one token each and cut the text."""
        if len(self) > _REMEMBERED:
            self.clear()
        parts = [text]
        for s in self.v.specials:
            if s in text:
                parts = [p for part in parts for p in part.split(s)]
        return len(parts) - 1 + sum(map(self.ordinary, parts))


_WORKER: dict = {}


def token_count(text: Column, vocabulary, path: str) -> Column:
    """Tokens of a text column as a long; null counts as the empty text. ``vocabulary``: the broadcast Vocabulary of the path."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _WORKER:
            _WORKER.clear()
            _WORKER[path] = Counter(vocabulary.value)
        counter = _WORKER[path]
        for texts in batches:
            yield pd.Series([0 if t is None else counter.text(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row; no shuffle, no row left out.

    ``path`` is a byte-level BPE file (``.json``); the text is taken whole, without added begin or end tokens, and
    special strings inside it are one token each. Null text counts as empty; an empty text has 0 bytes and tokens.
    Columns of these three names that the table already has are replaced. Repeated rows keep one result each; an empty
    table gives an empty one. Pieces between spaces are counted once per worker and remembered up to a fixed number.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return (df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("n_tokens", token_count(F.col(text), vocabulary, path))
            .withColumn("over_limit", F.col("n_tokens") > limit))
