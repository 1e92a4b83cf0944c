"""op11: ids and texts against the library and Python's own decoder."""

import random

import pytest
from pyspark.sql import functions as F

from barspark.llm import transducer
from barspark.llm.queries import tokenizer_file

FOLDER = "/root/testdata/sf0.001"
PATH = tokenizer_file("byte_bpe_multi_50k.tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "  a  b ", "\x00x", "日本😀", "é é", "<|endoftext|>x", "it's\r\n\n x  \t y", "ab" * 30_000, "word\n" * 3000, "ﬁ Ａ ՘՘a ²1", "e" * 4096, "a" * 4097, "=-" * 5000, " " * 9000 + "x"]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = transducer.Ranks(PATH, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_ids_equal_the_library(spark, library):
    rng = random.Random(7)
    letters = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "1", "²", "é", "՘", "日", "😀", "ing", "the", "​", "ß", ".", "--", "\U000323b0", "ࢗ"]
    texts = [*ODD, *["".join(rng.choice(letters) for _ in range(rng.randrange(1, 16))) for _ in range(2000)],
             *["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice((9, 30, 9000)))) for _ in range(60)],
             *[r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]]
    df = spark.createDataFrame([(i, t, "old", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, Decoded int").repartition(4)
    got = transducer.encode(df, PATH, public_tokenizers.PATTERN, decoded=True)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == library.encode_ordinary(t or ""), t
        assert rows[i]["decoded"] == (t or "")
    alone = transducer.decode(got.select("doc_id", "ids"), PATH).join(got.select("doc_id", F.col("decoded").alias("d")), "doc_id")
    assert alone.where("decoded <> d").count() == 0
    again = transducer.encode(df.where("doc_id = 7").unionAll(df.where("doc_id = 7")), PATH, public_tokenizers.PATTERN)
    assert again.count() == 2 and again.columns == ["doc_id", "text", "Decoded", "ids"]
    assert transducer.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_runs_are_emitted_piece_by_piece():
    ranks = transducer.Ranks(PATH, public_tokenizers.PATTERN)
    machine = transducer.Transducer(ranks)
    sizes = []
    emit = machine.emit
    machine.emit = lambda lasts, starts, out: (emit(lasts, starts, out), sizes.append(len(lasts)))
    rng = random.Random(3)
    data = "".join(rng.choice("etaoinshrdlu") for _ in range(40_000)).encode()
    machine.tokens(data)
    longest = max(map(len, ranks.rank))
    assert len(sizes) == 10 and max(sizes) <= 2 * longest


def test_neighbours_are_judged_as_the_merges_do():
    ranks = transducer.Ranks(PATH, public_tokenizers.PATTERN)
    machine, rng = transducer.Transducer(ranks), random.Random(2)
    tokens = [t for t in rng.sample(sorted(ranks.rank), 600) if len(transducer.merged(t, ranks.rank)) == 1]
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert machine.fits(ranks.rank[a], ranks.rank[b]) == (transducer.merged(a + b, ranks.rank) == [a, b])


def test_decoding_of_broken_bytes():
    token = {b: bytes([b]) for b in range(256)} | {256: "é".encode(), 257: b"\xa9\xe2\x82"}
    rng = random.Random(4)
    stream = transducer.Stream(token)
    for _ in range(5000):
        ids = [rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xE2, 0xED, 0xA0, 0x82, 0xF0, 0x9F, 0x98, 0xF4, 0xF5, 0xC0, 256, 257]) for _ in range(rng.randrange(9))]
        assert stream.text(ids) == b"".join(token[i] for i in ids).decode("utf-8", "replace")


def test_decoding_of_null_and_no_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [0], "x")], "n int, ids array<int>, decoded string")
    assert {r["n"]: r["decoded"] for r in transducer.decode(df, PATH).collect()} == {1: None, 2: "", 3: "!"}
