"""op13 against brute force."""

import random
import zlib
from collections import Counter

import pytest

from barspark.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least=5, length=6, times=5):
    v = {w: n for w, n in counts.items() if n >= least and len(w) >= length}
    by = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= times * v[w] else None
    out = {}
    for w in v:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, v[w], len(by[w]), None if form[w] is None else v[form[w]])
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("block, levels", [(20_000, 12), (40, 12), (40, 3)])
def test_variants_equal_brute_force(spark, block, levels):
    rng = random.Random(3)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 11)))
        counts[w] = rng.randrange(5, 3000)
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abcdeéÿ")
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            counts[w] = rng.randrange(1, 300)
    for i in range(90):  # one large leaf: the same letters in other places
        w = list("aabbccdd")
        rng.shuffle(w)
        counts["".join(w)] = rng.randrange(5, 90)
    long = "abcde" * 30
    counts |= {long: 9000, long[1:]: 70, long + "a": 70, "x" * 40: 50, "x" * 41: 400, "x" * 42: 5000, "x" * 35: 5, "y" * 33: 5, "y" * 32: 80, "y" * 31: 5, "日本語日本語": 5, "日本語日本": 99, "日本語日本誤": 60}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert result(variants.group(df, levels=levels, block=block)) == brute(counts)


def test_a_chain_of_forms(spark):
    counts = {"b" * i + "aaaaaaa"[i:]: 7 ** i * 5 for i in range(8)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = result(variants.group(df))
    assert got == brute(counts) and {r[1] for r in got.values()} == {"bbbbbbb"}


def test_odd_rows(spark):
    df = spark.createDataFrame([("letter", 3, "x"), ("letter", 2, "y"), ("lettre", 4, "x"), (None, 9, "x"), ("lettee", None, "x"), ("", 50, "x"), ("better", 25, "x"), ("netter", 25, "x")], "word string, n long, form string")
    assert result(variants.group(df)) == {"letter": ("better", "better", 5, 2, 25), "better": (None, "better", 25, 2, None), "netter": (None, "netter", 25, 2, None)}
    assert variants.group(df.limit(0)).count() == 0


def test_words_of_documents(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aBcÉé×") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", "1", "日"]) for _ in range(400)) for _ in range(30)]
    texts += [None, "", "Word" * 40_000, texts[0]]
    want = Counter()
    for i, t in enumerate(texts):
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{i}:{run}".encode())
                want[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
                run = ""
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    assert {r["word"]: r["n"] for r in variants.corpus_words(df).collect()} == want
    none = spark.createDataFrame([(None, "Word word")], "doc_id long, text string")
    assert [tuple(r) for r in variants.corpus_words(none).collect()] == [("word", 2)]
    assert variants.corpus_words(df.limit(0)).count() == 0
