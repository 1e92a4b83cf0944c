"""Small cases of every text operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import components, contamination, jaccard, pages, passages, pieces, quality, search, secrets, tokens, urls
from barspark.llm.queries import quality_model, tokenizer_file

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# ---- op1

def brute_top(rows, k=5):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            best = sorted(((-int(np.dot(v, w)), i) for i, w in rows if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-200, 200, 6).tolist()) for i in range(300)] + [(300 + i, [5, 5, 5, 5, 5, 5]) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:20] + [(None, [1] * 6), (999, None)], "vec_id long, vector array<long>").repartition(5)
    got = search.top_k(df, lambda key: key % 50 == 0, query_block=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)


def test_search_of_large_numbers_few_rows_and_none(spark):
    big = 2**40
    rows = [(0, [big, 1]), (1, [big, 2]), (2, [big, 3])]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), lambda key: key == 0)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    small = [(0, [2**28, 1]), (1, [2**28, 2]), (2, [2**28, 3])]
    got = search.top_k(spark.createDataFrame(small, "vec_id long, vector array<long>"), lambda key: key == 0)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(2, 2**56 + 3), (1, 2**56 + 2)]
    assert search.top_k(spark.createDataFrame([], "vec_id long, vector array<long>"), lambda key: key == 0).count() == 0


def test_search_skips_broken_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [-0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", search.integers(F.col("e")).alias("v"))
    assert {r["vec_id"]: r["v"] for r in df.collect()} == {1: [128, 256], 2: None, 3: None, 4: None, 5: None, 6: [-1, 0]}


# ---- op2

def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model(docs, labels)
    assert model.rules and all(w for _, w in model.rules)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.93 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "word " * 50_000, 7), (3, "word " * 50_000, 7)], "doc_id long, text string, upper int")
    rule = ((quality.Condition("words", False, 10.0),), 2.0)
    out = quality.score(df, quality.RuleEnsemble(-1.0, (rule,)))
    assert out.columns == ["doc_id", "text", "upper", "score", "predicted"] and {r["upper"] for r in out.collect()} == {7}
    assert [round(r["score"], 3) for r in out.orderBy("doc_id").collect()] == [0.269, 0.269, 0.731, 0.731]
    none = quality.fit(quality.labelled(df, spark.createDataFrame([], "doc_id long, quality int"), 10))
    assert not none.rules and quality.score(df, none).count() == 4


# ---- op3

def test_url_list_as_of_the_fetch(spark):
    entries = spark.createDataFrame([("host", "a.b.com", "2024-01-01", "block"), ("host", "a.b.com", "2024-03-01", "allow"), ("domain", "b.com", "2024-02-01", "block"),
                                     ("path", "a.b.com/x", "2024-03-05", "block"), ("path", "a.b.com/x", "2024-03-05", "allow"), (None, "z", "2024-01-01", "block")],
                                    "kind string, pattern string, listed string, action string").withColumn("listed", F.to_date("listed"))
    rows = [(1, "http://A.b.com/", "2023-12-31"), (2, "http://a.b.com/", "2024-01-01"), (3, "http://a.b.com/y", "2024-03-01"), (4, "https://a.b.com/x/1?q", "2024-03-05"),
            (5, "http://c.b.com", "2025-01-01"), (6, None, "2024-03-01"), (7, "no address", "2024-03-01"), (8, "http://a.b.com/", None), (2, "http://a.b.com/", "2024-01-01")]
    seen = spark.createDataFrame([(*r, "k") for r in rows], "id long, url string, fetched string, key_host string").withColumn("fetched", F.to_date("fetched"))
    out = urls.filter_urls(seen, entries)
    assert sorted((r["id"], r["listed_kind"], r["blocked"], r["key_host"]) for r in out.collect()) == sorted(
        [(1, None, False, "k"), (2, "host", True, "k"), (2, "host", True, "k"), (3, "host", False, "k"), (4, "path", True, "k"), (5, "domain", True, "k"),
         (6, None, False, "k"), (7, None, False, "k"), (8, None, False, "k")], key=lambda x: (x[0], str(x[1])))
    assert urls.filter_urls(seen, entries.limit(0)).where("blocked").count() == 0
    assert urls.filter_urls(seen.limit(0), entries).count() == 0


# ---- op4 and op5

ODD = [None, "", " ", "  a  b ", "▁", "a▁b", "\x00x", "日本😀", "é é", "</s><s>", "<|endoftext|>x<|endoftext|>", "it's\r\n\n x  \t y", "ab" * 30_000, "word\n" * 3000, "ﬁ Ａ ՘՘a ²1"]


def test_pieces_equal_the_library(spark):
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, *[r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], DOCS + ", ids string")
    got = pieces.round_trip(df, path)
    for r in got.collect():
        assert r["ids"] == sp.encode(r["text"] or ""), r["text"]
        assert r["same"] and r["n_pieces"] == len(r["ids"])
    assert pieces.decode(got, path).where("decoded <> replace(text, '▁', ' ')").count() == 0
    assert pieces.round_trip(df.limit(0), path).count() == 0


def test_frequent_pieces_stay_remembered_among_rare_ones(monkeypatch):
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "_WORDS", 200)
    encoder, rare = pieces.Encoder(pieces.Model(path)), np.random.default_rng(3)
    seen, words = [], encoder.words
    monkeypatch.setattr(encoder, "words", lambda some: seen.extend(some) or words(some))
    for _ in range(30):
        texts = ["frequent, 日 \nplain. " + " ".join("".join(rare.choice(list("abcdeé.,▁日\n"), 7)) for _ in range(60)) for _ in range(2)]
        found, same = encoder.encode(texts)
        for text, ids, right in zip(texts, found, same):
            assert np.frombuffer(ids, np.int32).tolist() == library.encode(text) and right
    assert sum(w.startswith("▁frequent") for w in seen) == 1


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "1", "²", "é", "՘", "<|endoftext|>", "<|endof", ".", "​"]
    texts = [*ODD, *["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n_tokens int")
    for r in tokens.count_tokens(df, path).collect():
        t = r["text"] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024), t


# ---- op6

def test_secrets(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(1, f"é Api_Key : '{'x1' * 4}' AKIA{'Z' * 16} {'0af' * 8}"), (2, "token=abc AKIA123 " + "f" * 23), (3, None), (4, ""), (5, f"see {key} there"),
            (6, "an ordinary internationalization_of_identifiers here"), (7, f"password={key}")]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").unionAll(spark.createDataFrame(rows, DOCS).select("text"))
    df = spark.createDataFrame(rows, DOCS)
    models = secrets.train(docs)
    got = secrets.scan(df, models)
    assert by_id(got, "spans") == {1: ("assign:2:21,access:23:43,hex:44:68",), 2: ("",), 3: ("",), 4: ("",), 5: ("markov:4:44",), 6: ("",), 7: ("assign:0:49",)}
    assert by_id(secrets.digest(got), "n_assign", "n_access", "n_hex")[1] == (1, 1, 1)
    text = by_id(got.select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")), "t")
    assert text[5] == ("see [secret] there",) and text[3] == (None,) and text[2] == (rows[1][1],)
    assert secrets.scan(df.limit(0), secrets.train(df.limit(0))).count() == 0


def test_secrets_joined_with_other_strings(spark):
    rng = random.Random(5)
    key, other, short = ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for n in (40, 40, 16))
    access, path = "AKIA" + "Z2" * 8, "thethanand" * 40
    cases = [(f"{access}/{key}", [key]), (f"{access}={key}", [key]), (f"{access}_{key}", [key]), (f"{key}_token=abcdef", [key]), (f"{key}-{access}/{other}", [key, other]),
             (f"é {path}/{key}", [key]), (f"{path}_{key}", [key]), (f"{path}={key}", [key]), (f"{path}-{key}-{path}/{other}==", [key, other + "=="]), (f"id {short}", [short]),
             (f"{path}/{path}", []), ("4389501614895928", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], DOCS)
    found = secrets.scan(df, secrets.train(spark.read.parquet(f"{FOLDER}/documents.parquet").select("text")))
    for r in found.withColumn("rest", secrets.redacted(F.col("text"), F.col("spans"))).collect():
        at = [s.split(":")[1:] for s in r["spans"].split(",") if s.startswith("markov")]
        assert [r["text"][int(a):int(b)] for a, b in at] == cases[r["doc_id"]][1]
        assert key not in r["rest"] and other not in r["rest"]


# ---- op7

def brute_kept(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


@pytest.mark.parametrize("shard", [200, 1])
def test_passages_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(passages, "_SHARD", shard)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz")
    shared = [" ".join(word() for _ in range(n)) for n in (40, 36, 80)]
    texts = [None, "", "a " * 200, " ".join(word() for _ in range(34)), shared[0], "x\x0by\x1cz"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(3)]
        texts.append("\n".join(x for p in parts for x in (p, rng.choice([*shared, ""]))))
    texts += [texts[10], texts[10], " ".join(["p q r"] * 40)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], DOCS + ", key string").repartition(7)
    got = by_id(passages.remove(df, 35), "kept", "n_words", "n_removed", "key")
    assert [got[i][0] for i in range(len(texts))] == brute_kept(texts, 35)
    assert all(got[i][1] - got[i][2] == len(got[i][0].encode().split()) for i in got)
    assert passages.remove(df.limit(0)).count() == 0


# ---- op8

def test_contamination_of_odd_rows(spark):
    item = "The quick, brown fox; jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, f"x {item.upper()} y", 0), (2, None, 0), (3, "", 0), (4, "the quick brown fox jumps over the lazy dog", 0), (5, "only É ok short one", 0), (None, item, 0),
                                  (1, f"x {item.upper()} y", 0), (6, "only é", 0)], DOCS + ", items int")
    bench = spark.createDataFrame([(10, item), (9, item), (11, None), (12, ""), (13, "É ok"), (None, "short one")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination.find(docs, bench).collect()), key=str)
    assert got == sorted([(1, 14, 12, ["10", "9"]), (1, 14, 12, ["10", "9"]), (2, 0, 0, []), (3, 0, 0, []), (4, 9, 0, []), (5, 5, 4, ["13"]), (None, 12, 12, ["10", "9"]), (6, 2, 0, [])], key=str)
    assert {r["doc_id"] for r in contamination.without_hits(docs, bench).collect()} == {2, 3, 4, 6}
    assert contamination.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and contamination.find(docs.limit(0), bench).count() == 0


def brute_hits(texts, items, n):
    def words(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(name))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contamination_equals_a_search_of_all_windows(spark, monkeypatch, limit):
    """Letters whose lower case depends on their neighbours, or has another length: final sigma, dotted I, Cherokee, Greek marks."""
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", limit)
    rng = random.Random(9)
    words = ["ΟΑΣ", "ΑΕ", "οασ", "İstanbul", "ISTANBUL", "ıI", "ᎠᎡ", "Ꭰ", "ΌΣ", "ǅ", "ẞ", "ß", "plain", "Words", "ΣΑΣ"]
    marks = [" ", ".", ":", "'", " - ", "_", "\n"]
    text = lambda k: "".join(rng.choice(words) + rng.choice(marks) for _ in range(k))
    items = [(1, "ΟΑΣ"), (2, "ΟΑΣ ΑΕ"), (3, "İstanbul ᎠᎡ"), (4, "Plain words ΣΑΣ ẞ"), *[(10 + i, text(rng.randrange(1, 9))) for i in range(30)], (99, "plain " * 30)]
    texts = ["ΟΑΣ ΑΕ", "ΟΑΣ.ΑΕ", "ΟΑΣ:ΑΕ", "plain " * 20_000, *[text(rng.randrange(1, 60)) for _ in range(120)], *[rng.choice(items)[1] for _ in range(20)]]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    got = by_id(contamination.find(df, spark.createDataFrame(items, "item_id long, text string"), 4), "n_words", "n_hit", "items")
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items, 4)


# ---- op9

def brute_groups(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in root:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return [(len(s), r) for s, r in zip(sets, root)]


@pytest.mark.parametrize("block", [80, 3])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "_BLOCK", block)
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(60)] for _ in range(3)]
    texts = [None, "", "One two", "one TWO", "é É", "É É"]
    for _ in range(30):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
        texts.append(" ".join(w[rng.randrange(3):]))
    texts += [texts[8]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    got = by_id(jaccard.join(df, 4, 85), "n_shingles", "component_id")
    assert [got[i] for i in range(len(texts))] == brute_groups(texts, 4, 85)
    kept = {r["doc_id"] for r in jaccard.one_of_each(df, 4, 85).collect()}
    assert kept == {i for i, (_, r) in enumerate(brute_groups(texts, 4, 85)) if r == i}
    assert jaccard.join(df.limit(0)).count() == 0


def test_jaccard_links_through_rows_without_id_and_tells_long_patterned_words_apart(spark):
    a, b, c = (" ".join(f"w{i}" for i in range(first, first + 60)) for first in (0, 4, 8))  # a and c are linked by b alone
    pattern = "a"
    while len(pattern) < 4096:
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    other = pattern.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(7, a), (None, b), (9, c), (20, pattern), (21, other), (22, "p q r " + pattern), (23, "p q r " + other)], DOCS)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.join(df, 4, 85).collect()}
    assert got == {(7, 7), (None, 7), (9, 7), (20, 20), (21, 21), (22, 22), (23, 23)}


def test_a_family_of_near_copies_is_sent_to_few_searches(spark, monkeypatch):
    sent, made = spark.sparkContext.accumulator(0), jaccard._linked

    def counted(percent):
        links = made(percent)
        return lambda rows: (sent.add(len(rows)), links(rows))[1]

    monkeypatch.setattr(jaccard, "_linked", counted)
    r = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if r.random() < 0.985 else f"x{r.randrange(40)}" for w in base[:r.randrange(70, 81)]) for _ in range(300)]
    found = by_id(jaccard.join(spark.createDataFrame(list(enumerate(texts)), DOCS), 4, 85), "component_id")
    sets = [{t[i:i + 4] for i in range(len(t) - 3)} for t in (tuple(x.split()) for x in texts)]
    root = list(range(300))
    for y in range(300):
        for x in range(y):
            both = len(sets[x] & sets[y])
            if root[x] != root[y] and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                low, high = sorted((root[x], root[y]))
                root = [low if v == high else v for v in root]
    assert {i: (v,) for i, v in enumerate(root)} == found
    assert 1 < len(set(root)) < 250 and sent.value <= 300


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- op10

PAGE = """<html><body class="wide"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div id="main"><div class="post-{n}"><h2>T{n} &amp; more</h2>
<p>One two three four five six seven <a href="x">link</a> eight<p>Second&nbsp;paragraph,
 long enough to be kept.<ul><li>i1<li>i2</ul><script>var a = "</p>";</script><form><p>Subscribe</p></form></div><div class="comments"><p>A reader's comment that should not be kept, long as it is.</p></div></div>
<aside>side</aside><div class="cookie-notice">We use them</div><footer>f</footer>"""
MAIN = "T{n} & more\nOne two three four five six seven link eight\nSecond paragraph, long enough to be kept.\ni1\ni2"


def test_pages(spark):
    rows = [(i, "http://h.example/x", PAGE.format(n=i), 1) for i in range(4)]
    rows += [(10, "http://h.example/y", None, 1), (11, None, "<p>alone &lt;b&gt; a < b", 1), (12, "http://h.example/z", "<html><body><article><p>Other layout.</p></article>", 1),
             (13, "", "", 1), (14, "http://i.example/", "<script>only", 1), (0, "http://h.example/x", PAGE.format(n=0), 1), (15, "http://j.example", "<p>" + "w " * 100_000, 1)]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int"))
    got = {r["page_id"]: r["main_text"] for r in out.collect()}
    assert out.count() == len(rows) and "host" in out.columns
    assert all(got[i] == MAIN.format(n=i) for i in range(4))
    assert got[10] == got[13] == got[14] == "" and got[11] == "alone <b> a < b" and got[12] == "Other layout." and len(got[15]) == 199_999
    assert pages.extract(out.select("page_id", "url", "html").limit(0)).count() == 0


def test_pages_keep_what_stands_outside_the_largest_container(spark):
    long, short, menu = "A long sentence of the article. " * 40, "Short part. " * 30, "".join(f"<li><a href='/{i}'>Go there {i}</a>" for i in range(9))
    inner = f"<h1>Title</h1><div class='content'><p>{long}</div>"
    split = f"<section class='a'><p>{long}</section><section class='b'><p>{short}</section>"
    rows = [("a.example", f"<body><nav>{menu}</nav><article>{inner}</article><footer>f</footer>", ["Title", long]),
            ("b.example", f"<body><main><p>Lead.<article>{inner}</article></main>", ["Lead.", "Title", long]),
            ("c.example", f"<body><article>{split}</article><div class='ad'>Buy</div>", [long, short]),
            ("d.example", f"<body><ul>{menu}</ul><div id='x'>{inner}<p><a href='s'>Source</a></div>", ["Title", long, "Source"]),
            ("e.example", f"<body><ul>{menu}</ul><div id='x'><div>{split}</div></div>", [long, short])]
    df = spark.createDataFrame([(f"http://{h}/{i}", h, p) for h, p, _ in rows for i in range(3)], "url string, name string, html string")
    got = pages.extract(df).select("name", "main_text").collect()
    want = {h: "\n".join(t.strip() for t in parts) for h, _, parts in rows}
    assert len(got) == 15 and all(r["main_text"] == want[r["name"]] for r in got)


LONG = "A long sentence of the article, which goes on for a while. " * 8
#: Pages whose class or id has a word that elsewhere names a part of the page, and what has to be read.
NAMED = [
    (f"<body><div class='content has-sidebar'><p>{LONG}</div><div class='sidebar'><p>side</div>", [LONG]),
    (f"<body><article><header class='entry-header'><h1>Title</h1></header><p>{LONG}</article>", ["Title", LONG]),
    (f"<body><article><div class='post-header'><h1>Title</h1></div><p>{LONG}<h2 id='social-impact'>Social</h2><p>{LONG}<h2 id='search' class='search'>Search</h2><p>Short.</article>",
     ["Title", LONG, "Social", LONG, "Search", "Short."]),
    (f"<body><article><section id='comment-syntax' class='comment-syntax'><h2>Comments</h2><p>{LONG}</section><section id='comments'><p>More</section></article>", ["Comments", LONG, "More"]),
    (f"<body class='with-menu'><div class='site-header'><h1>Site</h1></div><div class='widget-area'><p>w</div><div class='main-menu'><div><h1>T</h1><p>{LONG}</div></div>", []),
    (f"<body><div class='modal'><main><h1>T</h1><p>{LONG}<div class='share-buttons'>Share</div></main><div class='comments-area'><article class='comment'><p>{LONG}{LONG}</article></div></div>",
     ["T", LONG]),
    (f"<body><div id='comments'><p>A reader</div><div class='siteFooter'>f</div><div class='story'><h1>T</h1><p>{LONG}<div class='cookie-notice'>c</div><div role='complementary'>r</div></div>", ["T", LONG]),
    (f"<body><div class='notice'><p>{LONG}</div>", [LONG]),
]


def test_pages_with_names_of_parts(spark):
    rows = [(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(NAMED)]
    got = {r["page_id"]: r["main_text"] for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i, (h, parts) in enumerate(NAMED):
        if parts:
            assert got[i] == "\n".join(p.strip() for p in parts), h


def test_a_tie_of_votes_goes_to_the_first_path_and_a_clashing_column_is_replaced(spark):
    rows = [(1, "http://h.example/1", f"<body><div class='b'><p>{LONG}</div><ul><li><a href='x'>x</a><li><a href='y'>y</a></ul>", "old"),
            (2, "http://h.example/2", f"<body><div class='a'><p>{LONG}</div><ul><li><a href='x'>x</a><li><a href='y'>y</a></ul>", "old")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, main_text string")
    assert [r["path"].rpartition(">")[2] for r in pages.winning_paths(df).collect()] == ["div.a"]
    assert {r["main_text"] for r in pages.extract(df).collect()} == {LONG.strip()}


# ---- pipeline

def test_pipeline_by_stage(spark):
    folder = FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        assert len(ids) == len(after) and ids <= {r["doc_id"] for r in before}
        if name == "near_copies":
            ordered = sorted(before, key=lambda r: r["doc_id"])
            groups = brute_groups([r["text"] for r in ordered], 5, 80)
            assert ids == {ordered[i]["doc_id"] for i, (_, r) in enumerate(groups) if r == i}
        if name == "secrets":
            assert len(after) == len(before) and not any(re.search("AKIA[A-Z0-9]{16}", r["text"]) for r in after)
        if place < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs = spark.createDataFrame(after, docs.schema)
    assert all(r["same"] for r in docs.collect())
