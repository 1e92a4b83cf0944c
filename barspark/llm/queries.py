"""The registered queries of the text operators: name -> (plan, check SQL or None)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import contamination, jaccard, negatives, pages, passages, pieces, quality, search, secrets, tokens, transducer, urls, variants
from .common import table


def tokenizer_file(name: str) -> str:
    """A public vocabulary file; the folder can be set by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", search.integers(F.col("embedding")).alias("vector"))
    return search.top_k(vectors, lambda key: key % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.RuleEnsemble:
    """Learnt from the labelled documents that are not held out."""
    return quality.fit(quality.labelled(docs.where(~quality.held_out(F.col("doc_id"))), labels, bound=10_000))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, folder, "labels"))
    return (quality.score(docs, model).select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a day of fetch; the tables have none, so it follows from the page's number."""
    return table(spark, folder, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 7 % 730).cast("int")).alias("fetched"))


def list_entries(pages_seen: DataFrame) -> DataFrame:
    """A dated list derived from all addresses: hosts are blocked and allowed in turn, domains blocked once, folders listed once."""
    known = pages_seen.select("page_id", *[c.alias(k) for k, c in urls.patterns(F.col("url")).items()])
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), (n % 730).cast("int")).alias("listed")
    action = lambda n: F.when(n % 2 == 0, F.lit("block")).otherwise(F.lit("allow")).alias("action")
    turn = F.col("page_id") % 8
    hosts = (known.groupBy(F.col("host").alias("pattern"), turn.alias("turn")).agg(F.min("page_id").alias("n"))
             .select(F.lit("host").alias("kind"), "pattern", day(F.col("n") * 11), action(F.col("turn"))))
    folders = (known.groupBy(F.col("path").alias("pattern")).agg(F.min("page_id").alias("n"))
               .select(F.lit("path").alias("kind"), "pattern", day(F.col("n") * 3 + 300), action(F.col("n"))))
    domains = (known.groupBy(F.col("domain").alias("pattern")).agg(F.min("page_id").alias("n"))
               .select(F.lit("domain").alias("kind"), "pattern", day(F.col("n") * 5), F.lit("block").alias("action")))
    return hosts.unionAll(folders).unionAll(domains)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    seen = captures(spark, folder)
    return urls.filter_urls(seen, list_entries(seen))


OP3_SQL = """
WITH c AS (SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 7 % 730 AS INTEGER) AS fetched,
                  nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
                  nullif(regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)', 1), '') AS folder FROM pages),
k AS (SELECT *, host || '/' || folder AS path, nullif(regexp_extract(host, '([^.]+[.][^.]+)[.]?$', 1), '') AS domain FROM c),
e AS (SELECT 2 AS place, 'host' AS kind, host AS pattern, min(page_id) * 11 AS n, page_id % 8 % 2 = 0 AS blocked FROM k GROUP BY host, page_id % 8
      UNION ALL SELECT 1, 'path', path, min(page_id) * 3 + 300, min(page_id) % 2 = 0 FROM k GROUP BY path
      UNION ALL SELECT 3, 'domain', domain, min(page_id) * 5, true FROM k GROUP BY domain),
days AS (SELECT place, kind, pattern, DATE '2023-01-01' + CAST(n % 730 AS INTEGER) AS since, bool_or(blocked) AS blocked FROM e WHERE pattern IS NOT NULL GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS until FROM days),
m AS (SELECT k.page_id, s.* FROM k JOIN spans s ON s.pattern = CASE s.kind WHEN 'host' THEN k.host WHEN 'path' THEN k.path ELSE k.domain END
      AND k.fetched >= s.since AND (s.until IS NULL OR k.fetched < s.until)),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY place) = 1)
SELECT k.page_id, k.url, k.fetched, b.kind AS listed_kind, b.pattern AS listed_pattern, b.since AS listed_since, coalesce(b.blocked, false) AS blocked
FROM k LEFT JOIN best b USING (page_id)
"""


def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pieces.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "same")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return (tokens.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))
            .select("doc_id", "n_bytes", "n_tokens", "over_limit"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return passages.digest(passages.remove(table(spark, folder, "documents").select("doc_id", "text")))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
v AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM v),
again AS (SELECT g FROM h GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN again USING (g)),
listed AS (SELECT r, list(p) AS p FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(p, []), i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN listed USING (r)
"""


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.find(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT p.r, p.i, p.size, bw.item_id FROM places p JOIN bw ON p.size = bw.size AND array_to_string(p.w[p.i:p.i + p.size - 1], ' ') = bw.win),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS x FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(listed.n, 0) AS n_items, coalesce(listed.h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(reach.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
"""


def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return transducer.digest(transducer.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", negatives.relabelled(F.col("vec_id"), F.col("label")).alias("label"),
                                                     search.integers(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, lambda key: key % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(variants.corpus_words(table(spark, folder, "documents").select("doc_id", "text")))


# the CRC-32 of a run comes from a table of 256 remainders, byte by byte
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS rest),
raw AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS key, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
runs AS (SELECT key, run, count(*) AS n FROM raw GROUP BY ALL),
sums AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(key || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)),
                                        lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, t),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM sums GROUP BY word),
v AS (SELECT word, CAST(n AS BIGINT) AS n FROM words WHERE n >= 5 AND length(word) >= 6),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, v.word FROM less a JOIN v ON a.rest = v.word UNION SELECT v.word, a.word FROM less a JOIN v ON a.rest = v.word),
best AS (SELECT a AS word, count(*) OVER (PARTITION BY a) AS n_near, b, v.n AS bn FROM near JOIN v ON v.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
forms AS (SELECT v.word, CASE WHEN bn >= 5 * v.n THEN b END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * v.n THEN bn END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS d FROM forms UNION ALL SELECT chain.word, forms.form, d + 1 FROM chain JOIN forms ON forms.word = chain.here WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, d) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


QUERIES: dict = {
    "op1_exact_topk_search": (op1, OP1_SQL),
    "op2_quality_rules": (op2, None),
    "op3_url_list_join": (op3, OP3_SQL),
    "op4_sentencepiece": (op4, None),
    "op5_token_counts": (op5, None),
    "op6_secret_scan": (op6, None),
    "op7_substring_dedup": (op7, OP7_SQL),
    "op8_decontamination": (op8, OP8_SQL),
    "op9_ngram_jaccard": (op9, OP9_SQL),
    "op10_html_extraction": (op10, None),
    "op11_byte_bpe_transducer": (op11, None),
    "op12_hard_negatives": (op12, OP12_SQL),
    "op13_spelling_variants": (op13, OP13_SQL),
}


def queries() -> dict:
    return {name: plan for name, (plan, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
