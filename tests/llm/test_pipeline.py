"""Stages on odd rows, and the plan of the first one."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barspark.llm import quality

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_chars long, score string, spans string, items int, f string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    text = "The quick and ordinary sentence stands here, with words that follow one another and end in a stop. " * 4
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "word"), (6, "long text of words " * 20_000), (7, f"{text} password=Abc123Xyz987Qq")]
    return spark.createDataFrame([(i, t, "en", len(t or ""), "s", "p", 3, "f", "i") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_a_stage_takes_odd_rows_and_empty_tables(spark, odd, place):
    name, stage = corpus_pipeline.STAGES[place]
    rows = stage(spark, odd, FOLDER).collect()
    last = place == len(corpus_pipeline.STAGES) - 1
    if not last:
        assert list(rows[0].asDict()) == odd.columns and {r["f"] for r in rows} == {"f"}
    if name in ("benchmark", "secrets", "pieces"):  # these leave clean documents, copies too
        assert len(rows) == odd.count()
    if name == "near_copies":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1, 3, 4, 5, 6]  # the last one is a near copy
    if name == "secrets":
        assert [r["text"][-8:] for r in rows if r["doc_id"] == 7] == ["[secret]"]
    assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_each_statistic_is_computed_once(spark, odd):
    rules = tuple(((quality.Condition(n, i % 2 == 0, 0.1), quality.Condition("words", True, 10.0 + i)), 0.3) for i, n in enumerate(quality.statistics(F.col("text"))))
    kept = quality.accepted(odd, quality.RuleEnsemble(0.1, rules * 2))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    once = quality.score(odd, quality.RuleEnsemble(0.1, rules * 2))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_replace", plan)) == len(re.findall("regexp_replace", once)) <= 7
    assert kept.columns == odd.columns
    want = quality.score(odd.drop("score"), quality.RuleEnsemble(0.1, rules * 2)).where("predicted = 1").count()
    assert kept.count() == want
