"""Columns of the input that are called like those that operators use: every one comes out as it went in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import decontaminate, fingerprints, linededup, urlrules
from lacuna.llm.common import materialise

BENCHMARK = "item_id long, text string"


def operators(spark):
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    items = spark.createDataFrame([(1, "It has two")], BENCHMARK)
    return {
        "url": (lambda d: urlrules.judge(d, rules, url="text"), {"host", "path", "rule", "verdict"}),
        "lines": (linededup.remove_repeated, {"removed", "text"}),
        "decontaminate": (lambda d: decontaminate.find_contamination(d, items), {"n_words", "n_hit", "n_items", "items", "hit_spans"}),
        "fingerprint": (fingerprints.with_fingerprint, {"fingerprint"}),
    }


@pytest.mark.parametrize("name", ["url", "lines", "decontaminate", "fingerprint"])
def test_operator(spark, odd, name):
    run, replaced = operators(spark)[name]
    docs = odd.drop("words") if name == "url" else odd
    got = run(docs)
    kept = [c for c in docs.columns if c not in replaced]
    assert sorted(map(repr, got.select(*[f"`{c}`" for c in kept]).collect())) == sorted(map(repr, docs.select(*[f"`{c}`" for c in kept]).collect()))
    assert replaced - {"text"} <= set(got.columns)


def test_stages_return_the_columns_that_they_got(spark, odd):
    """Of every row that a stage keeps, each column but the text and its length is that of the input."""
    docs = odd.withColumns({"lang_pred": F.lit("mine"), "n_hit": F.lit(77)})
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = materialise(stage(spark, docs, "/root/testdata/sf0.001"), f"clash-{name}")
        assert result.columns == docs.columns and [f.dataType for f in result.schema] == [f.dataType for f in docs.schema]
        before = {repr(r) for r in docs.select(*own).collect()}
        assert {repr(r) for r in result.select(*own).collect()} <= before, name
        docs = result


def test_a_copy_under_a_used_id_goes(spark):
    """(2, t) is a copy of (1, t), and stays a copy although another text has its id and stays."""
    t, u = (" ".join(f"{c}{k}" for k in range(40)) for c in "tu")
    rows = [(1, t), (2, t), (2, u), (2, u), (None, t + " end"), (3, None), (3, None), (4, ""), (None, u)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, t), (2, u), (3, None), (4, "")], key=repr)
