"""The registered queries of the subpackage against SQL, and the pipeline's stages against brute force."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from compare import duck_table, spark_table
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from lacuna.llm import queries as llm

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def test_all_are_registered():
    assert set(llm.QUERIES) <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in llm.QUERIES


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert spark_table(llm.QUERIES[name](spark, FOLDER)) == duck_table(duck, llm.ORACLES[name])


def test_pipeline_stages(spark):
    """Each stage on its own input: what goes has a reason, what stays is whole."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, FOLDER)
        assert result.columns == docs.columns
        docs = corpus_pipeline.materialise(result, f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.8 * len(before), name
        if name != "line_dedup":
            assert all(after[i] == before[i] for i in after), name
        if name == "jaccard_join":
            assert no_links(list(after.values()))
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(before)
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def no_links(rows) -> bool:
    sets = [{tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for w in (r["text"].lower().split() for r in rows)]
    return not any(100 * len(a & b) >= 90 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)


def test_pipeline_takes_odd_documents(spark, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (odd.select(columns), none.select(columns)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), "test-odd")
        assert docs.select(F.sum("length")).first()[0] is None or table.count()
