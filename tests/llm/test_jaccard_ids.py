"""Rows that share an id, or have none, with different texts side by side."""

from __future__ import annotations

import pytest

from lacuna.llm import jaccard


@pytest.mark.parametrize("id", [7, None])
def test_rows_of_one_id_with_different_texts(spark, id):
    """The near copy is linked, though another text of the same id stands before and behind it."""
    base = [f"w{k}" for k in range(80)]
    other = [(id, f"an own text of number {k} without any likeness") for k in range(2)]
    rows = [other[0], (id, " ".join(base)), other[1], (100, " ".join([*base[:-1], "last"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect() if r["n_shingles"] == 78]
    least = 100 if id is None else 7
    assert sorted(got, key=repr) == sorted([(id, least), (100, least)], key=repr)
