"""Repeated passages of 50 to 200 words wherever they stand."""

from __future__ import annotations

import random

import pytest

from lacuna.llm import linededup


def sentences(rnd, words: int, size: int, end: str = ".") -> list[str]:
    return [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(40_000)}" for _ in range(size)) + end for _ in range(words // size)]


@pytest.mark.parametrize("kind", ["paragraph", "rows", "unpunctuated"])
def test_passages_at_random_places(spark, kind):
    """In mid-paragraph and one sentence a row, all later copies go, and no other words; unpunctuated, all but the ends."""
    rnd, rows, plant = random.Random(kind), [], {}
    for words, size in ((60, 12), (60, 8), (100, 10), (200, 8)):
        for _ in range(12):
            passage = sentences(rnd, words, size, "" if kind == "unpunctuated" else ".")
            for copy in range(2):
                before, after = (sentences(rnd, 12 * rnd.randrange(1, 6) + rnd.randrange(7), 5, "" if kind == "unpunctuated" else ".") for _ in range(2))
                plant[len(rows)] = (before, passage, after, copy)
                rows.append((len(rows), ("\n" if kind == "rows" else " ").join([*before, *passage, *after])))
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    gone = planted = 0
    for i, (before, passage, after, copy) in plant.items():
        outside = " ".join([*before, *after]).split()
        left = got[i].split()
        if not copy:
            assert got[i] == rows[i][1]
        elif kind == "unpunctuated":
            assert len(left) >= len(outside) and [w for w in left if w in set(outside)] == outside
            planted, gone = planted + len(" ".join(passage).split()), gone + len(rows[i][1].split()) - len(left)
        else:
            assert left == outside
    assert kind != "unpunctuated" or gone > 0.7 * planted


def test_lines_of_different_passages_stay(spark):
    """Lines that repeat one by one, but never next to each other, are no passage."""
    line = [f"this line of number {k} has some words of its own." for k in range(12)]
    rows = [(k, f"{x} only {k} stands here.") for k, x in enumerate(line)] + [(50, " ".join(line))]
    got = linededup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(rows)
