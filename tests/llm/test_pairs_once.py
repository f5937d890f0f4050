"""Every candidate pair is verified once, over both phases and whichever way round it is found."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lacuna.llm import jaccard


def texts(seed):
    rnd = random.Random(seed)
    out = []
    for group in range(25):
        words = [f"{rnd.choice('xyz')}{rnd.randrange(400)}" for _ in range(rnd.randrange(25, 80))]
        for _ in range(rnd.randrange(1, 7)):
            own = list(words)
            for _ in range(rnd.randrange(0, 5)):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
            out.append(" ".join(own[: len(own) - rnd.randrange(0, 4)]))
    return list(dict.fromkeys(out))


def brute(rows, size, percent):
    sets = {i: {tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(ids[a]), root(ids[b])))
                parent[high] = low
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("size", "percent", "limits"), [(3, 90, False), (5, 80, False), (3, 70, True)])
def test_pairs_are_verified_once(spark, monkeypatch, size, percent, limits):
    """With tiny limits every shingle is hot and every group of loose nodes is spread and banded."""
    if limits:
        for name in ("HOT_NODES", "LOOSE_NODES", "PAIRS_PER_PLACE"):
            monkeypatch.setattr(jaccard, name, 2)
        monkeypatch.setattr(jaccard, "HOT_SHARE", 10**9)
        monkeypatch.setattr(jaccard, "HOT_PLACES", 5)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 1)
    rows = list(enumerate(texts(size)))
    verified, plain = [], jaccard._verified

    def noted(docs, nodes, pairs, size, percent):
        verified.extend(map(tuple, pairs.select(F.least("hub", "member"), F.greatest("hub", "member")).collect()))
        return plain(docs, nodes, pairs, size, percent)

    monkeypatch.setattr(jaccard, "_verified", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)
    assert verified and len(verified) == len(set(verified)) and all(a != b for a, b in verified)
