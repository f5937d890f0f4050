"""Line dedup against an own search for repeated runs of lines; nothing of the module is used but the operator."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lacuna.llm import linededup
from lacuna.llm.common import hash_filter


def brute(docs):
    """Texts without the planted passages that stood somewhere before, by order of id and of place."""
    seen, out = set(), {}
    for doc_id, parts in docs:
        left = []
        for lines in parts:
            key = tuple(lines)
            if key in seen and len(lines) > 1 and sum(len(x.split()) for x in lines) >= 30:
                continue
            seen.add(key)
            left += lines
        out[doc_id] = " ".join(left).split()
    return out


def sentence(rnd):
    return " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 13))) + rnd.choice(".!?")


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed, monkeypatch):
    """Passages of five lines and more at any place, twice in one text, one after the other; short ones stay."""
    rnd = random.Random(seed)
    passages = [[sentence(rnd) for _ in range(rnd.randrange(5, 14))] for _ in range(25)] + [[sentence(rnd) for _ in range(2)] for _ in range(5)]
    passages = [p for p in passages if len(p) == 2 or sum(len(x.split()) for x in p) >= 31]
    docs = []
    for doc_id in range(120):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            parts.append([sentence(rnd)] if rnd.random() < 0.6 else rnd.choice(passages))
            parts.append([sentence(rnd)])  # own words between, so that runs are those planted
        docs.append((doc_id, parts))
    short = {tuple(p) for p in passages if sum(len(x.split()) for x in p) < 30}
    rows = [(i, rnd.choice([" ", "\n"]).join(line for p in parts for line in p)) for i, parts in docs]
    want = brute([(i, [p for p in parts]) for i, parts in docs])
    assert short and sum(len(w) for w in want.values()) < 0.8 * sum(len(t.split()) for _, t in rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if seed:
        monkeypatch.setattr(linededup, "HOT_ROWS", 3)  # frequent chunks meet their first by broadcast
        monkeypatch.setattr(linededup, "HOT_SHARE", 10**9)
    got = linededup.remove_repeated(table).collect()
    assert {r["doc_id"]: r["text"].split() for r in got} == want
    raw = {i: t.encode() for i, t in rows}
    for r in got:  # the spans are what is gone
        edges = [0, *[x for span in r["removed"] for x in span], len(raw[r["doc_id"]])]
        assert b"".join(raw[r["doc_id"]][a:b] for a, b in zip(edges[::2], edges[1::2])).decode() == r["text"]


def test_a_third_of_all_rows_is_one_text(spark):
    rnd = random.Random(8)
    text = " ".join(sentence(rnd) for _ in range(8))
    rows = [(i, text if i % 3 == 0 else " ".join(sentence(rnd) for _ in range(4))) for i in range(300)] + [(0, text), (1000, None), (1001, "")]
    got = linededup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    kept = [r["doc_id"] for r in got if r["text"] == text]
    assert kept == [0, 0] and sum(r["text"] == "" for r in got) == 100 and len(got) == len(rows)
    assert all(r["text"] == dict(rows)[r["doc_id"]] for r in got if r["doc_id"] % 3 and r["doc_id"] < 300)


def test_filter_holds_every_hash(spark):
    rng = np.random.default_rng(2)
    known = rng.integers(-(2**63), 2**63 - 1, 5_000)
    held = hash_filter(spark.createDataFrame([(int(x),) for x in known], "h long").repartition(3))
    assert held(known).all()
    others = rng.integers(-(2**63), 2**63 - 1, 20_000)
    assert held(others).mean() < 0.2
    assert not hash_filter(spark.createDataFrame([], "h long"))(known).any()


def test_runs_of_several_texts_at_once():
    rnd = random.Random(4)
    for _ in range(200):
        texts = ["".join(rnd.choice(["w. ", "two words. ", "\n", " ", "é! ", "a b c d e\n"]) for _ in range(rnd.randrange(12))).encode() for _ in range(rnd.randrange(1, 6))]
        marks = []
        for k, t in enumerate(texts):
            n = len(linededup.chunks(t))
            marks += [(k, a, min(n - 1, a + rnd.randrange(3))) for a in range(n) if rnd.random() < 0.3]
        owner, a, b = (np.array([m[i] for m in marks], np.int64) for i in range(3))
        late = [{x for k, i, j in marks if k == n for x in range(i, j + 1)} for n in range(len(texts))]
        want = [linededup.removed_spans(linededup.chunks(t), late[k], len(t), 3, 2) for k, t in enumerate(texts)]
        assert linededup.cut_runs(texts, owner, a, b, 3, 2) == want


def test_texts_are_cut_twice_and_bytes_told_once(spark, monkeypatch):
    """Hashes first, then places and bytes together; each content of a slice stands in one row."""
    passage = " ".join(f"Line {k} of the passage says a few words more." for k in range(12))
    rows = [(k, f"Own words number {k}. {passage} An end of its own, {k}.") for k in range(6)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: calls.append(1) or real(self, *a, **b))
    found = {r.doc_id: r for r in linededup.remove_repeated(docs).collect()}
    assert len(calls) == 3  # hashes, places and bytes, removal
    assert found[0].text == rows[0][1] and all(passage[200:300] not in found[k].text for k in range(1, 6)) and found[9].text is None

    class Everything:
        value = staticmethod(lambda hashes: hashes == hashes)

    bare = docs.coalesce(1).selectExpr("doc_id AS id", "doc_id AS mark", "CAST(text AS BINARY) AS text")
    made = linededup._occurrences(bare, Everything()).collect()
    told = [(r.h1, r.h2, bytes(r.content)) for r in made if r.content is not None]
    assert len(told) == len(set(told)) == len({(r.h1, r.h2) for r in made}) < len(made)
