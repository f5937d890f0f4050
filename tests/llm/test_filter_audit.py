"""The filter audit against a direct run of every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from lacuna.llm import filteraudit


def failures(rows):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        if len(words) < 50:
            failed.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if doc_id is not None and smallest[text] < doc_id:
            failed.add("E")
        out.append((doc_id, part or "", failed))
    return out


def brute(rows, labels):
    marked = failures(rows)
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {p for _, p, _ in marked}:
            left = [(i, f) for i, p, f in marked if p == part]
            total = list(left)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                failing = sum(name in f for _, f in total)
                shapley[part, name] += len(gone)
                lost = [sum(any(x[k] == 1 for x in labels if x[0] == i and i is not None) for i, _ in gone) for k in (1, 2)]
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(f == {name} for _, f in total), *lost)
    return sorted((*key, *value, shapley[key[0], key[1][key[2] - 1]]) for key, value in out.items())


def rows_of(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(90)] + ["Éa", "ABC", "x#", " "]

    def text():
        kind = rnd.random()
        if kind < 0.2:
            return rnd.choice(["", None, "same text", " \n", "A"])
        picked = rnd.sample(words[:90], 60) if kind < 0.6 else [rnd.choice(words) for _ in range(rnd.randrange(30, 80))]
        return " ".join(picked)

    texts = [text() for _ in range(n // 2)]
    return [(rnd.choice([None, *range(n)]), rnd.choice(texts), rnd.choice(["a", "b", None, ""])) for _ in range(n)]


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, id long, failed long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filteraudit.audit(docs, marks).collect())
    assert got == brute(rows, labels)


def test_audit_against_brute_force(spark, monkeypatch):
    rows = rows_of(3)
    rnd = random.Random(4)
    labels = [(rnd.choice([None, *range(150)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)]
    check(spark, rows, labels)
    monkeypatch.setattr(filteraudit, "ROWS_PER_PLACE", 3)  # a frequent text in many places
    monkeypatch.setattr(filteraudit, "BROADCAST_ROWS", 1)
    check(spark, rows, labels)


def test_colliding_hashes_are_told_apart(spark):
    """Only equal texts are copies, whatever their hashes."""
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "a", 7), (3, "a", 7), (None, "a", 7)], "id long, text string, hash long")
    assert [r["id"] for r in filteraudit.copies(docs).collect()] == [3, 3]


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    got = filteraudit.audit(odd, labels)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [(1, 1, 0), (6, 0, 1), (None, 1, 1)])
    assert filteraudit.audit(none, labels).collect() == []
    assert filteraudit.audit(odd, labels.limit(0)).count() == 600 * len({r[2] or "" for r in rows})
