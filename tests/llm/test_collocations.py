"""Collocations against a direct count."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lacuna.llm import collocations


def brute(rows, max_words, min_count, percent, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = tuple(w for w in re.split(r"[ \t]+", piece) if w)
            n["und" if lang is None else lang] += len(words)
            for size in range(1, max_words + 1):
                for k in range(len(words) - size + 1):
                    f["und" if lang is None else lang][words[k : k + size]] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if any(100 * b >= percent * a for b in inside):
                continue
            cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "ô", "x", "new", "york", " ", "don't", "é1"]
    ends = [". ", ", ", "\n", " ", " ", " ", " \t ", "\r", "\x0b", ";"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(60)))
    return [(text(), rnd.choice(["en", "de", None])) for _ in range(60)] + [(None, "en"), ("", None), ("one", "fr")]


@pytest.mark.parametrize(("max_words", "min_count", "percent", "top", "budget"), [(3, 5, 50, 2_000, 1 << 21), (3, 4, 90, 7, 40), (2, 3, 50, 50, 100), (4, 4, 60, 100, 60)])
def test_collocations_against_brute_force(spark, max_words, min_count, percent, top, budget):
    """Budgets of a few suffixes extend prefixes to two words and spread those below."""
    rows = rows_of(max_words * 100 + percent)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.collocations(docs, max_words=max_words, min_count=min_count, contained_percent=percent, top=top, budget=budget)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, max_words, min_count, percent, top)


def test_products_beyond_64_bits(spark, monkeypatch):
    """The score of a phrase that occurs 10^12 times is exact."""
    big = 10**12
    counts = [("en", "", 0, 5 * big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, 2 * big - 1)]
    table = spark.createDataFrame(counts, "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: table)
    (row,) = collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    a, left, right = 2 * big - 1, 3 * big, 2 * big + 1
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 1_000_000 * a * a // (left * right))


def test_odd_tables(spark, odd, none):
    docs = odd.withColumnsRenamed({"host": "phrase", "items": "group", "n_words": "f"})
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = collocations.collocations(docs, min_count=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 2, 50, 2_000)
    assert collocations.collocations(none).collect() == []


def test_segments_keep_pieces_whole():
    raw = b"one two. three, four five\n" + b"w " * 50 + b". end"
    for size in (1, 5, 17, 1_000):
        parts = list(collocations.segments(raw, size))
        assert b"".join(parts) == raw
        assert all(collocations.KIND[p[-1]] == 2 for p in parts[:-1])


def test_groups_keep_to_the_budget():
    """A group holds a budget and one more bucket at most; every suffix has one group."""
    rnd = np.random.default_rng(1)
    one = rnd.zipf(1.3, collocations.BUCKETS).clip(max=100_000).astype(np.int64)
    two = rnd.zipf(1.5, collocations.BUCKETS).clip(max=50_000).astype(np.int64)
    plan = collocations.Plan(one, two, 1_000)
    sizes = np.bincount(plan.one[~plan.extended], weights=one[~plan.extended])
    assert sizes.max() < 2_000 and plan.extended.any()
    assert (plan.parts[two > 1_000] * 1_000 >= two[two > 1_000]).all()
    deep = plan.two + plan.parts
    assert plan.two.min() > plan.one.max() and len(np.unique(plan.two[plan.parts > 1])) == (plan.parts > 1).sum() and deep.max() > 0
