"""The pipeline's near-duplicate stage at its own threshold: five words, 0.8."""

from __future__ import annotations

import random

import corpus_pipeline


def shingles(text: str, size: int) -> set:
    w = text.lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_stage_at_five_words(spark):
    """Scattered edits around the threshold: one document of each class of linked ones stays, by brute force."""
    rnd, texts = random.Random(5), []
    for family in range(14):
        base = [f"f{family}w{rnd.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(base))
        for edits in (6, family):
            own = list(base)
            for k in range(edits):
                own[(2 * k + 1) * 300 // (2 * edits)] = f"e{len(texts)}x{k}"
            texts.append(" ".join(own))
    assert similarity(shingles(texts[0], 5), shingles(texts[1], 5)) >= 0.8 and similarity(shingles(texts[0], 3), shingles(texts[1], 3)) < 0.9
    sets = [shingles(t, 5) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(least) and len(kept) < len(texts) - 14


def test_stage_on_the_documents(spark):
    """No two documents that stay are linked at five words and 0.8."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    sets = [s for s in (shingles(r["text"] or "", 5) for r in rows) if s]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
