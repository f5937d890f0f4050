"""The functions inside the tasks against brute force."""

from __future__ import annotations

import heapq
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import decontaminate, jaccard, langid, linededup, linequality, packing, puquality, sharding, warc


def slow_jump(key: int, shards: int) -> int:
    key, at, to = key % 2**64, -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1), st.integers(1, 200))
def test_jump_hash(keys, shards):
    found = sharding.jump_hash(np.array(keys, np.int64), shards)
    assert found.tolist() == [slow_jump(k, shards) for k in keys]


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(20_000)
    before, after = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    moved = before != after
    assert set(after[moved]) == {40} and 300 < moved.sum() < 700
    assert np.bincount(before, minlength=40).min() > 400
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def slow_cost(points, penalty, length):
    best = [0] + [None] * (len(points) - 1)
    for j in range(1, len(points)):
        best[j] = penalty[j] + min(best[i] + length - (points[j] - points[i]) for i in range(j) if points[j] - points[i] <= length)
    return best[-1]


@given(st.lists(st.integers(1, 16), min_size=1, max_size=60), st.randoms())
def test_best_cuts(gaps, rnd):
    points = np.cumsum([0, *gaps])
    penalty = np.array([rnd.choice([0, 2, 9]) for _ in points])
    penalty[0] = penalty[-1] = 0
    cuts = packing.best_cuts(points, penalty, 16)
    assert cuts[0] == 0 and cuts[-1] == points[-1] and max(np.diff(cuts)) <= 16
    at = dict(zip(points.tolist(), penalty.tolist()))
    cost = sum(16 - (b - a) + at[b] for a, b in zip(cuts, cuts[1:]))
    assert cost == slow_cost(points.tolist(), penalty.tolist(), 16)


def test_stream_keeps_every_token_once():
    rnd = random.Random(5)
    docs = [np.array([rnd.randrange(9) for _ in range(rnd.choice([1, 3, 40, 900]))] + [8], np.uint16) for _ in range(60)]
    stream = packing.Stream(100, np.arange(9) == 4, 64, 500)
    blocks = [c for k, ids in enumerate(docs) for c in stream.feed(k, ids)] + [stream.cut(last=True)]
    rows = [r for c in blocks for r in zip(*[list(x) for x in c])]
    at, fill = [0] * len(docs), Counter()
    for doc, start, length, ids, total, sequence, offset in rows:
        assert start == at[doc] and total == len(docs[doc]) and offset == fill[sequence]
        assert ids.as_py() == docs[doc][start : start + length].astype("<u4").tobytes()
        at[doc] += length
        fill[sequence] += length
    assert at == [len(d) for d in docs] and max(fill.values()) <= 64
    assert sorted(fill) == list(range(100, 100 + len(fill)))
    assert sum(64 - n for n in fill.values() if n & (n - 1)) < 0.2 * sum(at)


@pytest.fixture(scope="module")
def encoder():
    public = pytest.importorskip("public_tokenizers")
    return packing.ChunkEncoder(public.path("word_bpe_49k.json"))


ODD = "aZé.,;:!?'\"0½ \t\n\x0b\x0c\x1c\x85 ̧́ÅİßΣςǅﬁ漢字<|endoftext|>don't we'LL ẖH̱"


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.text(alphabet=ODD), st.text(alphabet="abc .,!'ÉSs")), min_size=1, max_size=4))
def test_chunk_encoder_equals_the_tokenizer(encoder, texts):
    tokens, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])] == want


def slow_hits(words, items, size):
    hit, found = set(), set()
    for item, own in items:
        n = min(size, len(own))
        for k in range(len(own) - n + 1) if own else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return hit, found


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=4), st.lists(st.sampled_from("abcdX"), max_size=40))
def test_automaton_scan(items, words):
    items = [(str(i), own) for i, own in enumerate(items)]
    codes, machine = decontaminate.automaton_of([(i, " ".join(own).encode()) for i, own in items], 3)
    text = (" , ".join(words)).encode()
    runs, found = decontaminate.scan(decontaminate.words_of(text), codes, machine, decontaminate.known_runs(machine))
    hit, want = slow_hits([w.lower() for w in words], [(i, own) for i, own in items], 3)
    assert {k for a, b in runs for k in range(a, b)} == hit and found == want
    for (a, b), (x, y) in zip(runs, decontaminate.byte_spans(text, runs)):
        assert decontaminate.words_of(text[x:y]) == decontaminate.words_of(text)[a:b]


def slow_shingles(text, size):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \n\x0b ", max_size=60)), min_size=1, max_size=6))
def test_shingle_sets(texts):
    value, bound = jaccard.shingle_sets(pa.array(texts, pa.string()), 3)
    own = [set(value[a:b].tolist()) for a, b in zip(bound, bound[1:])]
    slow = [slow_shingles(t, 3) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in slow]
    for i in range(len(texts)):
        assert np.all(np.diff(value[bound[i] : bound[i + 1]].astype(object)) > 0)
        for j in range(i):
            assert len(own[i] & own[j]) == len(slow[i] & slow[j])


def test_prefix_length_never_misses():
    for n in range(1, 300):
        for m in range(n, 340):
            common = -(-90 * (n + m) // 190)  # the least overlap that links
            if common <= n:
                assert jaccard.prefix_length(n, 90) >= n - common + 1 and jaccard.prefix_length(m, 90) >= m - common + 1


def slow_repeated(words, size=5):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    return len({k for i, w in enumerate(windows) if w in often for k in range(i, i + size)})


@given(st.lists(st.lists(st.integers(0, 1), max_size=30), min_size=1, max_size=5))
def test_repeated_words(texts):
    word, owner = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert linequality.repeated_words(word, owner, len(texts)).tolist() == [slow_repeated(t) for t in texts]


PASSAGE = "One sentence stands here. Another one follows it closely. A third sentence has some words more. Then a fourth comes along with it. The fifth is the last of them all."


@given(st.text(alphabet="ab. \n", max_size=80), st.text(alphabet="ab. \n", max_size=80))
def test_chunks_of_a_paragraph_resist_shifts(before, after):
    text = f"{before}\n{PASSAGE}\n{after}".encode()
    contents = {text[a:b] for a, b, _, _ in linededup.chunks(text)}
    assert {PASSAGE.encode()[a:b] for a, b, _, _ in linededup.chunks(PASSAGE.encode())} <= contents


@given(st.text(alphabet="aB.!? \n\t", max_size=200))
def test_chunks_cover_all_words(text):
    raw = text.encode()
    parts = linededup.chunks(raw)
    assert b" ".join(raw[a:b] for a, b, _, _ in parts).split() == raw.split()
    assert sum(p[3] for p in parts) == len(raw.split())


def test_filter_has_no_false_negatives_and_ngrams_are_right():
    letters = langid.letter_table()
    gram, owner = langid.grams(["ab c", "", "é1é"], letters)
    spell = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF)
    own = [sorted(spell(g) for g, o in zip(gram.tolist(), owner.tolist()) if o == k) for k in range(3)]
    assert own == [[" ab", " c ", "ab", "ab "], [], [" é ", " é "]]
    slots, rng = 1 << 12, np.random.default_rng(1)
    known = rng.integers(0, 1 << 62, 300)
    mask = np.zeros((1, slots), np.int64)
    for probe in range(3):
        np.bitwise_or.at(mask[0], langid.slot_of(known, probe, slots), 1)
    model = langid.LanguageFilter(("xx",), mask, np.zeros(1), 3)
    assert langid.hits_by_language(model, known, np.zeros(300, np.int64), 1)[0, 0] == 300


def test_risk_minimisation_separates_and_keeps_the_prior():
    rng = np.random.default_rng(3)
    positive = rng.normal(1.5, 1, (800, 2)).astype(np.float32)
    hidden = np.vstack([rng.normal(1.5, 1, (1600, 2)), rng.normal(-1.5, 1, (400, 2))]).astype(np.float32)
    weight, bias = puquality.minimise(positive, hidden, 0.8)
    good = 1 / (1 + np.exp(-(hidden @ weight + bias)))
    assert good[:1600].mean() > 0.9 and good[1600:].mean() < 0.4


def test_features_of_odd_texts():
    x = puquality.features(pa.array([None, "", "a", "A!! b", "é" * 50]))
    assert x.shape == (5, puquality.FEATURES) and np.isfinite(x).all() and not x[0].any()


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1), st.sets(st.integers(0, 2**64 - 1), min_size=1))
def test_sketches_never_overstate_the_difference(a, b):
    x, y = (jaccard.parity_sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)
