from __future__ import annotations

import re
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lacuna.operators import detect
from lacuna.operators.redact import redact_with_hits
from lacuna.policy import RedactPolicy
from lacuna.sources import sizing

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, note string")


def run(spark, backstop, *texts):
    df = redact_with_hits(notes(spark, *texts), RedactPolicy(free_text=backstop))
    return [(r.note, r.redactions) for r in df.orderBy("id").collect()]


def test_dictionary_prefers_longer_terms_and_whole_words(spark):
    terms = {"mary": "PERSON", "mary ann": "PERSON", "C++": "LANG", "Zoë": "PERSON"}
    got = run(spark, detect.dictionary_backstop(terms), "mary ann and mary", "maryland", "C++ by Zoë, émary", None, "")
    assert got == [
        ("<PERSON> and <PERSON>", 2),
        ("maryland", 0),
        ("<LANG> by <PERSON>, émary", 2),
        (None, 0),
        ("", 0),
    ]
    assert run(spark, detect.dictionary_backstop({}), "x") == [("x", 0)]
    long = terms | {f"term{i}": "X" for i in range(detect.INLINE_TERMS)}
    texts = ("mary ann and mary", "maryland", "C++ by Zoë, émary", "term7, term70 xC++", None, "")
    assert run(spark, detect.dictionary_backstop(long), *texts)[:3] == got[:3]
    assert run(spark, detect.dictionary_backstop(long), *texts)[3:] == [("<X>, <X> xC++", 2), (None, 0), ("", 0)]


TEXTS = ("mary ann and mary", "maryland, ann", None, "", "say mary, ann; mary\nann x_mary", "mary ann lee mary ann")


def term_table(spark):
    listed = [("mary", "P"), ("mary ann", "Q"), ("ann", "R"), ("mary ann lee", "S"), ("unused", "Z")]
    return spark.createDataFrame(listed, "term string, label string")


def brute(text):
    labels = {r[0]: r[1] for r in [("mary", "P"), ("mary ann", "Q"), ("ann", "R"), ("mary ann lee", "S")]}
    regex = re.compile(r"\b(?:" + "|".join(sorted(labels, key=len, reverse=True)) + r")\b")
    return (None, 0) if text is None else regex.subn(lambda m: f"<{labels[m.group()]}>", text)


@pytest.mark.parametrize("broadcast", [True, False])
def test_term_table_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = notes(spark, *TEXTS).withColumn("id", F.when(F.col("id") != 2, F.col("id")))  # ids play no part
        out = detect.replace_terms(texts, "note", term_table(spark))
        assert sorted(((r.note, r.hits) for r in out.collect()), key=repr) == sorted(map(brute, TEXTS), key=repr)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" not in plan) == broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_term_table_on_long_texts_is_linear(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + " mary ann"
    started = time.time()
    row = detect.replace_terms(notes(spark, long), "note", term_table(spark)).first()
    assert row.hits == 1 and row.note.endswith("<Q>") and time.time() - started < 60


def make_detector():
    def find(texts):
        return [
            [
                detect.Span(0, 4, "PERSON", 0.9),
                detect.Span(0, 8, "PERSON", 0.6),
                detect.Span(9, 12, "LOCATION", 0.5),
                detect.Span(13, 14, "PERSON", 0.49),
                detect.Span(13, 14, "DATE", 0.99),
            ]
            for _ in texts
        ]

    return find


def test_detector_threshold_entities_and_overlap(spark):
    got = run(spark, detect.detector_backstop(lambda: make_detector()), "mary ann rio x", None, "")
    assert got == [("<PERSON> ann <LOCATION> x", 3), (None, 0), ("", 0)]
    everything = detect.detector_backstop(lambda: make_detector(), entities=(), threshold=0.99)
    assert run(spark, everything, "mary ann rio x") == [("mary ann rio <DATE>", 1)]


def test_detector_sees_scrubbed_text_only(spark):
    def factory():
        def find(texts):
            assert all("@" not in t for t in texts)
            return [[] for _ in texts]

        return find

    assert run(spark, detect.detector_backstop(factory), "a@b.com") == [("[email]", 1)]


def test_detector_must_answer_for_every_text(spark):
    with pytest.raises(Exception, match="answered 1 times for 2 texts"):
        policy = RedactPolicy(free_text=detect.detector_backstop(lambda: lambda texts: [[]]))
        redact_with_hits(notes(spark, "a", "b").coalesce(1), policy).collect()


def test_a_term_of_fifty_words(spark):
    long = " ".join(f"w{i}" for i in range(50))
    terms = spark.createDataFrame([(long, "LONG"), ("w0", "SHORT")], "term string, label string")
    rows = detect.replace_terms(notes(spark, f"x {long} y", "w0 w1"), "note", terms).orderBy("id").collect()
    assert [(r.note, r.hits) for r in rows] == [("x <LONG> y", 1), ("<SHORT> w1", 1)]


def test_hanging_calls_give_way(spark):
    def factory():
        import time as clock

        def rewrite(text):
            if "hang" in text:
                clock.sleep(600)
            return text + "!"

        return rewrite

    backstop = detect.rewriter_backstop(factory, timeout=1, parallel=2)
    df = redact_with_hits(notes(spark, "hang 1", "hang 2", "a", "b", "c").coalesce(1), RedactPolicy(free_text=backstop))
    got = [(r.note, r.redactions) for r in df.orderBy("id").collect()]
    assert got == [("[redacted]", 1)] * 2 + [("a!", 1), ("b!", 1), ("c!", 1)]


def test_rewriter_fails_closed(spark):
    def factory():
        import time as clock

        def rewrite(text):
            if "boom" in text:
                raise OSError("down")
            if "slow" in text:
                clock.sleep(5)
            if "silent" in text:
                return " \n"
            if "odd" in text:
                return None
            return text.replace("mary", "[name]")

        return rewrite

    backstop = detect.rewriter_backstop(factory, timeout=1)
    got = run(spark, backstop, "boom", "slow", "silent", "odd", "hi mary", "same", None, "", "hi mary")
    masked = ("[redacted]", 1)
    assert got == [masked] * 4 + [("hi [name]", 1), ("same", 0), (None, 0), ("", 0), ("hi [name]", 1)]


def test_other_columns_stay_out_of_python(spark):
    df = notes(spark, "x").withColumn("wide", F.repeat("note", 10))
    out = redact_with_hits(df.select("id", "note"), RedactPolicy(free_text=detect.detector_backstop(lambda: make_detector())))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)


def test_many_terms_with_one_first_word(spark, monkeypatch):
    """Terms meet texts by all their tokens, so that their first word gathers nothing; no Python runs."""
    beyond_broadcast(spark, monkeypatch)
    n = 20_000
    terms = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'the w' || id ELSE 'the w' || (id - 1) || ' and more' END AS term", "'L' || id AS label")
    df = spark.range(2_000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN null ELSE 'x the w' || id * 2 || CASE WHEN id % 2 = 0 THEN ' and more' ELSE ' and' END || ', the w' END AS note")
    out = detect.replace_terms(df, "note", terms)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.id % 4 == 0:
            assert (r.note, r.hits) == (None, 0)
        else:
            found = f"x <L{2 * r.id + 1}>, the w" if r.id % 2 == 0 else f"x <L{2 * r.id}> and, the w"
            assert (r.note, r.hits) == (found, 1)
    met = terms.select(F.pmod(F.xxhash64("term"), F.lit(64)).alias("task")).groupBy("task").count()
    low, mid, high = met.agg(F.min("count"), F.median("count"), F.max("count")).first()
    assert high < 4 * mid and low > 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_terms_of_any_characters_equal_the_row_lookup(spark, monkeypatch, broadcast):
    terms = {"C++": "LANG", "++": "PLUS", "a b": "AB", "b c": "BC", "a b c d": "LONG", "é": "E", "\U0001f600": "FACE", "x.": "DOT", ".": "STOP", "_u": "U", "": "NONE", "9 9": "NINES"}
    texts = ["C++ C+++ xC++ C++x", "a b c", "a b c d", "a b c dd", "é éa aé", "\U0001f600\U0001f600x", "x. x.y .", "_u _ux 9 9 9 9", "", None, "a  b", "a\nb c", "++a", "a++"] * 2
    index = detect._by_first_word(terms.items())
    want = [(t, 0) if not t else detect._replace_words(t, index, detect._starts(index)) for t in texts]
    if not broadcast:
        beyond_broadcast(spark, monkeypatch)
    table = spark.createDataFrame([*terms.items(), (None, "X"), ("a b", "A0")], "term string, label string")
    got = detect.replace_terms(notes(spark, *texts), "note", table).orderBy("id").collect()
    assert [(r.note, r.hits) for r in got] == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_names_that_the_lookup_uses_come_through(spark, monkeypatch, broadcast):
    if not broadcast:
        beyond_broadcast(spark, monkeypatch)
    df = notes(spark, "mary", "x").withColumns({c: F.lit(c) for c in ("_found", "_own", "_digest", "_terms", "_runs", "_tokens", "_done", "term", "label")})
    got = detect.replace_terms(df, "note", term_table(spark), "n").orderBy("id").collect()
    assert [r.note for r in got] == ["<P>", "x"] and all(r[c] == c for r in got for c in df.columns if c not in ("id", "note"))
    piped = detect.detector_backstop(lambda: make_detector())(df, "note", "n")
    assert piped.columns == [*df.columns, "n"] and piped.where("_found = '_found'").count() == 2


def test_lookup_holds_slices_of_texts(spark, monkeypatch):
    """A worker turns some texts of a batch into Python's strings, not all of them, and batches are bounded."""
    import pyarrow as pa

    texts = pa.array(["x" * 600_000, "y" * 600_000, None, "", "z" * 3_000_000, "end", None])
    cut = list(detect._slices(texts))
    assert [t for part in cut for t in part] == texts.to_pylist() and max(map(len, cut)) < len(texts)
    assert max(sum(len(t or "") for t in part) for part in cut) == 3_000_003 and list(detect._slices(texts[:0])) == [[]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        monkeypatch.setattr(detect, "SLICE_BYTES", 40)
        rows = [(k, None if k % 7 == 3 else "" if k % 7 == 4 else f"Ann{k} met Bob, ann met Ann") for k in range(300)]
        df = spark.createDataFrame(rows, "k int, t string").coalesce(2)
        terms = spark.createDataFrame([("Bob", "B"), ("met Ann", "M"), ("Ann", "A")], "term string, label string")
        got = {r.k: (r.t, r.hits) for r in detect.replace_terms(df, "t", terms).collect()}
        assert got == {k: (t, 0) if not t else (f"Ann{k} met <B>, ann <M>", 2) for k, t in rows}
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
