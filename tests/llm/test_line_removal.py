"""Texts without the lines above the limits of their host."""

from __future__ import annotations

from lacuna.llm import linequality


def test_lines_above_the_limits_go(spark, odd, none):
    footer, own = "all rights reserved by the host", lambda i: f"line of its own {i} with some words more"
    texts = {i: f"{own(i)}\n{footer.upper() if i % 2 else '  ' + footer}\r\nthe end of text {i}" for i in range(12)}
    texts |= {20: f"{footer}\n{own(20)}\n{footer}", 21: f"{own(21)}\n{footer}\n", 22: footer, 23: None, 24: f"{footer}\n\n{footer}", 25: f"Ü {own(25)}\n{footer}\nß"}
    rows = [(i, t, "a") for i, t in texts.items()] + [(20, texts[20], "a"), (20, texts[20], "b"), (None, texts[21], "a"), (None, texts[25], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = linequality.clean(docs).collect()
    want = {i: f"{own(i)}\nthe end of text {i}" for i in range(12)} | {21: f"{own(21)}\n", 22: "", 23: None, 24: "", 25: f"Ü {own(25)}\nß"}
    for r in got:
        if r["doc_id"] in want:
            assert r["text"] == want[r["doc_id"]]
        raw = ("" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        assert r["n_left"] == len((r["text"] or "").split())
        if r["doc_id"] is not None:
            edges = [0, *[x for span in r["removed"] for x in span], len(raw)]
            assert b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode() == (r["text"] or "")
    assert sorted(r["text"] for r in got if r["doc_id"] == 20) == sorted([own(20), own(20), texts[20]])
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted([want[21], want[25]])
    assert len(got) == len(rows) and linequality.clean(odd).count() == odd.count() and linequality.clean(none).count() == 0
    verdicts = {(r["doc_id"], r["n_left"], r["kept"]) for r in linequality.judge(docs).collect()}
    assert verdicts == {(r["doc_id"], r["n_left"], r["kept"]) for r in got}
