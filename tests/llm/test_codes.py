"""Codes of words beyond the characters there are, and ids of any text in WARC headers."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lacuna.llm import decontaminate, warc


def found(items, docs, window):
    codes, machine = decontaminate.automaton_of(items, window)
    fits = decontaminate.known_runs(machine)
    return [decontaminate.scan(decontaminate.words_of(d), codes, machine, fits) for d in docs], codes


@pytest.mark.parametrize("seed", range(5))
def test_two_characters_find_what_one_finds(monkeypatch, seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(22)]
    text = lambda n, own: " ".join(rnd.choice(own) for _ in range(n)).encode()
    items = [(k, text(rnd.randrange(1, 9), words)) for k in range(12)]
    docs = [text(60, words + ["x", "y"]) for _ in range(30)] + [b"", b"x"]
    want, codes = found(items, docs, 3)
    assert {len(c) for c in codes.values()} == {1}
    monkeypatch.setattr(decontaminate, "CODES", 10)
    got, codes = found(items, docs, 3)
    assert {len(c) for c in codes.values()} == {2} and len(set(codes.values())) == len(codes)
    assert got == want and any(runs for runs, _ in got)


def test_more_words_than_characters():
    n = decontaminate.CODES + 50_000
    one, other = (decontaminate.code_of(k, 2) for k in (n - 1, n - 2))
    assert len(one) == 2 and one != other and one.encode("utf-32") and decontaminate.code_of(decontaminate.CODES - 1, 1).encode("utf-32")


@given(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30)))
def test_ids_in_headers(id):
    value = warc.urn(id)
    assert warc.id_of(value) == id and value.isprintable() and value.isascii() and value.count(">") == 1


def test_records_of_odd_ids(spark):
    rows = [("a>b\r\nX: y", "http://a/", "same"), ("", "http://a/", "same"), (None, None, "same"), ("ü %3E", "http://b/", None), ("z", "http://b/", "")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    records, _ = warc.archive(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in records.collect()}
    assert got == {"a>b\r\nX: y": ("response", None, 4), "": ("revisit", "a>b\r\nX: y", 4), None: ("revisit", "a>b\r\nX: y", 4), "ü %3E": ("response", None, 0), "z": ("revisit", "ü %3E", 0)}
