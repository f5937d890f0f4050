from __future__ import annotations

import pytest
from hypothesis import settings

settings.register_profile("unhurried", deadline=None)
settings.load_profile("unhurried")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, words array<string>, n_words long, items string, host string, score double, removed string, _key string, _stack int, _path string, _id2 long, _mark2 long, _found string, _rules string, batch int"
LONG = " ".join(f"word{i % 997} and" for i in range(60_000)) + "."
ROWS = [
    (1, "The first text. It has two sentences!", "en", "a"),
    (1, "The first text. It has two sentences!", "en", "a"),  # a repeated row
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", "b"),
    (5, LONG, "en", "b"),
    (None, "Kein Schlüssel, aber ein Satz mit Wörtern.", "de", None),
    (6, "x", None, "b"),
    (7, "x", "en", "c"),
    (-8, "12345 !!! \x00 \x1c ½ 漢字", None, "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, lang, source, None, 7, ["w"], None, "i", "h", 0.5, "r", "k", 1, "p", 2, 3, "f", "u", 9) for i, t, lang, source in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
