from __future__ import annotations

import random

import pytest

import rowwise
from lacuna.operators.redact import redact_text, text_hits
from lacuna.policy import PatternToggles

ALL = PatternToggles.all()


def scan(spark, texts, patterns=ALL):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r for r in text_hits(df, "t", patterns).collect()}
    return [rows[i] for i in range(len(texts))]


def scrubbed(spark, text, patterns=ALL):
    return scan(spark, [text], patterns)[0].t


def test_golden_rows(spark):
    (mixed,) = scan(spark, ["reach alice@example.com or 415-555-2671, ssn 123-45-6789"], PatternToggles())
    assert mixed.t == "reach [email] or [phone], ssn [ssn]"
    assert (mixed.email_hits, mixed.phone_hits, mixed.ssn_hits, mixed.hits) == (1, 1, 1, 3)
    good, bad = scan(spark, ["card 4111111111111111 here", "not a card 1234567890123456"], PatternToggles())
    assert (good.t, good.hits) == ("card [card]here", 1)
    assert (bad.t, bad.hits) == ("not a card 1234567890123456", 0)


def test_ip_is_opt_in(spark):
    assert scrubbed(spark, "host 10.0.0.1", PatternToggles()) == "host 10.0.0.1"
    assert scrubbed(spark, "host 10.0.0.1") == "host [ip]"


EDGES = [
    "",
    "4111111111111111 4111111111111111",
    "4111-1111-1111-1111,4111 1111 1111 1111.",
    "4111111111111111 123",
    "4111111111111111-x",
    "41111111111111111111",
    "a4111111111111111",
    "é4111111111111111é",
    "_4111111111111111",
    "id 4155552671 end",
    "id 14155552671 end",
    "id 914155552671 end",
    "id 9914155552671 end",
    "1.2.3.4.5",
    "999.999.999.999",
    "v1.2.3.4",
    "é1.2.3.4",
    "123-45-6789",
    "é123-45-6789",
    "_123-45-6789",
    "123-45-67890",
    "x́123-45-6789",
    "²123-45-6789",
    "‿123-45-6789",
    "𝐀123-45-6789 𝐀",
    "415 555 2671",
    "415 555　2671",
    "415\x1c555\x1f2671",
    "٤١٥-٥٥٥-٢٦٧١",
    "١٢٣-٤٥-٦٧٨٩",
    "٤١١١١١١١١١١١١١١١",
    "(415) 555-2671 (415)555.2671 +1 (415) 555-2671 +1415.555.2671",
    "+٩١ 415 555 2671",
    "a@b.co a@b.c a@b a.b+c%d@x-y.z.org",
    "a@b.com1@x.org",
    "a@b.com@c.org",
    "@@a@@b.com",
    "x@y.comé",
    "user@host..com .@.aa -@-.bb",
    "0000000000000 00000000000000",
    "4111111111111111 415-555-2671",
    "tabs\t415\t555\t2671\nnext 10.0.0.1\r\n",
    "[email] [card] [phone]",
    "$1 \\1 ${x} 415-555-2671",
]


def test_edges_equal_the_rowwise_oracle(spark):
    for text, row in zip(EDGES, scan(spark, EDGES)):
        expected, counts = rowwise.cascade(text)
        assert row.t == expected, text
        assert {n: row[f"{n}_hits"] for n in counts} == counts, text


def random_text(rng: random.Random) -> str:
    pieces = [
        lambda: "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 22))),
        lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        lambda: f"({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: f"u{rng.randint(0, 99)}@{rng.choice(['a', 'b-c', 'x.y'])}.{rng.choice(['com', 'c', 'org1'])}",
        lambda: ".".join(str(rng.randint(0, 400)) for _ in range(rng.randint(3, 5))),
        lambda: rng.choice(["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"]),
        lambda: rng.choice(["", " ", "-", ".", "+", "(", ")", "é", "_", "x", " ", "٣", "\n", ",", "@", "  "]),
    ]
    return "".join(rng.choice(pieces)() for _ in range(rng.randint(1, 12)))


def test_random_texts_equal_the_rowwise_oracle(spark):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(6000)]
    found = dict.fromkeys(rowwise.cascade("")[1], 0)
    for text, row in zip(texts, scan(spark, texts)):
        expected, counts = rowwise.cascade(text)
        assert row.t == expected, repr(text)
        assert {n: row[f"{n}_hits"] for n in counts} == counts, repr(text)
        for n, k in counts.items():
            found[n] += k
    assert min(found.values()) > 200, found  # every pattern was exercised


@pytest.mark.parametrize("names", [("email",), ("ssn", "phone"), ("card", "ip"), ()])
def test_toggles(spark, names):
    for text, row in zip(EDGES, scan(spark, EDGES, PatternToggles.only(*names))):
        assert row.t == rowwise.cascade(text, names)[0]


def test_null_text(spark):
    (row,) = scan(spark, [None])
    assert row.t is None and row.hits == 0


def test_counts_do_not_depend_on_ansi_mode(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert scan(spark, [None, "x", "4111111111111111"])[0].hits == 0
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_long_runs_stay_linear(spark):
    """No pattern may restart inside a run: these texts would take hours if one did."""
    texts = ["a" * 400_000 + "@", "1" * 400_000, "1-" * 200_000, "1." * 200_000, "a@" + "b." * 200_000]
    rows = scan(spark, texts)
    assert [r.hits for r in rows][:2] == [0, 0]


def test_filter_on_redacted_text_stays_small(spark):
    """Catalyst copies the cascade into a pushed filter; the copy must be linear in the steps."""
    df = spark.createDataFrame([("a",)], "t string")
    plan = redact_text(df, "t", ALL).where("t like '%[phone]%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 24
