from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lacuna.functions import column_rules as rules
from lacuna.operators.redact import apply_rules, column_rule_counts
from lacuna.policy import ColumnRule, RedactPolicy


def one(spark, value, ddl, **columns):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def test_mask_and_null(spark):
    df = spark.createDataFrame([(1, "alice@example.com"), (2, None)], "id bigint, email string")
    masked = apply_rules(df, RedactPolicy(rules=(ColumnRule("email"),)))
    assert [r.email for r in masked.orderBy("id").collect()] == ["[redacted]", None]
    nulled = apply_rules(df, RedactPolicy(rules=(ColumnRule("id", "null"),)))
    assert nulled.schema["id"].dataType.simpleString() == "bigint"
    assert {r.id for r in nulled.collect()} == {None}


def test_hash_equals_sha256_of_salt_and_text(spark):
    row = one(
        spark,
        "a@b.com",
        "string",
        plain=rules.hash_token(F.col("v")),
        salted=rules.hash_token(F.col("v"), "s"),
        long=rules.hash_token(F.col("v"), digits=64),
    )
    assert row.plain == "sha256:" + hashlib.sha256(b"a@b.com").hexdigest()[:12]
    assert row.salted == "sha256:" + hashlib.sha256(b"sa@b.com").hexdigest()[:12]
    assert row.long == "sha256:" + hashlib.sha256(b"a@b.com").hexdigest()
    assert one(spark, None, "string", h=rules.hash_token(F.col("v"))).h is None


@pytest.mark.parametrize(
    ("text", "keep", "expected"),
    [
        ("123456789", 4, "*****6789"),
        ("1234", 4, "****"),
        ("12", 4, "**"),
        ("", 4, ""),
        ("secret", 0, "******"),
        ("secret", -2, "******"),
        ("né€𝄞x", 2, "***𝄞x"),
        (None, 4, None),
    ],
)
def test_partial(spark, text, keep, expected):
    assert one(spark, text, "string", p=rules.partial(F.col("v"), keep)).p == expected


def test_rules_match_without_case_last_wins_and_cover_duplicates(spark):
    df = spark.createDataFrame([("x", "y", "z", 5)], "a string, b string, c string, d int").toDF("a", "A", "a", "d")
    policy = RedactPolicy(rules=(ColumnRule("a", "null"), ColumnRule("A", "partial", 0), ColumnRule("nope")))
    out = apply_rules(df, policy)
    assert out.columns == ["a", "A", "a", "d"]
    assert tuple(out.first()) == ("*", "*", "*", 5)


def test_counts_are_of_non_null_raw_cells(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("y", None)], "a string, b int")
    counts = column_rule_counts(df, [ColumnRule("A", "null"), ColumnRule("b", "hash")])
    assert {(r.column, r.strategy, r.cells) for r in counts.collect()} == {("a", "null", 2), ("b", "hash", 2)}
    assert column_rule_counts(df, [ColumnRule("zzz")]).count() == 0


def test_unknown_strategy_is_refused():
    with pytest.raises(ValueError, match="unknown strategy"):
        ColumnRule("a", "scramble")
