from __future__ import annotations

import warnings

import pytest
from pyspark.sql import Observation

from lacuna.operators.redact import redact, redact_observed, redact_with_hits, redaction_counts
from lacuna.policy import ColumnRule, PatternToggles, RedactPolicy
from lacuna.streaming.redact_stream import observed_counts, write_redacted


def people(spark):
    rows = [
        (1, "a@b.com", "call me at 415-555-2671", ["x@y.org", None], ("10.0.0.1", 5), {"k@e.com": "123-45-6789"}),
        (2, None, None, None, None, None),
        (3, "c@d.com", "", [], (None, 6), {}),
    ]
    ddl = "id bigint, email string, note string, tags array<string>, s struct<a:string,b:int>, m map<string,string>"
    return spark.createDataFrame(rows, ddl)


POLICY = RedactPolicy(rules=(ColumnRule("EMAIL", "hash"),), patterns=PatternToggles.all(), salt="x")


def test_end_to_end_with_nested_text(spark):
    rows = {r.id: r for r in redact_with_hits(people(spark), POLICY).collect()}
    assert rows[1].email.startswith("sha256:")
    assert rows[1].note == "call me at [phone]"
    assert rows[1].tags == ["[email]", None]
    assert rows[1].s.asDict() == {"a": "[ip]", "b": 5}
    assert rows[1].m == {"k@e.com": "[ssn]"}  # map keys are left alone
    assert rows[1].redactions == 5
    assert rows[2].asDict() == {**dict.fromkeys(rows[2].asDict()), "id": 2, "redactions": 0}
    assert rows[3].tags == [] and rows[3].s.a is None and rows[3].redactions == 1


def test_nested_can_be_switched_off(spark):
    policy = RedactPolicy(nested=False)
    row = redact(people(spark), policy).where("id = 1").first()
    assert row.tags == ["x@y.org", None] and row.email == "[email]"


def test_schema_and_names_are_kept(spark):
    df = people(spark)
    assert redact(df, POLICY).columns == df.columns
    assert redact(df, RedactPolicy()).schema.simpleString() == df.schema.simpleString()


def test_counts_agree_in_all_three_forms(spark):
    df = people(spark)
    (row,) = redaction_counts(df, POLICY).collect()
    assert (row.column_rules, row.email, row.ssn, row.phone, row.ip) == (2, 1, 1, 1, 1)
    assert (row.redactions, row.rows, row.card, row.free_text) == (6, 3, 0, 0)
    seen = Observation("counts")
    redact_observed(df, POLICY, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == row.asDict()
    assert sum(r.redactions for r in redact_with_hits(df, POLICY).collect()) == row.redactions


def test_hash_tokens_are_not_rescanned_by_default(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) AS email")
    kept = redact(df, POLICY)
    assert kept.where("email NOT RLIKE '^sha256:[0-9a-f]{12}$'").count() == 0
    rescanned = redact(df, RedactPolicy(rules=POLICY.rules, salt="x", rescan_hashed=True))
    assert rescanned.where("email LIKE '%[phone]%'").count() > 100


def test_partial_output_is_still_scanned(spark):
    df = spark.createDataFrame([("tel 415-555-2671",)], "t string")
    assert redact(df, RedactPolicy(rules=(ColumnRule("t", "partial", 12),))).first().t == "****[phone]"


def test_duplicate_names(spark):
    df = spark.createDataFrame([("a@b.com", "c@d.com", 1)], "x string, y string, z int").toDF("a", "A", "a")
    assert tuple(redact(df, RedactPolicy()).first()) == ("[email]", "[email]", 1)


def test_column_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([("a@b.com", ("c@d.com",))], "x string, s struct<f:string>").toDF("a.b`c", "o'k")
    row = redact_with_hits(df, RedactPolicy()).first()
    assert row[0] == "[email]" and row[1].f == "[email]" and row.redactions == 2


def test_warns_about_a_missing_salt(spark):
    with pytest.warns(UserWarning, match="salt"):
        redact(people(spark), RedactPolicy(rules=(ColumnRule("email", "hash"),)))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        redact(people(spark), POLICY)


def test_unused_columns_are_not_scanned(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "p"))
    df = redact(spark.read.parquet(str(tmp_path / "p")), POLICY).select("id", "note")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,note:string>" in plan and "Exchange" not in plan


def test_stream_equals_batch(spark, tmp_path):
    df = people(spark)
    for i in range(3):
        df.where(f"id = {i + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_redacted(stream, POLICY, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "counts"))
    query.awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    assert got == sorted(map(str, redact(df, POLICY).collect()))
    assert observed_counts(spark, str(tmp_path / "counts")).first()["redactions"] == 6
    again = write_redacted(stream, POLICY, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "counts"))
    again.awaitTermination()  # a restart adds nothing
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
