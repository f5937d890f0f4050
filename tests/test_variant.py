from __future__ import annotations

import json

from pyspark.sql import functions as F

from lacuna.functions.wire import wire_json
from lacuna.operators.redact import redact, redact_with_hits
from lacuna.policy import ColumnRule, PatternToggles, RedactPolicy

POLICY = RedactPolicy(patterns=PatternToggles.all())
VALUES = [
    {"a": "x@y.org", "b": [1, 2.5, None, True, "call 415-555-2671", {"x@y.org": "key stays", "deep": [["10.0.0.1"]]}]},
    "only a text with 123-45-6789",
    ["\"q\": \"x@y.org\"", "back\\slash x@y.org", "é\n\t漢 x@y.org", "", "no hit: at all"],
    {"": {"": ""}},
    [], {}, 7, None,
]


def variants(spark, values=VALUES):
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(99, None)]
    return spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("v"))


def scrub(value):
    for old, new in (("x@y.org", "[email]"), ("415-555-2671", "[phone]"), ("10.0.0.1", "[ip]"), ("123-45-6789", "[ssn]")):
        value = value.replace(old, new)
    return value


def walk(value):
    if isinstance(value, str):
        return scrub(value)
    if isinstance(value, list):
        return [walk(v) for v in value]
    if isinstance(value, dict):
        return {k: walk(v) for k, v in value.items()}
    return value


def test_strings_at_every_depth(spark):
    rows = redact_with_hits(variants(spark), POLICY).select("id", F.to_json("v").alias("j"), "redactions").collect()
    got = {r.id: (None if r.j is None else json.loads(r.j), r.redactions) for r in rows}
    assert got == {**{k: (walk(v), n) for k, (v, n) in enumerate(zip(VALUES, (3, 1, 3, 0, 0, 0, 0, 0)))}, 99: (None, 0)}
    plain = redact(variants(spark), POLICY)
    assert plain.schema["v"].dataType.simpleString() == "variant"
    assert {r.id: r.j and json.loads(r.j) for r in plain.select("id", F.to_json("v").alias("j")).collect()} == {k: v for k, (v, _) in got.items()}


def test_values_without_hits_keep_their_types(spark):
    df = spark.sql("SELECT to_variant_object(named_struct('day', DATE'2024-01-01', 'note', 'none')) AS v")
    done = redact(df, POLICY).select(F.schema_of_variant("v").alias("s")).first().s
    assert "DATE" in done
    off = RedactPolicy(patterns=PatternToggles.all(), nested=False)
    assert redact(variants(spark, ["x@y.org"]), off).where("id = 0").select(F.to_json("v").alias("j")).first().j == '"x@y.org"'


def test_inside_arrays_and_rules(spark):
    df = variants(spark).select("id", F.array("v", "v").alias("list"), F.struct("v").alias("s"))
    got = redact_with_hits(df, POLICY).where("id = 0").select(F.to_json(F.col("list")[1]).alias("a"), F.to_json("s.v").alias("b"), "redactions").first()
    assert json.loads(got.a) == json.loads(got.b) == walk(VALUES[0]) and got.redactions == 9
    masked = redact(variants(spark), RedactPolicy(rules=(ColumnRule("v", "mask"),))).where("id < 7").select("v").distinct().collect()
    assert [r.v for r in masked] == ["[redacted]"]


def test_wire_form(spark):
    got = [json.loads(r.json) for r in wire_json(variants(spark)).collect()]
    assert {r["id"]: r["v"] for r in got} == {**dict(enumerate(VALUES)), 99: None}
