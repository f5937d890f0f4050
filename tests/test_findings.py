from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from lacuna.operators.findings import cut, findings
from lacuna.operators.redact import redact, redact_with_hits
from lacuna.policy import PatternToggles, RedactPolicy

PIECES = ["a@b.com", "x.y+z@mail.example.org", "123-45-6789", "4111 1111 1111 1111", "4111111111111111", "1234567890123456", "415-555-2671", "+1 (415) 555-2671",
          "10.0.0.1", "1.2.3.4.5", "[email]", "é", "漢", "\U0001f600", "", "", "4111111111111111 123", "2125551234", " ", ", ", "", "٤١٥-٥٥٥-٢٦٧١", "x", "9"]


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(14))) for _ in range(n)]


def test_cutting_the_spans_gives_the_cascade(spark):
    rows = [(t, t[::-1]) for t in texts(3, 400)] + [(None, ""), ("a@b.com", None), ("a@b.com", "a@b.com"), ("a@b.com", "a@b.com")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "key int, note string, other string").repartition(3)
    policy = RedactPolicy(patterns=PatternToggles.all())
    found = findings(df, ["key"], salt="s")
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "pattern")
    spans = found.groupBy("key").pivot("column_name", ["note", "other"]).agg(F.collect_list(span))
    joined = df.join(spans.withColumnsRenamed({"note": "s1", "other": "s2"}), "key", "left")
    got = joined.select("key", F.expr(cut("note", "s1")).alias("note"), F.expr(cut("other", "s2")).alias("other"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, redact(df, policy).collect()))
    hits = redact_with_hits(df, policy).agg(F.sum("redactions")).first()[0]
    assert found.count() == hits > 500


def test_a_finding_says_where_and_what(spark):
    df = spark.createDataFrame([(1, "é\U0001f600 a@b.com, 10.0.0.1", 5), (2, None, 6)], "id int, note string, start int")
    rows = [tuple(r) for r in findings(df, ["id", "start"], salt="s").orderBy("start").collect()]
    digest = lambda v: hashlib.sha256(f"s{v}".encode()).hexdigest()
    assert sorted(rows, key=lambda r: r[4]) == [(1, 5, "note", "email", 3, 10, digest("a@b.com")), (1, 5, "note", "ip", 12, 20, digest("10.0.0.1"))]
    assert findings(df, ["id"], ["id"]).count() == 0 and findings(df.limit(0), ["id"]).count() == 0
    only = findings(df, ["id"], patterns=PatternToggles.only("ip"))
    assert [r.pattern for r in only.collect()] == ["ip"]


def test_no_python_and_one_shuffle_of_hits(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "id int, note string")
    plan = findings(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
