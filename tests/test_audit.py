from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lacuna.operators import audit
from lacuna.sources.audit_log import append_audit, read_audit, stream_audit, stream_to_audit
from lacuna.streaming.audit_stream import read_rollup, windowed_rollup, write_rollup

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DDL = (
    "ts timestamp, database string, sql string, reason string, error string, rows bigint, redactions bigint, "
    "truncated boolean, duration_ms double"
)


def outcomes(spark):
    rows = [
        (START, "prod", "  SELECT 1\n", None, None, 1, 0, False, 1.26),
        (START + timedelta(microseconds=1), "prod", "DELETE FROM t WHERE e = 'a@b.com'", "blocked it", "x", 0, 0, False, 0.25),
        (START + timedelta(hours=1), "prod", "SELECT 2", None, "", 0, 0, False, 2.0),
        (START + timedelta(hours=2), "dev", "SELECT '" + "y" * 1984 + " a@b.com'", None, "no 415-555-2671", 5, 3, True, 9.99),
    ]
    return spark.createDataFrame(rows, DDL)


def test_audit_rows(spark):
    a, b, c, d = audit.audit_rows(outcomes(spark)).orderBy("ts").collect()
    assert (a.status, b.status, c.status, d.status) == ("allowed", "blocked", "error", "error")
    assert a.sql == "SELECT 1" and a.duration_ms == 1.3 and b.duration_ms == 0.2
    assert b.sql == "DELETE FROM t WHERE e = '[email]'"
    assert len(d.sql) == 2000 and d.sql.endswith("[email]") and d.error == "no [phone]"
    raw = audit.audit_rows(outcomes(spark), scrub=False).orderBy("ts").collect()
    assert "a@b.com" in raw[1].sql and raw[3].error == "no 415-555-2671"


def test_round_trip_keeps_microseconds_and_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = audit.audit_rows(outcomes(spark))
    append_audit(rows, path)
    (tmp_path / "audit" / "part-extra.txt").write_text('\n   \nnot json\n[1]\n{"ts": "2024-\n{"sql": "SELECT 9", "rows": "x", "truncated": [1]}\n')
    back = read_audit(spark, path)
    key = F.coalesce("sql", F.lit("")), "ts"
    got = back.where("status IS NOT NULL").orderBy(*key).collect()
    assert got == rows.orderBy(*key).collect()
    assert back.where("sql = 'SELECT 9'").count() == 1 and back.count() == 5
    assert back.select("database").where("database IS NULL").count() == 1


def test_lines_are_json_with_iso_times_and_nulls(spark, tmp_path):
    path = str(tmp_path / "audit")
    append_audit(audit.audit_rows(outcomes(spark)).where("status = 'blocked'"), path)
    (line,) = [r.value for r in spark.read.text(path).collect()]
    entry = json.loads(line)
    assert entry["ts"] == "2024-01-01T00:00:00.000001+00:00"
    assert list(entry) == list(audit.AUDIT_COLUMNS)


def test_rollup_and_reasons_and_last_entries(spark):
    rows = audit.audit_rows(outcomes(spark))
    got = {(r.database, r.status): (r.queries, r.redactions, r.truncated) for r in audit.rollup_by_status(rows).collect()}
    assert got[("dev", "error")] == (1, 3, 1) and got[("prod", "allowed")] == (1, 0, 0)
    reason = "CASE WHEN id < 20 THEN 'a' WHEN id < 40 THEN 'b' ELSE 'c' || id % 7 END AS reason"
    many = spark.range(60).selectExpr("'blocked' AS status", reason)
    top = sorted((r.rank, r.reason, r.queries) for r in audit.top_reasons(many).collect())
    assert top[:2] == [(1, "a", 20), (1, "b", 20)] and [t[0] for t in top[2:]] == [3] * 6 + [9]
    ties = spark.range(90).selectExpr("'blocked' AS status", "'r' || id % 30 AS reason")
    assert [(r.queries, r.rank) for r in audit.top_reasons(ties).collect()] == [(3, 1)] * 30
    newest = audit.last_entries(rows, 2).collect()
    assert [r.time for r in newest] == ["02:00:00", "01:00:00"] and len(newest[0].query) == 120


def test_payloads(spark):
    with_payload = audit.outcome_payload(outcomes(spark)).orderBy("ts").collect()
    ok, blocked, failed, _ = (json.loads(r.payload) for r in with_payload)
    assert ok == {"status": "ok", "database": "prod", "row_count": 1, "truncated": False, "redactions": 0}
    assert blocked == {"status": "blocked", "database": "prod", "reason": "blocked it"}
    assert failed == {"status": "error", "database": "prod", "error": ""}


def test_stream_append_and_windows_equal_batch(spark, tmp_path):
    """Entries arrive in several files, some late; every window comes out with the batch counts."""
    log = spark.range(600).select(
        (F.lit(START) + F.expr("make_interval(0, 0, 0, 0, 0, CAST(id AS INT), 0)")).alias("ts"),
        F.concat(F.lit("db"), F.col("id") % 2).alias("database"),
        F.lit("allowed").alias("status"),
        F.lit("SELECT 1").alias("sql"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("error"),
        F.lit(1).cast("bigint").alias("rows"),
        (F.col("id") % 3).alias("redactions"),
        F.lit(False).alias("truncated"),
        F.lit(1.0).alias("duration_ms"),
    )
    for lo in range(0, 600, 150):
        minute = "timestampdiff(MINUTE, timestamp'2024-01-01', ts)"
        append_audit(log.where(f"{minute} BETWEEN {lo} AND {lo + 149}").coalesce(1), str(tmp_path / "in"))
    live = stream_audit(spark, str(tmp_path / "in"), files_per_trigger=1)
    write_rollup(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    append_audit(log.where("ts < timestamp'2024-01-01 00:30:00'").coalesce(1), str(tmp_path / "in"))  # hours late
    write_rollup(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = read_rollup(spark, str(tmp_path / "out"))
    every = windowed_rollup(log.unionAll(log.where("ts < timestamp'2024-01-01 00:30:00'")))
    assert sorted(map(str, got.collect())) == sorted(map(str, every.select(*got.columns).collect()))
    assert got.count() == 20
    copy = stream_audit(spark, str(tmp_path / "in"))
    stream_to_audit(copy, str(tmp_path / "copy"), str(tmp_path / "cp2")).awaitTermination()
    assert read_audit(spark, str(tmp_path / "copy")).distinct().exceptAll(log).count() == 0
