"""Stateful streams over entries that arrive in deliveries."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacuna.operators.sessions import sessions
from lacuna.policy import RedactPolicy
from lacuna.streaming import audit_stream as live
from lacuna.streaming.redact_stream import read_redacted, write_redacted, write_redacted_by_source

START = datetime(2024, 1, 1, 22, 0)
ENTRY = "query_id long, ts timestamp, database string, status string, redactions long"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def entry(n, minutes, database="prod", status="allowed", redactions=1):
    return (n, None if minutes is None else at(minutes), database, status, redactions)


class Inbox:
    """A folder that deliveries arrive in."""

    def __init__(self, spark, path, schema=ENTRY):
        self.spark, self.path = spark, str(path)
        self.schema = spark.createDataFrame([], schema).schema

    def deliver(self, rows, close=False):
        df = self.spark.createDataFrame(rows, self.schema)
        if close:
            df = df.unionByName(live.closing_entry(self.spark, self.schema, query_id=-1))
        df.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def test_closed_windows_and_late_entries(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in")
    closed, seen = str(tmp_path / "closed"), str(tmp_path / "seen")

    def run():
        live.write_closed_rollup(inbox.stream(), closed, str(tmp_path / "s1")).awaitTermination()
        live.write_rollup(inbox.stream(), seen, str(tmp_path / "s2")).awaitTermination()

    def windows():
        return sorted((r.window_start.hour, r.database, r.queries, r.redactions) for r in live.read_appended(spark, closed).collect())

    def late():
        return sorted((r.window_start.hour, str(r.database), r.queries) for r in live.late_entries(live.read_rollup(spark, seen), live.read_appended(spark, closed)).collect())

    inbox.deliver([entry(1, 5), entry(2, 50, redactions=None), entry(3, 65), entry(4, None)])
    run()
    assert windows() == [] and late() == []  # five minutes into the next hour are within the lateness
    inbox.deliver([entry(5, 30), entry(6, 75)])  # the first window is still open
    run()
    assert windows() == [(22, "prod", 3, 2)] and late() == []
    inbox.deliver([entry(7, 40), entry(8, 41, database=None), entry(9, 80)])  # now it is closed
    run()
    assert windows() == [(22, "prod", 3, 2)] and late() == [(22, "None", 1), (22, "prod", 1)]
    inbox.deliver([entry(10, 85)], close=True)
    run()
    assert windows() == [(22, "prod", 3, 2), (23, "prod", 4, 4)]
    run()  # nothing new
    assert len(windows()) == 2


def test_sessions_across_midnight_equal_batch(spark, tmp_path):
    """Gaps of exactly the limit and a microsecond more; a late entry that joins two sessions."""
    times = [0, 20, 50, 100, 119, 125, 155, 185 + 1e-6 / 60 * 100, 260, 300]
    rows = [entry(n, m) for n, m in enumerate(times)] + [entry(90 + n, m, "dev") for n, m in enumerate((10, 400))] + [entry(99, 70, None), entry(98, None)]
    batch = sessions(spark.createDataFrame(rows, ENTRY).unionByName(spark.createDataFrame([entry(50, 75)], ENTRY)), 30)
    want = sorted((str(r.database), r.started, r.ended, r.queries, r.redactions) for r in batch.collect())
    assert ("prod", at(0), at(155), 8, 8) in want and len([w for w in want if w[0] == "prod"]) == 4
    inbox = Inbox(spark, tmp_path / "in")
    out = str(tmp_path / "out")
    deliveries = [rows[:3] + rows[10:11] + rows[12:], rows[3:7] + [entry(50, 75)], rows[7:10] + rows[11:12]]
    for n, part in enumerate(deliveries):
        inbox.deliver(part, close=n == 2)
        live.write_sessions(inbox.stream(), out, str(tmp_path / "state"), lateness="1 hour").awaitTermination()
    got = live.read_appended(spark, out).where("queries > 0")
    assert sorted((str(r.database), r.started, r.ended, r.queries, r.redactions) for r in got.collect()) == want


def test_replays_change_nothing(spark, tmp_path):
    inbox, out = Inbox(spark, tmp_path / "in"), str(tmp_path / "out")
    first, second = [entry(n, n) for n in range(20)], [entry(20 + n, 30 + n) for n in range(20)]
    for rows in (first, first + second, second + second[:3] + first, [entry(99, 200)], second):
        inbox.deliver(rows)
        live.write_without_replays(inbox.stream(), ["query_id"], out, str(tmp_path / "state"), "30 minutes").awaitTermination()
    ids = sorted(r.query_id for r in live.read_appended(spark, out).collect())
    assert ids == [*range(40), 99]
    once = live.without_replays(spark.createDataFrame(first + first, ENTRY), ["query_id"])
    assert once.count() == 20


def test_matches_equal_batch(spark, tmp_path):
    ask = "query_id long, ts timestamp, database string"
    answer = "query_id long, ts timestamp, status string"
    log = [(n, at(n), "prod") for n in range(30)] + [(None, at(3), "prod")]
    outcomes = [(n, at(n + d), "ok") for n in range(30) for d in ((0, 10) if n % 5 == 0 else (10.001,) if n % 3 == 0 else (-1, 4))] + [(77, at(5), "ok"), (None, at(3), "x")]
    want = live.match_outcomes(spark.createDataFrame(log, ask), spark.createDataFrame(outcomes, answer))
    assert want.where("answered IS NULL").count() == 8 + 1 and want.count() == 31 + 6
    left, right = Inbox(spark, tmp_path / "log", ask), Inbox(spark, tmp_path / "outcomes", answer)
    out = str(tmp_path / "out")
    for lo in (0, 10, 20):
        left.deliver([r for r in log if lo <= (r[1] - START).total_seconds() / 60 < lo + 10], close=lo == 20)
        right.deliver([r for r in outcomes if lo <= (r[1] - START).total_seconds() / 60 < (lo + 10 if lo < 20 else 99) or (lo == 0 and r[1] < START)], close=lo == 20)
        live.write_matches(left.stream(), right.stream(), out, str(tmp_path / "state")).awaitTermination()
    got = live.read_appended(spark, out).where(f"ts < '{live.CLOSING_TIME}'")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rules_are_read_again_for_every_micro_batch(spark, tmp_path):
    rules = lambda strategy: spark.createDataFrame([("a", "mail", strategy, 4), (None, "mail", "mask", None)], "source string, column string, strategy string, keep int")
    inbox, out = Inbox(spark, tmp_path / "in", "id int, src string, mail string, batch int"), str(tmp_path / "out")
    inforce = {"now": rules("null")}

    def run():
        write_redacted_by_source(inbox.stream(), "src", lambda _: inforce["now"], out, str(tmp_path / "state"), RedactPolicy(salt="s")).awaitTermination()

    inbox.deliver([(1, "a", "x@y.org", 7), (2, None, "x@y.org", 8)])
    run()
    inforce["now"] = rules("partial")
    inbox.deliver([(3, "a", "x@y.org", 9)])
    run()
    got = {r.id: (r.mail, r.batch) for r in read_redacted(spark, out).collect()}
    assert got == {1: (None, 7), 2: ("[redacted]", 8), 3: ("***.org", 9)}
    assert read_redacted(spark, out).columns == ["id", "src", "mail", "batch"]


def test_a_column_called_batch_comes_through(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in", "batch int, note string")
    inbox.deliver([(7, "a@b.com"), (9, "x")])
    out = str(tmp_path / "out")
    write_redacted(inbox.stream(), RedactPolicy(), out, str(tmp_path / "state"), str(tmp_path / "counts")).awaitTermination()
    assert sorted(map(tuple, read_redacted(spark, out).collect())) == [(7, "[email]"), (9, "x")]
    assert sorted(r.batch for r in spark.read.parquet(out).collect()) == [7, 9]


@pytest.mark.parametrize("gap", [5, 60])
def test_sessions_of_a_hot_group(spark, gap):
    rows = spark.range(0, 6_000).select(F.timestamp_seconds(F.col("id") * 37 % 86_400).alias("ts"), F.when(F.col("id") % 3 > 0, "hot").alias("database"), F.lit(1).alias("redactions"))
    got = sorted((str(r.database), r.queries) for r in sessions(rows, gap).collect())
    by, want = {}, []
    for r in rows.orderBy("ts").collect():
        last = by.get(r.database)
        if last and (r.ts - last[0]).total_seconds() <= gap * 60:
            by[r.database] = (r.ts, last[1] + 1)
        else:
            want += [(str(r.database), last[1])] if last else []
            by[r.database] = (r.ts, 1)
    assert got == sorted(want + [(str(k), n) for k, (_, n) in by.items()])
