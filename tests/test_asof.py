from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacuna.operators.asof import as_of_join
from lacuna.operators.screen import screen_as_of

START = datetime(2024, 1, 1)


def brute(rows, versions, keyed=True):
    out = []
    for k, t, n in rows:
        known = [(s, v) for vk, s, v in versions if s is not None and t is not None and s <= t and (not keyed or (vk is not None and vk == k))]
        latest = max((s for s, _ in known), default=None)
        out.append((k, t, n, max((v for s, v in known if s == latest), default=None)))
    return sorted(out, key=repr)


def tables(spark, seed, hot=0.5):
    rnd = random.Random(seed)
    time = lambda: rnd.choice([None, *[START + timedelta(seconds=rnd.randrange(5_000)) for _ in range(12)]])
    key = lambda: "hot" if rnd.random() < hot else rnd.choice(["a", "b", "c", None])
    rows = [(key(), time(), n) for n in range(400)] + [("hot", START + timedelta(seconds=2_500), n) for n in range(60)]
    versions = [(rnd.choice(["hot", "a", "b", None]), time(), n) for n in range(50)]
    return rows, versions, spark.createDataFrame(rows, "k string, at timestamp, n int").repartition(3), spark.createDataFrame(versions, "who string, since timestamp, v int")


@pytest.mark.parametrize("place", [None, 7])
def test_as_of_against_brute_force(spark, place):
    """A key with half of all rows, ties of time, nulls everywhere; with small places each cell is spread."""
    rows, versions, left, right = tables(spark, 1)
    got = as_of_join(left, right, "k", "at", "who", "since", ["v"], rows_per_place=place).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, versions)
    for_all = as_of_join(left, right, None, "at", None, "since", ["v"], rows_per_place=place).collect()
    assert sorted(map(tuple, for_all), key=repr) == brute(rows, versions, keyed=False)


def test_as_of_keeps_clashing_columns_and_takes_empty_tables(spark):
    _, _, left, right = tables(spark, 2)
    odd = left.withColumns({c: F.lit(7) for c in ("row", "t", "kind", "place", "b", "value", "v", "c0", "places")})
    got = as_of_join(odd, right, "k", "at", "who", "since", ["v"])
    assert got.columns == [c for c in odd.columns if c != "v"] + ["v"]
    assert got.where("row = 7 AND t = 7 AND kind = 7 AND place = 7 AND b = 7 AND value = 7 AND c0 = 7 AND places = 7").count() == odd.count()
    assert as_of_join(left, right.limit(0), "k", "at", "who", "since", ["v"]).where("v IS NULL").count() == left.count()
    assert as_of_join(left.limit(0), right, "k", "at", "who", "since", ["v"]).count() == 0


def test_no_task_gets_the_hot_key(spark):
    """Half of all rows have one key; spread by time and place, none of the swept cells is large."""
    rows = spark.range(0, 20_000, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE 'k' || id % 50 END AS k", "timestamp_seconds(id) AS at", "id")
    versions = spark.range(100).selectExpr("'hot' AS who", "timestamp_seconds(id * 200) AS since", "CAST(id AS INT) AS v")
    got = as_of_join(rows, versions, "k", "at", "who", "since", ["v"], rows_per_place=500)
    assert got.where("k = 'hot' AND v = CAST(id DIV 200 AS INT)").count() == 10_000 and got.where("v IS NULL").count() == 10_000


def test_screening_by_the_policy_in_force(spark):
    hour = lambda h: START + timedelta(hours=h)
    log = [("prod", hour(h), "SELECT * FROM contacts") for h in range(5)] + [("dev", hour(h), "SELECT * FROM contacts") for h in (0, 2)] + [("prod", None, "SELECT * FROM contacts")]
    versions = [("prod", hour(1), ["Contacts"], False), ("prod", hour(2), ["contacts"], True), ("prod", hour(3), ["users"], None), ("prod", hour(4), None, False), (None, hour(1), ["contacts"], False)]
    df = spark.createDataFrame(log, "database string, ts timestamp, sql string").withColumn("_guarded", F.lit("mine"))
    table = spark.createDataFrame(versions, "source string, since timestamp, pii_tables array<string>, allow_star boolean")
    got = screen_as_of(df, table)
    assert got.columns == ["database", "ts", "sql", "_guarded", "rule", "reason", "allowed"] and got.where("_guarded = 'mine'").count() == 8
    told = sorted((r.database, str(r.ts), r.allowed) for r in got.collect())
    want = [("prod", str(hour(h)), h != 1) for h in range(5)] + [("dev", str(hour(0)), True), ("dev", str(hour(2)), False), ("prod", "None", True)]
    assert told == sorted(want)
