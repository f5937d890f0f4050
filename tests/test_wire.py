from __future__ import annotations

import json
from datetime import date, datetime, timezone
from decimal import Decimal

from lacuna.functions.wire import wire, wire_json

DDL = (
    "i int, l bigint, f double, b boolean, s string, d date, t timestamp, n timestamp_ntz, p decimal(10,2), "
    "x binary, a array<timestamp_ntz>, m map<int,decimal(4,1)>, r struct<d:date,s:string>, y interval day to second"
)


def row(spark):
    moment = datetime(2024, 1, 2, 3, 4, 5, 678901)
    from datetime import timedelta

    values = (
        1,
        2,
        0.5,
        True,
        'say "hi"',
        date(2024, 1, 2),
        moment.replace(tzinfo=timezone.utc),
        datetime(2024, 1, 2, 3, 4, 5),
        Decimal("12.30"),
        b"\x00\x01\x02",
        [moment, None],
        {7: Decimal("1.5")},
        (date(2024, 1, 2), None),
        timedelta(hours=1),
    )
    return spark.createDataFrame([values, (None,) * len(values)], DDL)


EXPECTED = {
    "i": 1,
    "l": 2,
    "f": 0.5,
    "b": True,
    "s": 'say "hi"',
    "d": "2024-01-02",
    "t": "2024-01-02T03:04:05.678901+00:00",
    "n": "2024-01-02T03:04:05",
    "p": 12.3,
    "x": "<3 bytes>",
    "a": ["2024-01-02T03:04:05.678901", None],
    "m": {"7": 1.5},
    "r": {"d": "2024-01-02", "s": None},
}


def test_every_type_and_null(spark):
    first, empty = (json.loads(r.json) for r in wire_json(row(spark)).collect())
    interval = first.pop("y")
    assert first == EXPECTED and "01:00:00" in interval
    assert set(empty.values()) == {None} and len(empty) == 14


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    df = row(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert wire(df).where("i = 1").first().t == EXPECTED["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_duplicate_names_survive(spark):
    df = spark.createDataFrame([(1, b"ab")], "a int, b binary").toDF("a", "a")
    assert tuple(wire(df).first()) == (1, "<2 bytes>")


def test_embeddings_stay_numbers(spark):
    df = spark.createDataFrame([([0.5, 0.25],)], "e array<float>")
    assert json.loads(wire_json(df).first().json) == {"e": [0.5, 0.25]}


def test_duplicate_names_are_written_in_order(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string").toDF("a", "a")
    assert wire_json(df).first().json == '{"a":1,"a":"x"}'
