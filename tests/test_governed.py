from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lacuna.operators import audit, governed
from lacuna.policy import ColumnRule, Governance, PatternToggles, ReadPolicy, RedactPolicy
from lacuna.sources import sizing
from lacuna.sources.registry import Sources

READ = ReadPolicy(pii_tables=("contacts",), max_rows=3)
POLICY = RedactPolicy(rules=(ColumnRule("email", "hash"),), salt="s")


def people(spark, n=5):
    return spark.range(n).selectExpr("id", "'u' || id || '@x.com' AS email", "'call 415-555-2671' AS note")


def test_pii_tables_need_named_columns(spark):
    for columns in ([], ["*"], ["c.*"]):
        with pytest.raises(governed.PolicyViolation, match="contacts"):
            governed.governed_select(people(spark), "app.Contacts", columns, READ, POLICY)
    assert governed.governed_select(people(spark), "metrics", ["*"], READ, POLICY).count() == 3
    free = ReadPolicy(allow_star=True, pii_tables=("contacts",))
    assert governed.governed_select(people(spark), "contacts", [], free, POLICY).columns == ["id", "email", "note"]


def test_governed_select_cuts_by_raw_order_then_redacts(spark):
    got = governed.governed_select(people(spark), "contacts", ["email", "note"], READ, POLICY, ["id"]).collect()
    assert len(got) == 3 and {r.note for r in got} == {"call [phone]"}
    assert all(r.email.startswith("sha256:") for r in got)


@pytest.mark.parametrize(("limit", "rows", "cut"), [(4, 4, True), (5, 5, False), (9, 5, False), (0, 0, True)])
def test_bounded_read(spark, limit, rows, cut):
    flag = governed.bounded_read_flag(people(spark), limit).first()
    assert (flag.row_count, flag.truncated) == (rows, cut)
    assert governed.bounded_read(people(spark), limit, ["id"]).count() == rows


GOVERNANCE = Governance(read=READ, redact=POLICY, overrides={"dev": {"read": {"max_rows": 9, "allow_star": True}}})


def test_one_call_governs_and_reports(spark):
    tables = {"contacts": people(spark)}
    sources = {"prod": tables, "dev": tables}
    run = governed.govern(sources, GOVERNANCE, "prod", "contacts", ["id", "email", "note"], ["id"])
    assert [r.id for r in run.rows.collect()] == [0, 1, 2] and run.rows.first().note == "call [phone]"
    payload = json.loads(audit.outcome_payload(run.outcome).first().payload)
    assert list(payload) == ["status", "database", "columns", "row_count", "truncated", "redactions", "note"]
    assert (payload["row_count"], payload["truncated"], payload["redactions"]) == (3, True, 6)
    row = audit.audit_rows(run.outcome).first()
    assert row.status == "allowed" and row.sql == "SELECT id, email, note FROM contacts ORDER BY id" and row.duration_ms > 0

    blocked = governed.govern(sources, GOVERNANCE, "prod", "contacts")
    assert blocked.rows is None and "contacts" in blocked.outcome.first().reason
    free = governed.govern(sources, GOVERNANCE, "dev", "contacts")  # its own limits
    assert (free.outcome.first().rows, free.outcome.first().truncated, free.rows.count()) == (5, False, 5)
    for table, columns in (("nope", ["id"]), ("contacts", ["nope"])):
        failed = governed.govern(sources, GOVERNANCE, "prod", table, columns)
        assert failed.rows is None and failed.outcome.first().error and failed.outcome.first().reason is None
    with pytest.raises(KeyError, match="registered"):
        governed.govern(sources, GOVERNANCE, "nope", "contacts", ["id"])


def test_row_level_policy_never_fails_open(spark):
    df = spark.createDataFrame([("a", "x", 5), ("b", "y", 6)], "src string, note string, age int")
    rules = [("a", "note", " MASK ", 4), ("b", "note", "scramble", None), (None, "age", "null", None), (None, "age", "partial", 1)]
    listed = spark.createDataFrame(rules, "source string, column string, strategy string, keep int")
    rows = governed.redact_by_source(df, "src", listed).collect()
    assert [(r.note, r.age) for r in rows] == [("[redacted]", None)] * 2
    last = listed.withColumn("position", F.monotonically_increasing_id())
    assert [r.age for r in governed.redact_by_source(df, "src", last).collect()] == ["*", "*"]


def source_data(spark):
    rows = [
        (1, "a", "x@y.com", "415-555-2671", 7),
        (2, "b", "x@y.com", None, 8),
        (3, None, "x@y.com", "t", 9),
        (4, "zzz", "x@y.com", "t", None),
    ]
    rules = [
        ("a", "EMAIL", "hash", None),
        ("a", "n", "partial", 0),
        ("b", "email", "null", None),
        (None, "email", "mask", None),
        (None, "n", "hash", None),
    ]
    df = spark.createDataFrame(rows, "id int, src string, email string, note string, n int")
    return df, spark.createDataFrame(rules, "source string, column string, strategy string, keep int")


def by_source(spark):
    df, rules = source_data(spark)
    out = governed.redact_by_source(df, "src", rules, ["email", "note", "n"], RedactPolicy(salt="s"))
    return out, {r.id: r for r in out.collect()}


def test_row_level_policy(spark):
    out, rows = by_source(spark)
    assert rows[1].email.startswith("sha256:") and rows[1].n == "*" and rows[1].note == "[phone]"
    assert rows[2].email is None and rows[2].note is None and rows[2].n.startswith("sha256:")
    assert rows[3].email == rows[4].email == "[redacted]"
    assert rows[4].n is None and rows[3].src is None
    assert out.columns == ["id", "src", "email", "note", "n"]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_row_level_policy_without_broadcast_gives_the_same(spark, monkeypatch):
    _, expected = by_source(spark)
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, rows = by_source(spark)
        assert rows == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_spreads_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
    big = spark.range(0, 8000, 1, 8).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'k' || id ELSE 'hot' END AS key")
    small = spark.createDataFrame([("hot", 1), ("k3", 2)], "key string, v int")
    joined = sizing.lookup_join(big, small, "key")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 8000
    assert joined.where("v = 1").count() == big.where("key = 'hot'").count()
    assert joined.where("v = 2").count() == 1


def test_sources_keep_their_own_policies(spark):
    governance = Governance(
        read=ReadPolicy(pii_tables=("users",)),
        redact=POLICY,
        overrides={"prod": {"read": {"max_rows": 50}}, "dev": {"redact": {"rules": (), "patterns": PatternToggles.only()}}},
    )
    read, redact = governance.for_source("prod")
    assert (read.max_rows, read.pii_tables, redact) == (50, ("users",), POLICY)
    assert governance.for_source("staging")[0].max_rows == 1000
    with pytest.raises(KeyError, match="nope"):
        governance.for_source("nope", ["prod"])
    prod = people(spark, 1)
    dev = people(spark, 1).selectExpr("CAST(id AS STRING) AS id", "email", "1 AS extra")
    rows = {r.database: r for r in governed.redact_sources({"prod": prod, "dev": dev}, governance).collect()}
    assert rows["prod"].email.startswith("sha256:") and rows["prod"].extra is None and rows["prod"].id == "0"
    assert rows["dev"].email == "u0@x.com" and rows["dev"].note is None


def test_sizing_probes(spark, tmp_path):
    assert sizing.fits_broadcast(spark.range(10))
    assert not sizing.fits_broadcast(spark.range(sizing.BROADCAST_MAX_ROWS + 1))
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert "Exchange" in sizing.spread_small(small)._jdf.queryExecution().executedPlan().toString()
    assert sizing.spread_small(spark.range(10**12)).sameSemantics(spark.range(10**12))


def test_shared_folder_is_below_the_session_setting(spark):
    folder = sizing.shared_folder(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and folder != sizing.shared_folder(spark, "x")


def test_registry(spark):
    sources = Sources(spark)
    sources.register("a", spark.range(1))
    assert sources.names() == ["a"]
    with pytest.raises(KeyError, match="registered: a"):
        sources["b"]


def test_a_governed_read_reads_its_source_once(spark, tmp_path):
    """Rows, shape and flag come from one job over the source; whatever its columns are called."""
    people(spark, 50).withColumns({"place": F.lit(7), "hits": F.lit(8), "_hits": F.lit(9)}).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    columns = ["note", "id", "place", "hits", "id"]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("governed", "one read")
    run = governed.govern({"prod": {"t": df}}, Governance(read=READ, redact=POLICY), "prod", "t", columns, ["id"])
    jobs = tracker.getJobIdsForGroup("governed")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= 2  # the sorted cut may plan its only exchange as a job of its own
    outcome = run.outcome.first()
    assert (outcome.rows, outcome.truncated, outcome.redactions, outcome.result_columns) == (3, True, 3, columns)
    assert [tuple(r) for r in run.rows.collect()] == [("call [phone]", k, 7, 8, k) for k in range(3)]
    broken = df.withColumn("id", F.expr("CASE WHEN id = 1 THEN raise_error('broken') ELSE id END"))
    failed = governed.govern({"prod": {"t": broken}}, Governance(read=READ, redact=POLICY), "prod", "t", ["id"], ["id"])
    assert failed.rows is None and failed.outcome.first().error and not failed.outcome.first().rows


def test_row_level_policy_with_clashing_names(spark, monkeypatch):
    df, rules = source_data(spark)
    odd = df.withColumns({c: F.lit(c) for c in ("_rules", "_shared", "rules", "shared", "source", "c0", "c1_rule", "_rule_source", "rule_source")})
    for most in (sizing.BROADCAST_MAX_ROWS, 0):
        monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", most)
        got = governed.redact_by_source(odd, "src", rules, ["email", "note", "n"], RedactPolicy(salt="s"))
        assert got.columns == odd.columns
        own = {r.id: r for r in got.collect()}
        assert own[2].email is None and own[3].email == "[redacted]" and own[4].n is None
        assert all(r[c] == c for r in own.values() for c in odd.columns[5:])


def test_rows_without_a_key_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_MAX_ROWS", 0)
    big = spark.range(0, 900, 1, 3).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'k' || id % 9 END AS key")
    small = spark.createDataFrame([("k1", 1), (None, 5)], "key string, v int")
    assert sizing.lookup_join(big, small, "key").where("key IS NULL AND v IS NULL").count() == 300
    assert sizing.lookup_join(big, small, "key").count() == 900
    assert sizing.lookup_join(big, small, "key", "inner").count() == 100


def test_small_tables_are_pinned(spark):
    rules = spark.createDataFrame([("a", {"x": ("hash", 4)})], "source string, rules map<string, struct<strategy: string, keep: int>>")
    local = sizing.pinned(rules)
    assert local.collect() == rules.collect() and local.schema == rules.schema
    assert sizing.pinned(spark.range(sizing.BROADCAST_MAX_ROWS + 1)) is None
