from __future__ import annotations

from lacuna.operators import catalog, detect, discover
from lacuna.operators.redact import redact
from lacuna.policy import ColumnRule, PatternToggles, RedactPolicy

ALL = PatternToggles.all()


def tables(spark):
    users = spark.createDataFrame(
        [(1, "a@b.com", "x"), (2, None, "call 415-555-2671, 415-555-2672")], "uid int, Email string, comment string"
    )
    stock = spark.createDataFrame([(5, "Oslo")], "capacity int, label string")
    return {"users": users, "stock": stock}


def test_name_discovery(spark):
    cat = catalog.column_catalog(tables(spark))
    named = {(r.table_name, r.column_name, r.ordinal, r.filled) for r in discover.pii_columns_by_name(cat).collect()}
    assert named == {("users", "Email", 2, 1), ("stock", "capacity", 1, 1)}  # "capacity" contains "city"
    rules = {r.column_name: r.strategy for r in discover.pii_rule_suggestions(cat).collect()}
    assert rules == {"Email": "hash", "capacity": "mask"}
    assert [r.table_name for r in discover.pii_tables(cat).collect()] == ["stock", "users"]


def test_content_profile(spark):
    rows = {(r.column_name, r.pattern): r for r in discover.content_profile(tables(spark)["users"], "users").collect()}
    assert (rows["comment", "phone"].hits, rows["comment", "phone"].rows_hit) == (2, 1)
    assert (rows["Email", "email"].scanned, rows["Email", "email"].share) == (1, 1.0)
    assert rows["comment", "email"].hits == 0 and len(rows) == 10
    empty = discover.content_profile(tables(spark)["users"].limit(0), "users").collect()
    assert {(r.scanned, r.hits, r.share) for r in empty} == {(0, 0, 0.0)}
    assert discover.content_profile(spark.range(3), "numbers").count() == 0


def test_policy_suggestions(spark):
    frames = tables(spark)
    got = discover.policy_suggestions(catalog.column_catalog(frames), discover.profile_content(frames), 0.3)
    rows = {(r.table_name, r.column_name): (r.strategy, r.basis) for r in got.collect()}
    assert rows == {
        ("users", "Email"): ("hash", "name+content"),
        ("users", "comment"): ("mask", "content"),
        ("stock", "capacity"): ("mask", "name"),
    }


def test_suggestions_can_be_applied(spark):
    frames = tables(spark)
    named = catalog.column_catalog(frames, discover.looks_personal)
    assert named.count() == 2
    got = discover.policy_suggestions(named, discover.profile_content(frames), 0.3)
    policy = discover.suggested_policy(got, "users", "s")
    assert {(r.column, r.strategy) for r in policy.rules} == {("Email", "hash"), ("comment", "mask")}
    assert {tuple(r) for r in discover.suggested_rules(got).where("source = 'stock'").collect()} == {("stock", "capacity", "mask", 4)}


def test_exact_profile_has_types_and_counts(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}, [1.0]), (1, None, {"k": 1}, None)], "a int, b string, c map<string,int>, d array<float>")
    rows = catalog.column_profile(df, exact=True).orderBy("ordinal").collect()
    assert [(r.data_type, r.nulls, r.distinct_values, r.max_length) for r in rows] == [
        ("int", 0, 1, None), ("string", 1, 1, 1), ("map<string,int>", 0, 1, None), ("array<float>", 1, 1, None),
    ]
    none = catalog.column_profile(df.limit(0), exact=True).collect()
    assert len(none) == 4 and {(r.nulls, r.distinct_values, r.max_length) for r in none} == {(0, 0, None)}
    about = catalog.column_profile(df).orderBy("ordinal").collect()
    assert [(r.family, r.nulls) for r in about][:2] == [("integer", 0), ("text", 1)]


def test_leak_check_finds_what_one_pass_leaves(spark):
    """A card next to a phone number: the cascade's one pass sees one long digit run first."""
    text = "4111111111111111 415-555-2671"
    policy = RedactPolicy(rules=(ColumnRule("key", "hash"),), patterns=ALL, salt="s")
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS key", f"'{text}' AS note", "'a@b.com' AS mail")
    report = discover.leak_check(redact(df, policy), policy, "t").collect()
    assert {(r.column_name, r.pattern) for r in report if r.leaked} == {("note", "card")}
    assert {r.column_name for r in report} == {"note", "mail"}  # tokens may look like phones


def test_join_integrity_reports_collisions(spark):
    left = spark.range(300).selectExpr("id % 100 AS key").unionAll(spark.range(1).selectExpr("CAST(NULL AS BIGINT)"))
    right = spark.range(100).selectExpr("id AS key")
    good = discover.hash_join_integrity(left, right, "key").first()
    assert (good.raw_keys, good.tokens, good.collisions) == (100, 100, 0)
    assert (good.raw_pairs, good.token_pairs, good.lost_pairs, good.extra_pairs) == (300, 300, 0, 0)
    short = discover.hash_join_integrity(left, right, "key", digits=1).first()
    assert short.tokens <= 16 and short.collisions > 0 and short.extra_pairs > 0 and short.lost_pairs == 0


def test_inventory_and_profile(spark):
    frames = tables(spark)
    rows = [tuple(r) for r in catalog.table_inventory({**frames, "pg_catalog.x": frames["users"]}).collect()]
    assert rows == [("stock", 2, 1), ("users", 3, 2)]
    exact = catalog.column_profile(frames["users"], exact=True).orderBy("ordinal").collect()
    exact = {r.column_name: r for r in exact}
    assert (exact["Email"].nulls, exact["Email"].distinct_values, exact["Email"].max_length) == (1, 1, 7)
    assert exact["uid"].max_length is None and exact["uid"].family == "integer"
    estimated = {r.column_name: r.distinct_values for r in catalog.column_profile(frames["users"]).collect()}
    assert estimated == {"uid": 2, "Email": 1, "comment": 2}
    assert catalog.split_name("a.b.c") == ("a", "b.c") and catalog.split_name("t") == ("public", "t")


def test_session_catalog(spark):
    tables(spark)["users"].createOrReplaceTempView("people_view")
    found = catalog.catalog_tables(spark)
    assert found["people_view"].columns == ["uid", "Email", "comment"]


def test_value_leaks(spark, monkeypatch):
    """Each planted value is found and nothing else: no part of one, no other order, no short one, none that is gone."""
    rows = [(k, f"Ann{k} de Vries", f"u{k}@x.org", "abc" if k else "k", 1.5) for k in range(30)] + [(99, None, None, None, None)]
    people = spark.createDataFrame(rows, "id int, name string, mail string, code string, rate double")
    policy = RedactPolicy(rules=(ColumnRule("name"), ColumnRule("mail", "hash"), ColumnRule("code", "null"), ColumnRule("rate", "partial")))
    texts = [("Ann3 de Vries was here", "Ann3, de Vries"), ("ask Ann4 de", "Vries de Ann5"), ("XAnn6 de Vries", "abc k 1.5"), ("(Ann7 de Vries)", "u8@x.org; Ann7 de Vries"), (None, ""), ("Ann3 de Vries Ann3 de Vries", "ann9 de vries")]
    notes = spark.createDataFrame(texts, "note string, other string")
    got = {(r.value_column, r.table_name, r.column_name): (r.texts, r.digest) for r in discover.value_leaks(people, policy, {"notes": notes, "none": spark.range(3)}, "s").collect()}
    digest = lambda v: __import__("hashlib").sha256(f"s{v}".encode()).hexdigest()
    found = discover.value_leaks(people, policy, {"notes": notes}, "s").collect()
    assert sorted((r.value_column, r.column_name, r.texts, r.digest) for r in found) == sorted(
        [("name", "note", 2, digest("Ann3 de Vries")), ("name", "other", 1, digest("Ann3 de Vries")), ("name", "note", 1, digest("Ann7 de Vries")),
         ("name", "other", 1, digest("Ann7 de Vries")), ("mail", "other", 1, digest("u8@x.org"))]
    )
    assert len(got) == 3 and discover.value_leaks(people.limit(0), policy, {"notes": notes}).count() == 0
    assert discover.value_leaks(people, RedactPolicy(), {"notes": notes}).count() == 0
    monkeypatch.setattr("lacuna.sources.bloom.MOST_LONGS", 1)  # a filter that says yes to nearly everything
    assert sorted(map(repr, discover.value_leaks(people, policy, {"notes": notes}, "s").collect())) == sorted(map(repr, found))


def test_no_row_holds_a_filter(spark):
    """The filters of the lookups are asked within a condition; as a column every row would hold a copy of them."""
    people = spark.createDataFrame([(k, f"Ann{k} de Vries") for k in range(30)], "id int, name string")
    notes = spark.createDataFrame([("Ann3 de Vries was here, Ann3 de Vries",), ("Ann3 de",), (None,), ("",)], "note string")
    leaks = discover.value_leaks(people, RedactPolicy(rules=(ColumnRule("name"),)), {"notes": notes})
    terms = spark.createDataFrame([("de Vries", "NAME"), ("was", "WORD"), ("!", "SIGN")], "term string, label string")
    replaced = detect._joined_terms(notes, "note", terms, "hits")
    assert [r.texts for r in leaks.collect()] == [1]
    assert {(r.note, r.hits) for r in replaced.collect()} == {("Ann3 <NAME> <WORD> here, Ann3 <NAME>", 3), ("Ann3 de", 0), (None, 0), ("", 0)}

    def schemas(plan):
        children = plan.children()
        return [plan.schema().json(), *(s for i in range(children.size()) for s in schemas(children.apply(i)))]

    for df in (leaks, replaced):
        assert not any('"elementType":"long"' in s for s in schemas(df._jdf.queryExecution().optimizedPlan()))


def test_profiles_merge(spark, tmp_path):
    """Two halves and a replaced part give the profile of the whole."""
    df = spark.range(40_000).selectExpr("id", "'t' || id % 9000 AS text", "CASE WHEN id % 3 = 0 THEN id * 0.5 END AS half", "array(id % 7) AS list", "CAST(id AS STRING) = '1' AS flag", "CAST(NULL AS STRING) AS never", "CAST('x' AS BINARY) AS raw")
    whole = {r.column_name: r for r in catalog.profile_of(catalog.profile_sketches(df, "t")).collect()}
    folder = str(tmp_path / "profile")
    catalog.keep_profile(catalog.profile_sketches(df.where("id < 5"), "t"), folder, "a")
    for part, rule in (("a", "id < 17000"), ("b", "id >= 17000")):
        catalog.keep_profile(catalog.profile_sketches(df.where(rule), "t"), folder, part)
    kept = {r.column_name: r for r in catalog.profile_of(catalog.kept_sketches(spark, folder)).collect()}
    assert kept == whole
    exact = {r.column_name: r for r in catalog.column_profile(df, exact=True).collect()}
    for name, r in kept.items():
        e = exact[name]
        assert (r.ordinal, r.family, r.nulls, r.max_length, r.n_rows) == (e.ordinal, e.family, e.nulls, e.max_length, 40_000)
        assert abs(r.distinct_values - e.distinct_values) <= 1 + 0.033 * e.distinct_values
    empty = catalog.profile_of(catalog.profile_sketches(df.limit(0), "t")).collect()
    assert all((r.n_rows, r.nulls, r.distinct_values) == (0, 0, 0) for r in empty) and len(empty) == 7
