from __future__ import annotations

import pytest

from lacuna.operators.screen import rule_columns, screen_by_source, screen_queries, screen_summary
from lacuna.plans.derived import QUERY_TEXTS
from lacuna.policy import ReadPolicy

POLICY = ReadPolicy(pii_tables=("contacts", "Users", "my table"))
# The expectation that decides, in the order of the rules.
RULE_OF = {"empty": "empty", "parse": "parse", "multi": "multi", "top": "top", "explain": "analyze", "writes": "write", "star": "star", None: None}

# (text, rule that blocks or None)
GOLDEN = [
    (text.replace("@@", "@"), RULE_OF[next((k for k in RULE_OF if k in expected), None)])
    for text, expected in QUERY_TEXTS
] + [
    ("VALUES (now())", None),
    ("SELECT price * 2 FROM parts", None),
    ("COPY parts TO STDOUT", "top"),
    ("SELECT count(*) FROM a UNION SELECT 1 FROM b ORDER BY 1", None),
]

# Texts that try to hide something, and harmless ones that look odd.
ADVERSARIAL = [
    (None, "empty"),
    (" ;; \n\t ", "empty"),
    ("; ;", "multi"),
    ("-- only a comment", "multi"),
    ("SELECT 1;", None),
    ("SELECT 1; -- done", None),
    ("SELECT '; DROP TABLE t'", None),
    ("SELECT 'it''s; fine' -- ; DROP TABLE t", None),
    ("SELECT 1 -- x\n; DROP TABLE t", "multi"),
    ("SELECT 1 -- x\r; DROP TABLE t", "multi"),
    ("SELECT 1 /* ' */ ; DROP TABLE t -- '", "multi"),
    ("SELECT 1 /* /* */ ' */ ; DROP TABLE t --'", "parse"),
    ("SELECT 1 /* a ** / b */", None),
    ("SELECT 1 /**/ , 2 /***/", None),
    ("SELECT 1 /* never closed", "parse"),
    ("SELECT 'never closed", "parse"),
    ("SELECT (1", "parse"),
    (r"SELECT E'a\'' ; DROP TABLE t --'", "parse"),
    (r"SELECT E'a''\'' ; DROP TABLE t --'", "parse"),
    (r"SELECT '\' , 1", None),
    ("SELECT $$ ; DROP TABLE t $$", None),
    ("SELECT $$word$$", None),
    ("SELECT $a$ x $b$ y $a$", None),
    ("SELECT $a$ x $b$ y $a$ ; DROP TABLE t; SELECT $c$ z $d$ w $c$", "multi"),
    ("SELECT $a$ x $b$", "parse"),
    ("SELECT a$$ ; DROP TABLE t $$", "parse"),
    ("SELECT x FROM t WHERE id = $1", None),
    ('SELECT * FROM U&"cont\\0061cts"', "parse"),
    ('SELECT "a" FROM t', None),
    ("(SELECT 1) UNION (SELECT 2)", None),
    ("VALUES (1), (2)", None),
    ("TABLE contacts", "star"),
    ("WITH c AS (TABLE contacts) SELECT 1 FROM c", "star"),
    ("select * from CONTACTS", "star"),
    ('SELECT * FROM public."Contacts"', "star"),
    ('SELECT * FROM "my table" x', "star"),
    ("SELECT c.* FROM app.contacts AS c", "star"),
    ("SELECT (c).* FROM contacts c", "star"),
    ("SELECT/**/*/**/FROM/**/contacts", "star"),
    ("SELECT a, * FROM m JOIN ONLY contacts ON true", "star"),
    ("SELECT m.x FROM m WHERE id IN (SELECT id FROM (SELECT * FROM users) u)", "star"),
    ("SELECT count(*) FROM contacts", None),
    ("SELECT 2 * 3 FROM contacts", None),
    ("WITH contacts AS (SELECT 1 AS x) SELECT * FROM contacts", "star"),
    ("WITH w AS (SELECT 1) DELETE FROM t", "write"),
    ("WITH w AS (INSERT INTO t VALUES (1) RETURNING id) SELECT id FROM w", "write"),
    ("EXPLAIN DELETE FROM t", "write"),
    ("EXPLAIN (COSTS off) UPDATE t SET x = 1", "write"),
    ("EXPLAIN CREATE TABLE t AS SELECT 1", "write"),
    ("EXPLAIN (COSTS, ANALYSE false) SELECT 1", "analyze"),
    ("EXPLAIN VERBOSE ANALYZE SELECT 1", "analyze"),
    ('EXPLAIN ("analyze") SELECT 1', "analyze"),
    ("SELECT 1 FOR NO KEY UPDATE", "write"),
    ("SELECT 1 FOR KEY SHARE", "write"),
    ("BEGIN", "top"),
    ("CREATE OR REPLACE FUNCTION f() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql", "top"),
    ("VACUUM", "top"),
    ("EXPLAIN(ANALYZE) SELECT 1", "analyze"),
    ("EXPLAIN(COSTS OFF) CREATE TABLE x AS SELECT 1", "write"),
    ("WITH RECURSIVE w(id) AS (SELECT 1) CYCLE id SET c USING p UPDATE t AS u SET x = 1", "write"),
    ("SELECT DISTINCT ON (lower(email), (id)) * FROM contacts", "star"),
    ("SELECT a FROM b WHERE", "parse"),
    ("SELECT a FROM (SELECT b FROM ) c", "parse"),
    ("SELECT a FROM b GROUP BY ORDER BY c", "parse"),
    ("WITH x SELECT 1", "parse"),
    ("TABLE", "parse"),
    ("SELECT 1 WHERE a IS DISTINCT FROM 'x'", None),
    ("WITH x AS MATERIALIZED (SELECT 1) SELECT a FROM x", None),
    ("SELECT extract(day FROM d) FROM t", None),
    ('"SELECT" 1', "parse"),
    ("SELECT '" + "x" * 300_000 + "''" * 50_000 + "'", None),
    ("SELECT 1 /*" + "* x" * 100_000 + "*/", None),
]


def screened(spark, cases, policy=POLICY):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, sql string")
    rows = {r.i: r for r in screen_queries(df, policy=policy).collect()}
    return [rows[i] for i in range(len(cases))]


@pytest.mark.parametrize("cases", [GOLDEN, ADVERSARIAL], ids=["golden", "adversarial"])
def test_verdicts(spark, cases):
    wrong = [
        (text and text[:80], rule, row.rule, row.reason)
        for (text, rule), row in zip(cases, screened(spark, cases))
        if row.rule != rule or row.allowed != (rule is None) or (row.reason is None) != (rule is None)
    ]
    assert not wrong


REASONS = {
    "DELETE FROM t": "only SELECT / SHOW / EXPLAIN are allowed (got DeleteStmt)",
    "CREATE TEMP TABLE t AS SELECT 1": "only SELECT / SHOW / EXPLAIN are allowed (got CreateTableAsStmt)",
    "CREATE OR REPLACE VIEW v AS SELECT 1": "only SELECT / SHOW / EXPLAIN are allowed (got ViewStmt)",
    "WITH w AS (DELETE FROM t RETURNING *), v AS (INSERT INTO t VALUES (1)) SELECT * INTO x FROM w FOR SHARE": (
        "write or DDL operation detected: DELETE, INSERT, SELECT INTO, row-locking clause (FOR UPDATE/SHARE)"
    ),
    "EXPLAIN CREATE TABLE t AS SELECT 1": "write or DDL operation detected: CREATETABLEAS",
    "SELECT * FROM users, contacts": (
        "SELECT * is not allowed on PII table(s): contacts, users. List the columns you need explicitly."
    ),
    "nonsense here": "could not parse SQL (unexpected NONSENSE)",
}


def test_reasons(spark):
    for (text, expected), row in zip(REASONS.items(), screened(spark, [(t, None) for t in REASONS])):
        assert row.reason == expected, text


def test_star_can_be_allowed(spark):
    (row,) = screened(spark, [("SELECT * FROM contacts", None)], ReadPolicy(True, ("contacts",)))
    assert row.allowed
    (row,) = screened(spark, [("SELECT * FROM contacts", None)], ReadPolicy())
    assert row.allowed


def test_summary_and_pushed_filter(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN], "sql string")
    totals = {r.rule: r.queries for r in screen_summary(screen_queries(df, policy=POLICY)).collect()}
    expected: dict[str | None, int] = {}
    for _, rule in GOLDEN:
        expected[rule] = expected.get(rule, 0) + 1
    assert totals == expected
    plan = screen_queries(df, policy=POLICY).where("rule = 'write'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("QUOTED__( |$)") <= 2  # the text is blanked once per copy of the expression


def test_rules_are_reported_independently(spark):
    df = spark.createDataFrame([("SELECT * FROM contacts; DELETE FROM t",)], "sql string")
    row = rule_columns(df, policy=POLICY).first()
    assert row.is_multi and row.star_pii == ["contacts"] and row.bad_top is None


def test_each_row_is_judged_by_its_source(spark):
    policies = spark.createDataFrame(
        [("a", ["Contacts"], False), ("b", ["contacts"], True), (None, ["my table"], False), ("a", ["users"], None)],
        "source string, pii_tables array<string>, allow_star boolean",
    )
    texts = ("SELECT * FROM contacts", "SELECT * FROM users", 'SELECT * FROM "my table" x')
    df = spark.createDataFrame([(d, t) for d in ("a", "b", "c", None) for t in texts], "database string, sql string")
    got = {(r.database, r.sql): r.rule for r in screen_by_source(df, policies).collect()}
    assert [got["a", t] for t in texts] == ["star", "star", None] and [got["b", t] for t in texts] == [None] * 3
    assert [got["c", t] for t in texts] == [got[None, t] for t in texts] == [None, None, "star"]


def test_ungrammatical_texts_and_literals(spark):
    """What no grammar accepts is told; a literal holds its place in a list, so lists of literals pass."""
    blocked = [
        "SELECT a b c d FROM t", "SELECT a,, b FROM t", "SELECT 1 +", "VALUES (1),", "SHOW a b c", "SELECT a FROM t LIMIT", "SELECT , a FROM t", "SELECT a, FROM t",
        "SELECT f(a,) FROM t", "SELECT f(,a) FROM t", "SELECT a FROM t ORDER BY a,", "SELECT a FROM t LIMIT OFFSET 3", "SELECT (a -) FROM t", "SELECT DISTINCT , a FROM t",
        "SELECT 'x', , 'y'", "SELECT a FROM t WHERE b =",
    ]
    passing = [
        "SELECT 'a', 'b' FROM t", "SELECT a FROM t WHERE b IN ('x', $$y$$, $q$z$q$) LIMIT '5'", "WITH w AS MATERIALIZED(SELECT 1) SELECT a FROM w",
        "WITH w AS NOT MATERIALIZED(SELECT 1) SELECT a FROM w", "SELECT a COLLATE c FROM t", "SELECT CAST(a AS double precision) b FROM t x", "SELECT a FROM t TABLESAMPLE BERNOULLI (10)",
        "SELECT a AT TIME ZONE 'utc' b FROM t", "SHOW TIME ZONE", "SHOW TRANSACTION ISOLATION LEVEL", "SHOW work_mem", "SELECT CAST(a AS timestamp without time zone) FROM t",
        "SELECT sum(a) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t", "SELECT a FROM t ORDER BY a DESC NULLS LAST LIMIT 5 OFFSET 2",
        "SELECT CASE WHEN a THEN b ELSE c END d FROM t", "SELECT 1 * -a FROM t", "SELECT a FROM t FETCH FIRST 5 ROWS WITH TIES", "SELECT 'x' * 2, 'y' FROM contacts", "SELECT interval '1 day' d FROM t",
        "SELECT trim(BOTH 'x' FROM a) FROM t", "SELECT a FROM b CROSS JOIN LATERAL f(a) x", "SELECT a IS NOT DISTINCT FROM b FROM t", "EXPLAIN (COSTS off, VERBOSE) SELECT a FROM t",
    ]
    cases = [(t, "parse") for t in blocked] + [(t, None) for t in passing]
    wrong = [(text, row.rule) for (text, rule), row in zip(cases, screened(spark, cases)) if row.rule != rule]
    assert not wrong


def test_literals_never_hide_what_follows(spark):
    cases = [
        ("SELECT 'a'; DELETE FROM t", "multi"), ("SELECT 'a', * FROM contacts", "star"), ("SELECT'a',* FROM contacts", "star"), ("SELECT 'a' INTO x FROM t", "write"),
        ("SELECT 'a' FROM t FOR UPDATE", "write"), ("SELECT $$a$$; DROP TABLE t", "multi"), ("SELECT '\x01'; DELETE FROM t; --\x02'", "multi"), ("SELECT 'a\x01", "parse"),
        ("/* c */ SELECT * /* d */ FROM -- e\n contacts", "star"), ("SELECT 'it''s', \"a\"\"b\".* FROM contacts", "star"),
    ]
    wrong = [(text, row.rule) for (text, rule), row in zip(cases, screened(spark, cases)) if row.rule is None]
    assert not wrong
