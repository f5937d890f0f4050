"""Tables derived from the driver's tables: one select list for Spark and for the SQL oracle.

``k`` is the base table's key.  Both engines evaluate the same text, so they
see equal data at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _select(columns: dict[str, str], base: str, key: str) -> str:
    listed = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return f"SELECT {listed} FROM (SELECT *, {key} AS k FROM {base}) base"


def _apply(df: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    return df.withColumn("k", F.col(key)).selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


# ------------------------------------------------------------------ contacts

_EMAIL = "'user' || k || '@mail' || (k % 9) || '.example.com'"
_PHONE = "'(' || (200 + k % 700) || ') 555-' || lpad(CAST(k % 10000 AS STRING), 4, '0')"
_SSN = "(100 + k % 800) || '-' || (10 + k % 90) || '-' || (1000 + k % 9000)"
_IP = "'10.' || (k % 256) || '.' || (k % 200) || '.' || (k % 100)"
_CONTACTS = {
    "contact_id": "k",
    "full_name": "c_name",
    "email": f"CASE WHEN k % 11 <> 0 THEN {_EMAIL} END",
    "phone": f"'+1 ' || {_PHONE}",
    "ssn": _SSN,
    "card": "CASE k % 3 WHEN 0 THEN '4111111111111111' WHEN 1 THEN '4111-1111-1111-1111' ELSE '1234567890123456' END",
    "ip": _IP,
    "note": f"""CASE k % 5 WHEN 0 THEN 'write to ' || {_EMAIL} || ' today'
        WHEN 1 THEN 'call ' || {_PHONE} || ' after 9'
        WHEN 2 THEN 'ssn ' || {_SSN} || ' on file'
        WHEN 3 THEN 'paid with 4111-1111-1111-1111 twice'
        ELSE 'seen at ' || {_IP} || ' by mary jones' END""",
    "nationkey": "c_nationkey",
    "source": "CASE WHEN k % 2 = 0 THEN 'staging' ELSE 'prod' END",
}
CONTACTS_SQL = _select(_CONTACTS, "customer", "c_custkey")


def contacts(customer: DataFrame) -> DataFrame:
    """People with every kind of personal data, one per customer."""
    return _apply(customer, _CONTACTS, "c_custkey")


_TICKETS = {
    "ticket_id": "k",
    "full_name": "c_name",
    "email": f"CASE WHEN k % 11 <> 0 THEN {_EMAIL} END",
    "note": f"""CASE k % 9 WHEN 0 THEN 'please call ' || c_name || ', today'
        WHEN 1 THEN 'please call ' || c_name || '7 today'
        WHEN 2 THEN 'write to ' || {_EMAIL}
        ELSE 'nothing to say' END""",
}
TICKETS_SQL = _select(_TICKETS, "customer", "c_custkey")


def tickets(customer: DataFrame) -> DataFrame:
    """Notes about people, every ninth of which names one."""
    return _apply(customer, _TICKETS, "c_custkey")


# ----------------------------------------------------------------- query_log

# One text per remainder of k and what screening must say of it, by construction; '@' stands for the key,
# '@@' for an at sign.  Left out are the outcomes of rules that find nothing.
QUERY_TEXTS: tuple[tuple[str, dict[str, str]], ...] = (
    ("SELECT o.total FROM orders o WHERE o.id = @", {}),
    ("SELECT nation, sum(total) FROM orders WHERE id < @ GROUP BY nation", {}),
    ("WITH big AS (SELECT * FROM parts WHERE size > @) SELECT max(size) FROM big", {}),
    ("SHOW timezone", {}),
    ("EXPLAIN SELECT price FROM parts WHERE id = @", {}),
    ("EXPLAIN ANALYSE SELECT price FROM parts WHERE id = @", {"explain": "yes"}),
    ("EXPLAIN(ANALYZE) SELECT @", {"explain": "yes"}),
    ("INSERT INTO carts VALUES (@, 'x')", {"top": "InsertStmt"}),
    ("UPDATE parts SET price = 0 WHERE id = @", {"top": "UpdateStmt"}),
    ("DELETE FROM carts WHERE id = @", {"top": "DeleteStmt"}),
    ("DROP VIEW v@", {"top": "DropStmt"}),
    ("TRUNCATE TABLE carts@", {"top": "TruncateStmt"}),
    ("ALTER TABLE carts DROP COLUMN c@", {"top": "AlterTableStmt"}),
    ("CREATE TABLE copy@ AS SELECT 1 AS one", {"top": "CreateTableAsStmt"}),
    ("REVOKE SELECT ON parts FROM role@", {"top": "GrantStmt"}),
    ("WITH gone AS (DELETE FROM carts WHERE id = @ RETURNING id) SELECT count(*) FROM gone", {"writes": "DELETE"}),
    ("SELECT @; DELETE FROM carts", {"multi": "yes", "writes": "DELETE"}),
    ("SELECT id INTO TEMP kept FROM parts WHERE id = @", {"writes": "SELECT INTO"}),
    ("SELECT price FROM parts WHERE id = @ FOR SHARE", {"writes": "row-locking clause (FOR UPDATE/SHARE)"}),
    ("SELECT * FROM contacts WHERE contact_id = @", {"star": "contacts"}),
    ("SELECT * FROM parts WHERE id = @", {}),
    ("please list all orders of @", {"parse": "unexpected PLEASE"}),
    (" ;; ", {"empty": "yes"}),
    ("SELECT full_name FROM users WHERE note = 'x@@y.org' /* ; DROP TABLE users */ -- @", {}),
    ("EXPLAIN (COSTS, ANALYZE off) SELECT u.* FROM app.\"Users\" u WHERE id = @", {"explain": "yes", "star": "users"}),
    ("EXPLAIN(COSTS OFF) CREATE TABLE t@ AS SELECT 1", {"writes": "CREATETABLEAS"}),
    ("WITH RECURSIVE w(id) AS (SELECT @) SEARCH DEPTH FIRST BY id SET o DELETE FROM carts", {"writes": "DELETE"}),
    ("SELECT DISTINCT ON (lower(email)) * FROM contacts WHERE contact_id > @", {"star": "contacts"}),
    ("SELECT id FROM", {"parse": "incomplete statement"}),
    ("SELECT FROM WHERE id = @", {"parse": "incomplete statement"}),
    ("WITH w@", {"parse": "incomplete statement"}),
    ("SHOW", {"parse": "incomplete statement"}),
    ("EXPLAIN", {"parse": "incomplete statement"}),
    ("SELECT a b c d FROM t@", {"parse": "incomplete statement"}),
    ("SELECT a,, b FROM t WHERE id = @", {"parse": "incomplete statement"}),
    ("SELECT @ +", {"parse": "incomplete statement"}),
    ("VALUES (@),", {"parse": "incomplete statement"}),
    ("SHOW a b c", {"parse": "incomplete statement"}),
    ("SELECT a FROM t@ LIMIT", {"parse": "incomplete statement"}),
    ("WITH w AS MATERIALIZED(SELECT @ AS id) SELECT id FROM w", {}),
    ("SELECT 'a', 'b' FROM parts WHERE kind IN ('x', 'y', '@') LIMIT '5'", {}),
    ("SELECT price * 2, 'x' * 2 FROM contacts WHERE contact_id = @", {}),
)


def _fill(text: str) -> str:
    parts = [p.replace("\0", "@").replace("'", "''") for p in text.replace("@@", "@\0").split("@")]
    return " || k || ".join(f"'{p}'" for p in parts)


_TEXTS = " ".join(f"WHEN {i} THEN {_fill(t)}" for i, (t, _) in enumerate(QUERY_TEXTS))
_QUERY_LOG = {
    "query_id": "k",
    "ts": "ts",
    "database": "CASE WHEN k % 3 = 0 THEN 'prod' ELSE 'staging' END",
    "sql": f"CASE k % {len(QUERY_TEXTS)} {_TEXTS} END",
}
QUERY_LOG_SQL = _select(_QUERY_LOG, "events", "event_id")


def query_log(events: DataFrame) -> DataFrame:
    """An agent's query log, one text per event."""
    return _apply(events, _QUERY_LOG, "event_id")


# -------------------------------------------------------------------- shapes

# Fragments of query texts with what each does to the verdict.  A text is one of each, chosen by the digits of k.
SHAPES: tuple[tuple[tuple[str, str], ...], ...] = (
    (("", ""), ("EXPLAIN ", ""), ("EXPLAIN ANALYZE ", "analyze"), ("/* drop; */ ", ""), ("-- it''s\n  ", ""), ("WITH w AS (SELECT 1) ", "")),
    (("SELECT id, total", ""), ("select\t*", "star"), ("SELECT count(*)", ""), ("SELECT DISTINCT a.*", "star"), ("SELECT 'x;y' AS q, a.id", "")),
    (("FROM orders a", ""), ("FROM app.contacts a", "contacts"), ('FROM orders o JOIN "Users" a ON a.id = o.id', "users"), ("FROM (SELECT id FROM parts) a", "")),
    (
        ("", ""), ("WHERE id = @", ""), ("WHERE note = 'DELETE FROM t'", ""), ("WHERE id IN (SELECT id FROM parts)", ""),
        ("WHERE id IN (DELETE FROM parts RETURNING id)", "DELETE"),
    ),
    (
        ("", ""), ("ORDER BY id LIMIT 5", ""), ("FOR UPDATE", "lock"), (" ; ", ""), ("; SELECT @", "multi"), ("LIMIT", "incomplete"),
        ("ORDER BY id,", "incomplete"), ("LIMIT @ OFFSET", "incomplete"),
    ),
)


def _digit(place: int) -> str:
    """Which fragment of a list the text of k has."""
    below = 1
    for fragments in SHAPES[:place]:
        below *= len(fragments)
    return f"CAST(floor(k / {below}) AS BIGINT) % {len(SHAPES[place])}"


def _pick(place: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {_fill(text.replace(chr(39) * 2, chr(39)))}" for i, (text, _) in enumerate(SHAPES[place]))
    return f"CASE {_digit(place)} {cases} END"


def shape_effect(place: int) -> str:
    """What the fragment at this place does, as SQL over k."""
    return f"CASE {_digit(place)} " + " ".join(f"WHEN {i} THEN '{effect}'" for i, (_, effect) in enumerate(SHAPES[place])) + " END"


_SHAPED = {
    "query_id": "k",
    "database": "CASE WHEN k % 3 = 0 THEN 'prod' ELSE 'staging' END",
    "sql": f"{_pick(0)} || {_pick(1)} || ' ' || {_pick(2)} || ' ' || {_pick(3)} || ' ' || {_pick(4)}",
}
SHAPED_SQL = _select(_SHAPED | {"k": "k"}, "events", "event_id")


def shaped_log(events: DataFrame) -> DataFrame:
    """A query log of thousands of shapes."""
    return _apply(events, _SHAPED, "event_id")


# ------------------------------------------------------------------ outcomes

_OUTCOMES = {
    "query_id": "query_id",
    "ts": "ts",
    "database": "database",
    "sql": "'  ' || sql || CASE WHEN k % 50 = 7 THEN repeat(' -- padding', 300) ELSE '' END || '  '",
    "reason": """CASE WHEN k % 5 = 0 THEN 'write or DDL operation detected: DELETE'
        WHEN k % 7 = 0 THEN 'empty query'
        WHEN k % 19 = 0 THEN 'only a single statement is allowed per call' END""",
    "error": """CASE WHEN k % 13 = 0 THEN ''
        WHEN k % 11 = 0 THEN 'no row for user' || k || '@mail.example.com' END""",
    "rows": "k % 1200",
    "redactions": "k % 17",
    "truncated": "k % 1200 >= 1000",
    "duration_ms": "(k % 5000) / 16e0 + 0.01e0",
}
OUTCOMES_SQL = _select(_OUTCOMES, f"({QUERY_LOG_SQL}) q", "query_id")


def outcomes(events: DataFrame) -> DataFrame:
    """What became of each query of the log."""
    return _apply(query_log(events), _OUTCOMES, "query_id")


# ------------------------------------------------------- deliveries, versions

# Entries arrive in deliveries of eight days of the log; every 17th comes one delivery late.
DELIVERY = "CAST(floor((unix_ts - 1704067200) / 691200) AS INT)"
LATE_DELIVERY = f"{DELIVERY} + CASE WHEN query_id % 17 = 0 THEN 1 ELSE 0 END"


def delivered(entries: DataFrame, late: bool = False) -> DataFrame:
    """Entries with ``ts`` as a timestamp and the number of the delivery that they arrive in."""
    timed = entries.withColumn("unix_ts", F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss"))
    numbered = timed.withColumn("delivery", F.expr(LATE_DELIVERY if late else DELIVERY)).drop("unix_ts")
    return numbered.withColumn("ts", F.col("ts").cast("timestamp"))


# A query's outcome comes some minutes behind it; every 11th query has none, every 23rd two.
_REPLIES = {
    "query_id": "k",
    "ts": "ts + (k % 16) * INTERVAL '1' MINUTE",
    "status": "CASE WHEN k % 5 = 0 THEN 'blocked' ELSE 'allowed' END",
}
_SECOND_REPLIES = _REPLIES | {"ts": "ts + (k % 16 + 1) * INTERVAL '1' MINUTE", "status": "'again'"}
REPLIES_SQL = (
    f"{_select(_REPLIES, 'events', 'event_id')} WHERE k % 11 <> 0 "
    f"UNION ALL {_select(_SECOND_REPLIES, 'events', 'event_id')} WHERE k % 23 = 0"
)


def replies(events: DataFrame) -> DataFrame:
    """Outcomes as they come in, each with its own time."""
    first = _apply(events.where("event_id % 11 <> 0"), _REPLIES, "event_id")
    return first.unionAll(_apply(events.where("event_id % 23 = 0"), _SECOND_REPLIES, "event_id"))


# One version of a source's reading policy for every 97th event; a NULL source is the shared policy.
_VERSIONS = {
    "source": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'prod' WHEN 2 THEN 'prod' ELSE 'staging' END",
    "since": "ts",
    "tables": "CASE k % 3 WHEN 0 THEN 'Contacts' WHEN 1 THEN 'users,contacts' ELSE 'users' END",
    "allow_star": "k % 4 = 0",
}
VERSIONS_SQL = f"{_select(_VERSIONS, 'events', 'event_id')} WHERE k % 97 = 0"


def policy_versions(events: DataFrame) -> DataFrame:
    """Reading policies as they changed over time: source, since, pii_tables, allow_star."""
    rows = _apply(events.where("event_id % 97 = 0"), _VERSIONS, "event_id")
    return rows.select("source", "since", F.split("tables", ",").alias("pii_tables"), "allow_star")
