"""The same results in plain SQL for another engine (DuckDB): name -> query text.

Written from the specification, not from the Spark plans.  Two devices bridge
the regex dialects: every letter is wrapped in Q..Q while the number patterns
run, so that an ASCII word boundary sees accented letters too, and the phone's
look-around becomes a captured neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence

from lacuna.operators.audit import MASK_NOTE
from lacuna.plans import derived
from lacuna.plans.queries import CONTACT_POLICY, PII_TABLES, SALT, TERMS, TEXT_TABLES

ORDER = ("email", "ssn", "card", "phone", "ip")

# The patterns in this engine's dialect.
RE_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RE_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
RE_CARD = r"\b(?:\d[ -]?){13,19}\b"
RE_PHONE = r"(^|[^0-9])(?:\+?\d{1,2}[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}($|[^0-9])"
RE_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def luhn(x: str) -> str:
    digits = f"string_split(reverse(regexp_replace({x}, '[^0-9]', '', 'g')), '')"
    doubled = "(2 * CAST(c AS INT)) % 10 + (2 * CAST(c AS INT)) // 10"
    each = f"list_transform({digits}, lambda c, i: CASE WHEN i % 2 = 0 THEN {doubled} ELSE CAST(c AS INT) END)"
    return f"(list_sum({each}) % 10 = 0)"


def _wrap(c: str) -> str:
    return rf"regexp_replace({c}, '(\p{{L}})', 'Q' || chr(1) || '\1' || chr(1) || 'Q', 'g')"


def _unwrap(c: str) -> str:
    return f"replace(replace({c}, 'Q' || chr(1), ''), chr(1) || 'Q', '')"


def _replaced(p: str, c: str) -> str:
    if p == "email":
        return f"regexp_replace({c}, '{RE_EMAIL}', '[email]', 'g')"
    if p == "ssn":
        return f"regexp_replace({c}, '{RE_SSN}', '[ssn]', 'g')"
    if p == "phone":
        return rf"regexp_replace({c}, '{RE_PHONE}', '\1[phone]\2', 'g')"
    if p == "ip":
        return f"regexp_replace({c}, '{RE_IP}', '[ip]', 'g')"
    found = f"regexp_extract_all({c}, '{RE_CARD}')"
    one = f"CASE WHEN {luhn(f'{found}[i]')} THEN '[card]' ELSE {found}[i] END"
    gaps = f"string_split_regex({c}, '{RE_CARD}')"
    parts = f"list_transform({gaps}, lambda g, i: g || CASE WHEN i <= len({found}) THEN {one} ELSE '' END)"
    return f"CASE WHEN regexp_matches({c}, '{RE_CARD}') THEN array_to_string({parts}, '') ELSE {c} END"


def _counted(p: str, c: str) -> str:
    if p == "card":
        n = f"len(list_filter(regexp_extract_all({c}, '{RE_CARD}'), lambda m: {luhn('m')}))"
    else:
        regex = {"email": RE_EMAIL, "ssn": RE_SSN, "phone": RE_PHONE, "ip": RE_IP}[p]
        n = f"len(regexp_extract_all({c}, '{regex}'))"
    return f"CAST(coalesce({n}, 0) AS BIGINT)"


def cascade(source: str, columns: Sequence[str], enabled: Sequence[str] = ORDER) -> str:
    """``source`` with scrubbed ``columns`` and a BIGINT ``n_<column>_<pattern>`` per pattern."""
    sql = f"SELECT * FROM ({source}) s"
    wrapped = False
    for p in (p for p in ORDER if p in enabled):
        if p != "email" and not wrapped:
            sql = f"SELECT * REPLACE ({', '.join(f'{_wrap(c)} AS {c}' for c in columns)}) FROM ({sql}) w"
            wrapped = True
        swap = ", ".join(f"{_replaced(p, c)} AS {c}" for c in columns)
        count = ", ".join(f"{_counted(p, c)} AS n_{c}_{p}" for c in columns)
        sql = f"SELECT * REPLACE ({swap}), {count} FROM ({sql}) p_{p}"
    if wrapped:
        sql = f"SELECT * REPLACE ({', '.join(f'{_unwrap(c)} AS {c}' for c in columns)}) FROM ({sql}) u"
    return sql


def total(columns: Sequence[str], patterns: Sequence[str] = ORDER) -> str:
    return " + ".join(f"n_{c}_{p}" for c in columns for p in patterns)


def token(c: str, salt: str = SALT, digits: int = 12) -> str:
    return f"'sha256:' || substr(sha256('{salt}' || CAST({c} AS VARCHAR)), 1, {digits})"


def partial(c: str, keep: int) -> str:
    t = f"CAST({c} AS VARCHAR)"
    keep = max(keep, 0)
    shown = f"right({t}, {keep})" if keep else "''"
    return (
        f"CASE WHEN length({t}) <= {keep} THEN repeat('*', length({t})) "
        f"ELSE repeat('*', length({t}) - {keep}) || {shown} END"
    )


CONTACTS = derived.CONTACTS_SQL
LOG = derived.QUERY_LOG_SQL
OUTCOMES = derived.OUTCOMES_SQL
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"

# Contacts by the shared contact policy: rules, then the patterns on what is still text.
_RULED = f"""SELECT contact_id, CASE WHEN full_name IS NOT NULL THEN '[redacted]' END AS full_name,
  {token('email')} AS email, phone, {partial('ssn', 4)} AS ssn, CAST(NULL AS VARCHAR) AS card, ip, note,
  nationkey, source, CAST(email IS NOT NULL AS BIGINT) + 3 AS n_rules FROM ({CONTACTS}) c"""
_SCANNED = ("phone", "ssn", "ip", "note", "source")
FULL = cascade(_RULED, _SCANNED)
CONTACT_COLUMNS = "contact_id, full_name, email, phone, ssn, card, ip, note, nationkey, source"

ORACLES: dict[str, str] = {}

# ---------------------------------------------------- scans, sources, sinks

ORACLES["bounded_read"] = (
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000"
)
ORACLES["bounded_read_flag"] = (
    "SELECT CAST(least(count(*), 1000) AS BIGINT) AS row_count, count(*) > 1000 AS truncated FROM orders"
)


def iso_json(c: str) -> str:
    return f"regexp_replace({ISO.format(c)}, '\\.000000$', '')"


ORACLES["wire_values"] = f"""SELECT CAST(to_json(struct_pack(
  event_id := event_id, ts := {iso_json('ts')}, event_type := event_type, value := value,
  price := CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE), day := strftime(ts, '%Y-%m-%d'),
  raw := '<' || octet_length(encode(props)) || ' bytes>', times := [{iso_json('ts')}, NULL],
  who := struct_pack(user_id := user_id, day := strftime(ts, '%Y-%m-%d')),
  seen := MAP {{event_type: {iso_json('ts')}}},
  maybe := CASE WHEN event_id % 3 = 0 THEN props END)) AS VARCHAR) AS json FROM events"""

NOTE = MASK_NOTE
_PAYLOAD_ROWS = cascade(
    f"""SELECT contact_id, full_name, email, ssn, note, n_rules FROM (
      SELECT contact_id, '[redacted]' AS full_name, {token('email')} AS email, {partial('ssn', 4)} AS ssn, note,
        CAST(email IS NOT NULL AS BIGINT) + 2 AS n_rules
      FROM ({CONTACTS}) c ORDER BY contact_id LIMIT 200) b""",
    ("ssn", "note"),
)
ORACLES["outcome_payload"] = f"""SELECT CAST(to_json(struct_pack(status := 'ok', database := 'prod',
    columns := ['contact_id', 'full_name', 'email', 'ssn', 'note'],
    row_count := count(*), truncated := (SELECT count(*) > 200 FROM customer),
    redactions := CAST(sum(n_rules + {total(('ssn', 'note'))}) AS BIGINT), note := '{NOTE}')) AS VARCHAR) AS payload
  FROM ({_PAYLOAD_ROWS}) r"""
ORACLES["outcome_rows"] = f"""SELECT CAST(to_json(struct_pack(contact_id := contact_id, full_name := full_name,
    email := email, ssn := ssn, note := note)) AS VARCHAR) AS json FROM ({_PAYLOAD_ROWS}) r"""


def _governed_rows(database: str, limit: int) -> str:
    kept = cascade(
        f"""SELECT {token('email')} AS email, note, CAST(email IS NOT NULL AS BIGINT) AS n_rules
            FROM (SELECT * FROM ({CONTACTS}) c ORDER BY contact_id LIMIT {limit}) b""",
        ("note",),
    )
    none = "CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS redactions, false AS truncated"
    star = "SELECT * is not allowed on PII table(s): contacts. List the columns you need explicitly."
    return f"""SELECT '{database}' AS database, 'allowed' AS status,
      'SELECT contact_id, email, note FROM contacts ORDER BY contact_id' AS sql, CAST(NULL AS VARCHAR) AS reason,
      CAST(NULL AS VARCHAR) AS error, count(*) AS rows, CAST(sum(n_rules + {total(('note',))}) AS BIGINT) AS redactions,
      (SELECT count(*) > {limit} FROM customer) AS truncated FROM ({kept}) k
    UNION ALL SELECT '{database}', 'blocked', 'SELECT * FROM contacts', '{star}', NULL, {none}
    UNION ALL SELECT '{database}', 'error', 'SELECT contact_id, no_such_column FROM contacts', NULL,
      'UNRESOLVED_COLUMN.WITH_SUGGESTION', {none}
    UNION ALL SELECT '{database}', 'error', 'SELECT id FROM visits', NULL, 'unknown table visits', {none}"""


ORACLES["governed_audit"] = " UNION ALL ".join(_governed_rows(d, n) for d, n in (("prod", 40), ("staging", 120)))
_SHAPE = (
    "status := 'ok', database := database, row_count := rows, truncated := truncated, redactions := redactions"
)
ORACLES["outcome_status_payloads"] = f"""SELECT query_id, CAST(CASE
    WHEN reason IS NOT NULL THEN to_json(struct_pack(status := 'blocked', database := database, reason := reason))
    WHEN error IS NOT NULL THEN to_json(struct_pack(status := 'error', database := database, error := error))
    WHEN redactions > 0 THEN to_json(struct_pack({_SHAPE}, note := '{NOTE}'))
    ELSE to_json(struct_pack({_SHAPE})) END AS VARCHAR) AS payload FROM ({OUTCOMES}) o"""

_STATUS = "CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN error IS NOT NULL THEN 'error' ELSE 'allowed' END"
AUDIT = f"""SELECT query_id, ts, database, {_STATUS} AS status, substr(trim(sql), 1, 2000) AS sql, reason, error,
  rows, redactions, truncated, round_even(duration_ms, 1) AS duration_ms
  FROM ({cascade(OUTCOMES, ('sql', 'error'), ('email', 'ssn', 'card', 'phone'))}) a"""
AUDIT_ISO = f"SELECT * REPLACE ({ISO.format('ts')} AS ts) FROM ({AUDIT}) i"
ORACLES["audit_roundtrip"] = AUDIT_ISO
ORACLES["audit_parse"] = f"""SELECT query_id, ts, status, duration_ms FROM ({AUDIT_ISO}) a WHERE query_id % 17 <> 0
  UNION ALL SELECT event_id, NULL, 'odd', NULL FROM events WHERE event_id % 51 = 0"""

# Table -> columns with their type family, as in the data description.
SCHEMAS: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "integer", "r_name": "text"},
    "nation": {"n_nationkey": "integer", "n_name": "text", "n_regionkey": "integer"},
    "customer": {
        "c_custkey": "integer",
        "c_name": "text",
        "c_nationkey": "integer",
        "c_acctbal": "number",
        "c_mktsegment": "text",
    },
    "supplier": {"s_suppkey": "integer", "s_name": "text", "s_nationkey": "integer", "s_acctbal": "number"},
    "part": {
        "p_partkey": "integer",
        "p_name": "text",
        "p_brand": "text",
        "p_type": "text",
        "p_size": "integer",
        "p_retailprice": "number",
    },
    "orders": {
        "o_orderkey": "integer",
        "o_custkey": "integer",
        "o_orderstatus": "text",
        "o_totalprice": "number",
        "o_orderdate": "timestamp",
        "o_orderpriority": "text",
    },
    "lineitem": {
        "l_orderkey": "integer",
        "l_partkey": "integer",
        "l_suppkey": "integer",
        "l_linenumber": "integer",
        "l_quantity": "number",
        "l_extendedprice": "number",
        "l_discount": "number",
        "l_tax": "number",
        "l_returnflag": "text",
        "l_linestatus": "text",
        "l_shipdate": "timestamp",
    },
    "events": {
        "event_id": "integer",
        "ts": "timestamp",
        "user_id": "integer",
        "event_type": "text",
        "value": "number",
        "props": "text",
    },
    "documents": {"doc_id": "integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"},
    "embeddings": {"vec_id": "integer", "embedding": "array", "label": "integer"},
    "pages": {"page_id": "integer", "url": "text", "html": "text"},
    "benchmark": {"item_id": "integer", "text": "text"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "text", "text": "text"},
}
CONTACT_SCHEMA = dict.fromkeys(
    ("contact_id", "full_name", "email", "phone", "ssn", "card", "ip", "note", "nationkey", "source"), ""
)

ORACLES["table_inventory"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({len(cols)} AS BIGINT) AS n_columns, count(*) AS n_rows FROM {t}"
    for t, cols in SCHEMAS.items()
)


# The names of this engine's types in the other's schema text.
_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz",
    "FLOAT[]": "array<float>",
}


def _profile(t: str, i: int, c: str, family: str) -> str:
    longest = f"CAST(max(length({c})) AS BIGINT)" if family == "text" else "CAST(NULL AS BIGINT)"
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())
    kind = f"(SELECT CASE column_type {names} END FROM (DESCRIBE {t}) WHERE column_name = '{c}')"
    return (
        f"SELECT '{t}' AS table_name, CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, '{family}' AS family, "
        f"{kind} AS data_type, true AS nullable, "
        f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, {longest} AS max_length FROM {t}"
    )


ORACLES["column_profile"] = " UNION ALL ".join(
    _profile(t, i, c, family) for t, cols in SCHEMAS.items() for i, (c, family) in enumerate(cols.items(), 1)
)
ORACLES["profile_incremental"] = f"""SELECT table_name, ordinal, column_name, nulls, max_length, true AS distinct_ok
  FROM ({ORACLES['column_profile']}) p"""

# ------------------------------------------------------------- column rules

ORACLES["redact_mask"] = f"""SELECT contact_id, '[redacted]' AS full_name,
  CASE WHEN email IS NOT NULL THEN '[redacted]' END AS email FROM ({CONTACTS}) c"""
ORACLES["redact_null"] = f"""SELECT contact_id, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS INTEGER) AS nationkey
  FROM ({CONTACTS}) c"""
ORACLES["redact_hash"] = f"SELECT contact_id, {token('email', '')} AS email FROM ({CONTACTS}) c"
ORACLES["redact_hash_salted"] = f"""SELECT o_orderkey, {token('o_custkey', SALT, 16)} AS c_key,
  {token('CAST(o_orderdate AS DATE)', SALT, 16)} AS day FROM orders"""
ORACLES["redact_partial"] = f"""SELECT contact_id, {partial('ssn', 4)} AS ssn, {partial('phone', 7)} AS phone,
  {partial('contact_id', 2)} AS number FROM ({CONTACTS}) c"""
ORACLES["redact_partial_short"] = f"""SELECT contact_id, {partial('ssn', 0)} AS "none", {partial('ssn', -3)} AS negative,
  {partial('ssn', 11)} AS exact, {partial('ssn', 40)} AS long, {partial('ssn', 1)} AS one FROM ({CONTACTS}) c"""
ORACLES["redact_rules_resolve"] = f"""SELECT contact_id, {partial('email', 3)} AS mail, '[redacted]' AS number,
  phone, note FROM ({CONTACTS}) c"""
ORACLES["redact_column_counts"] = " UNION ALL ".join(
    f"SELECT '{r.column}' AS \"column\", '{r.strategy}' AS strategy, count({r.column}) AS cells FROM ({CONTACTS}) c"
    for r in CONTACT_POLICY.rules
)

# ------------------------------------------------------------ text patterns

_MIXED = f"""SELECT 'documents' AS origin, doc_id AS id, text AS t FROM documents UNION ALL
  SELECT 'contacts', contact_id, concat_ws(' | ', note, ssn, card, ip) FROM ({CONTACTS}) c"""
for _p in ORDER:
    ORACLES[f"pattern_{_p}"] = f"""SELECT origin, id, t AS scrubbed, n_t_{_p} AS hits
  FROM ({cascade(_MIXED, ('t',), (_p,))}) x"""

ORACLES["luhn_filter"] = f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, m[i] AS candidate, {luhn('m[i]')} AS valid
  FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all({_wrap('text')}, '{RE_CARD}') AS m FROM documents) a) b"""

_DOCS = cascade("SELECT doc_id, lang, source, text FROM documents", ("text",))
ORACLES["pattern_cascade"] = f"SELECT doc_id, text FROM ({_DOCS}) d"
_DEFAULT = ("email", "ssn", "card", "phone")
ORACLES["pattern_toggles"] = f"""SELECT doc_id, md5(text) AS text_md5, {total(('text',), _DEFAULT)} AS hits
  FROM ({cascade('SELECT doc_id, text FROM documents', ('text',), _DEFAULT)}) d"""


def _sums(column: str) -> str:
    each = ", ".join(f"CAST(sum(n_{column}_{p}) AS BIGINT) AS {p}_hits" for p in ORDER)
    return f"{each}, CAST(sum({total((column,))}) AS BIGINT) AS hits"


ORACLES["pattern_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {_sums(c)} FROM ({cascade(f'SELECT {c} FROM {t}', (c,))}) x"
    for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text"))
)
ORACLES["pattern_counts_by_lang"] = f"SELECT lang, {_sums('text')} FROM ({_DOCS}) d GROUP BY lang"

_TAKEN = " + ".join(f"{len(p) + 2} * n_text_{p}" for p in ORDER)
ORACLES["pii_findings"] = f"""SELECT d.doc_id, {total(('text',))} AS hits,
  CAST(length(raw.text) - length(d.text) + {_TAKEN} AS BIGINT) AS covered, d.text
  FROM ({_DOCS}) d JOIN documents raw ON raw.doc_id = d.doc_id"""

# ------------------------------------------------------------ full redactor

ORACLES["redact_full"] = f"SELECT {CONTACT_COLUMNS}, n_rules + {total(_SCANNED)} AS redactions FROM ({FULL}) f"
_KINDS = ", ".join(
    f"CAST(sum({total(_SCANNED, (p,))}) AS BIGINT) AS {p}" for p in ORDER
)
ORACLES["redact_full_counts"] = f"""SELECT CAST(sum(n_rules) AS BIGINT) AS column_rules, {_KINDS},
  CAST(0 AS BIGINT) AS free_text, CAST(sum(n_rules + {total(_SCANNED)}) AS BIGINT) AS redactions, count(*) AS rows
  FROM ({FULL}) f"""
_RESCAN = cascade(f"SELECT contact_id, {token('email')} AS email, note FROM ({CONTACTS}) c", ("email", "note"))
ORACLES["redact_rescan_hashed"] = f"SELECT contact_id, email, note FROM ({_RESCAN}) f"
_PARTS = ("note", "ip", "phone", "card", "email")
_NESTED = cascade(f"SELECT contact_id, {', '.join(_PARTS)} FROM ({CONTACTS}) c", _PARTS)
ORACLES["redact_nested"] = f"""SELECT contact_id, note || ' | ' || ip AS items, phone, card, email AS mail,
  {total(_PARTS)} AS redactions FROM ({_NESTED}) n"""
_VARIANT_PARTS = ("note", "ip", "card", "email")


def _variant(source: str) -> str:
    inner = r"""'{"ip":' || to_json(ip) || ',"list":[' || to_json(note) || ',"a \"quoted\" é\n"],"map":{"1.2.3.4":' || to_json(card) || '}}'"""
    return f"""SELECT *, CASE WHEN contact_id % 7 <> 3 THEN '{{"deep":[' || {inner} || ',' || {inner} || '],'
      || CASE WHEN email IS NULL THEN '' ELSE '"email":' || to_json(email) || ',' END || '"n":' || contact_id || '}}' END AS v FROM ({source}) s"""


_VARIANTS = cascade(f"SELECT contact_id, {', '.join(_VARIANT_PARTS)} FROM ({CONTACTS}) c", _VARIANT_PARTS)
ORACLES["redact_variant"] = f"""SELECT contact_id, v, CASE WHEN v IS NULL THEN 0
    ELSE 2 * ({total(('note', 'ip', 'card'))}) + {total(('email',))} END AS redactions FROM ({_variant(_VARIANTS)}) x"""
ORACLES["wire_variant"] = f"""SELECT '{{"contact_id":' || contact_id || ',"v":' || coalesce(v, 'null') || '}}' AS json
  FROM ({_variant(f'SELECT * FROM ({CONTACTS}) c')}) x"""
ORACLES["redact_stream"] = f"SELECT {CONTACT_COLUMNS} FROM ({FULL}) f"
ORACLES["redact_stream_counts"] = ORACLES["redact_full_counts"]

# -------------------------------------------------------- free-text backstops

_NOTES = cascade(f"SELECT contact_id, note FROM ({CONTACTS}) c", ("note",))


def _dictionary(c: str) -> tuple[str, str]:
    """One pass with all terms, longest first; each match is marked, then labelled."""
    ordered = sorted(TERMS, key=lambda t: (-len(t), t))
    regex = rf"\b({'|'.join(ordered)})\b"
    text = rf"regexp_replace({c}, '{regex}', chr(2) || '\1' || chr(3), 'g')"
    for t in ordered:
        text = f"replace({text}, chr(2) || '{t}' || chr(3), '<{TERMS[t]}>')"
    return text, f"CAST(len(regexp_extract_all({c}, '{regex}')) AS BIGINT)"


_text, _n = _dictionary("note")
ORACLES["dictionary_backstop"] = f"""SELECT contact_id, {_text} AS note, {total(('note',))} + {_n} AS redactions
  FROM ({_NOTES}) n"""
_WORDS = r"""SELECT DISTINCT term FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark) w WHERE length(term) >= 10
  UNION SELECT regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1) FROM benchmark
    WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+')"""
_ANY = rf"(SELECT '\b(?:' || string_agg(term, '|' ORDER BY length(term) DESC, term) || ')\b' FROM ({_WORDS}) t)"
ORACLES["dictionary_table"] = f"""SELECT doc_id, {_unwrap('text')} AS text, hits FROM (
  SELECT doc_id, regexp_replace(w, p, '<TERM>', 'g') AS text, CAST(len(regexp_extract_all(w, p)) AS BIGINT) AS hits
  FROM (SELECT doc_id, {_ANY} AS p,
    regexp_replace(text, '([^\\x00-\\x7F])', 'Q' || chr(1) || '\\1' || chr(1) || 'Q', 'g') AS w FROM documents) a) b"""
ORACLES["detector_backstop"] = f"""SELECT contact_id,
  CASE WHEN contains(note, 'mary jones') THEN replace(note, 'mary jones', '<PERSON>')
       ELSE regexp_replace(note, 'twice', '<LOCATION>') END AS note,
  {total(('note',))} + CAST(contains(note, 'mary jones') AS BIGINT) + CAST(contains(note, 'twice') AS BIGINT)
    AS redactions FROM ({_NOTES}) n"""
ORACLES["backstop_fail_closed"] = f"""SELECT contact_id,
  CASE WHEN contains(note, 'paid') OR contains(note, 'on file') THEN '[redacted]'
       ELSE replace(note, 'mary jones', '[name]') END AS note,
  {total(('note',))} + CASE WHEN contains(note, 'paid') OR contains(note, 'on file') OR contains(note, 'mary jones')
    THEN 1 ELSE 0 END AS redactions FROM ({_NOTES}) n"""

# ------------------------------------------------------ query-text screening



def _expected(name: str, nothing: str = "NULL") -> str:
    """What each text is expected to give, chosen by its number and not by a second copy of the rules."""
    given = [(i, e[name]) for i, (_, e) in enumerate(derived.QUERY_TEXTS) if name in e]
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in given)
    return f"CASE query_id % {len(derived.QUERY_TEXTS)} {cases} ELSE {nothing} END"


# The wording of the verdicts.
RULES = f"""SELECT query_id, database, {_expected('empty')} IS NOT NULL AS is_empty, {_expected('parse')} AS parse_error,
  {_expected('multi')} IS NOT NULL AS is_multi, {_expected('top')} AS bad_top,
  {_expected('explain')} IS NOT NULL AS explain_analyze, {_expected('writes', "''")} AS violations,
  contains({_expected('writes', "''")}, 'SELECT INTO') AS selects_into,
  contains({_expected('writes', "''")}, 'row-locking') AS locks_rows, {_expected('star', "''")} AS star_pii
  FROM ({LOG}) q"""


def _decided(rules: str) -> str:
    return f"""SELECT query_id, database,
  CASE WHEN is_empty THEN 'empty' WHEN parse_error IS NOT NULL THEN 'parse' WHEN is_multi THEN 'multi'
    WHEN bad_top IS NOT NULL THEN 'top' WHEN explain_analyze THEN 'analyze' WHEN violations <> '' THEN 'write'
    WHEN star_pii <> '' THEN 'star' END AS rule,
  CASE WHEN is_empty THEN 'empty query'
    WHEN parse_error IS NOT NULL THEN 'could not parse SQL (' || parse_error || ')'
    WHEN is_multi THEN 'only a single statement is allowed per call'
    WHEN bad_top IS NOT NULL THEN 'only SELECT / SHOW / EXPLAIN are allowed (got ' || bad_top || ')'
    WHEN explain_analyze THEN 'EXPLAIN ANALYZE executes the query and is not allowed'
    WHEN violations <> '' THEN 'write or DDL operation detected: ' || violations
    WHEN star_pii <> '' THEN 'SELECT * is not allowed on PII table(s): ' || star_pii ||
      '. List the columns you need explicitly.' END AS reason
  FROM ({rules}) r"""


_DECIDED = _decided(RULES)
for _key, _column in (
    ("screen_empty", "is_empty"),
    ("screen_parse", "parse_error"),
    ("screen_multi", "is_multi"),
    ("screen_top", "bad_top"),
    ("screen_explain", "explain_analyze"),
    ("screen_into", "selects_into"),
    ("screen_lock", "locks_rows"),
    ("screen_star_pii", "star_pii"),
):
    ORACLES[_key] = f"SELECT query_id, {_column} FROM ({RULES}) r"
ORACLES["screen_writes"] = f"SELECT query_id, violations FROM ({RULES}) r"
ORACLES["screen_queries"] = f"SELECT query_id, rule IS NULL AS allowed, rule, reason FROM ({_DECIDED}) d"
# In staging a star is allowed on any table; prod guards contacts only.
_OWN_POLICY = f"""SELECT * REPLACE (CASE WHEN database = 'prod' AND star_pii = 'contacts' THEN star_pii ELSE '' END AS star_pii)
  FROM ({RULES}) r"""
ORACLES["screen_by_source"] = f"""SELECT query_id, database, rule IS NULL AS allowed, rule, reason
  FROM ({_decided(_OWN_POLICY)}) d"""
# What the fragments of a text do, by construction.
_EFFECTS = ", ".join(f"{derived.shape_effect(i)} AS {n}" for i, n in enumerate(("head", "list", "origin", "filter", "tail")))
_SHAPE_RULES = f"""SELECT query_id, database, false AS is_empty,
    CASE WHEN tail = 'incomplete' THEN 'incomplete statement' END AS parse_error, tail = 'multi' AS is_multi, NULL AS bad_top,
    head = 'analyze' AS explain_analyze,
    concat_ws(', ', CASE WHEN filter <> '' THEN filter END, CASE WHEN tail = 'lock' THEN 'row-locking clause (FOR UPDATE/SHARE)' END) AS violations,
    CASE WHEN list = 'star' THEN origin ELSE '' END AS star_pii
  FROM (SELECT *, {_EFFECTS} FROM ({derived.SHAPED_SQL}) s) e"""
ORACLES["screen_shapes"] = f"SELECT query_id, rule IS NULL AS allowed, rule, reason FROM ({_decided(_SHAPE_RULES)}) d"
# What each query's own policy, else the shared one, says at its time; the texts read contacts or users by star.
_VERSIONS = f"SELECT source, since, CASE WHEN allow_star THEN '' ELSE lower(tables) END AS guarded FROM ({derived.VERSIONS_SQL}) v"
_IN_FORCE = f"""SELECT r.* REPLACE (CASE WHEN star_pii <> '' AND contains(coalesce(own.guarded, shared.guarded, ''), star_pii)
    THEN star_pii ELSE '' END AS star_pii)
  FROM (SELECT r.*, l.ts FROM ({RULES}) r JOIN ({LOG}) l USING (query_id)) r
  ASOF LEFT JOIN ({_VERSIONS}) own ON own.source = r.database AND r.ts >= own.since
  ASOF LEFT JOIN (SELECT * FROM ({_VERSIONS}) s WHERE source IS NULL) shared ON r.ts >= shared.since"""
ORACLES["screen_as_of"] = f"""SELECT query_id, database, rule IS NULL AS allowed, rule, reason
  FROM ({_decided(_IN_FORCE)}) d"""
ORACLES["screen_summary"] = f"""SELECT database, rule IS NULL AS allowed, rule, count(*) AS queries
  FROM ({_DECIDED}) d GROUP BY ALL"""
_GOVERNED = cascade(
    f"""SELECT contact_id, {token('email')} AS email, {partial('ssn', 4)} AS ssn, note
        FROM ({CONTACTS}) c ORDER BY contact_id LIMIT 500""",
    ("ssn", "note"),
)
ORACLES["governed_select"] = f"SELECT contact_id, email, ssn, note FROM ({_GOVERNED}) g"

# ---------------------------------------------------------------- discovery

_HINT_RE = (
    "email|e_mail|phone|mobile|fax|name|first|last|address|street|city|zip|postal|ssn|social|dob|birth|"
    "passport|license|ip_address"
)
CATALOG = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, count({c}) AS filled "
    f"FROM ({f'SELECT * FROM {t}' if t != 'contacts' else CONTACTS}) x"
    for t, cols in {**SCHEMAS, "contacts": CONTACT_SCHEMA}.items()
    for i, c in enumerate(cols, 1)
)
NAMED = f"SELECT * FROM ({CATALOG}) c WHERE regexp_matches(lower(column_name), '{_HINT_RE}')"
_SUGGEST = "CASE WHEN regexp_matches(lower(column_name), 'email|id') THEN 'hash' ELSE 'mask' END"
ORACLES["pii_columns_by_name"] = NAMED
ORACLES["pii_rule_suggestions"] = f"""SELECT arg_min(table_name, (table_name, ordinal)) AS table_name,
  arg_min(ordinal, (table_name, ordinal)) AS ordinal, column_name, {_SUGGEST} AS strategy,
  CAST(sum(filled) AS BIGINT) AS cells FROM ({NAMED}) n GROUP BY column_name"""
ORACLES["pii_tables"] = f"""SELECT table_name, count(*) AS pii_columns, CAST(sum(filled) AS BIGINT) AS cells
  FROM ({NAMED}) n GROUP BY table_name"""


def _content(t: str, source: str, columns: Sequence[str]) -> str:
    seen = ", ".join(f"CAST({c} IS NOT NULL AS BIGINT) AS seen_{c}" for c in columns)
    counted = cascade(f"SELECT {', '.join(columns)}, {seen} FROM ({source}) b", columns)
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS pattern, CAST(sum(seen_{c}) AS BIGINT) AS scanned, "
        f"count(*) FILTER (n_{c}_{p} > 0) AS rows_hit, CAST(sum(n_{c}_{p}) AS BIGINT) AS hits FROM counted_{t}"
        for c in columns
        for p in ORDER
    )
    return f"(WITH counted_{t} AS MATERIALIZED ({counted}) {rows})"


_TEXT_OF = {
    t: found for t, cols in SCHEMAS.items() if (found := tuple(c for c, family in cols.items() if family == "text"))
}
_CONTACT_TEXT = ("full_name", "email", "phone", "ssn", "card", "ip", "note", "source")
_SHARE = "CASE WHEN scanned > 0 THEN rows_hit / scanned ELSE 0 END AS share"
_CONTENT_ALL = " UNION ALL ".join(
    [f"SELECT * FROM {_content(t, f'SELECT * FROM {t}', _TEXT_OF[t])} x" for t in _TEXT_OF]
    + [f"SELECT * FROM {_content('contacts', CONTACTS, _CONTACT_TEXT)} x"]
)
ORACLES["pii_content_profile"] = f"SELECT *, {_SHARE} FROM ({_CONTENT_ALL}) a"
_SMALL_CATALOG = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name"
    for t, cols in {**SCHEMAS, "contacts": CONTACT_SCHEMA}.items()
    for c in cols
)
ORACLES["pii_policy_suggestions"] = f"""SELECT coalesce(n.table_name, c.table_name) AS table_name,
  coalesce(n.column_name, c.column_name) AS column_name, coalesce(n.named, 'mask') AS strategy,
  CASE WHEN n.named IS NULL THEN 'content' WHEN c.share IS NULL THEN 'name' ELSE 'name+content' END AS basis,
  coalesce(c.hits, 0) AS hits, coalesce(c.share, 0) AS share
  FROM (SELECT table_name, column_name, {_SUGGEST} AS named FROM ({_SMALL_CATALOG}) s
    WHERE regexp_matches(lower(column_name), '{_HINT_RE}')) n
  FULL JOIN (SELECT table_name, column_name, max(share) AS share, CAST(sum(hits) AS BIGINT) AS hits
    FROM ({ORACLES['pii_content_profile']}) p GROUP BY ALL HAVING max(share) >= 0.02) c
  ON n.table_name = c.table_name AND n.column_name = c.column_name"""

# The suggestions for contacts, by construction: named columns and those full of hits; keys get a hash.
_SUGGESTED = cascade(
    f"""SELECT contact_id, CASE WHEN full_name IS NOT NULL THEN '[redacted]' END AS full_name, {token('email')} AS email,
        '[redacted]' AS phone, '[redacted]' AS ssn, '[redacted]' AS card, '[redacted]' AS ip, '[redacted]' AS note,
        nationkey, source FROM ({CONTACTS}) c""",
    ("source",),
)
ORACLES["suggested_redaction"] = f"SELECT {CONTACT_COLUMNS} FROM ({_SUGGESTED}) s"

# ---------------------------------------------------------- audit analytics

ORACLES["audit_status"] = f"SELECT query_id, {_STATUS} AS status FROM ({OUTCOMES}) o"
ORACLES["audit_rows"] = AUDIT_ISO
ORACLES["audit_rollup"] = f"""SELECT database, status, count(*) AS queries,
  CAST(sum(redactions) AS BIGINT) AS redactions, count(*) FILTER (truncated) AS truncated
  FROM ({AUDIT}) a GROUP BY database, status"""
ORACLES["audit_last_n"] = f"""SELECT query_id, strftime(ts, '%H:%M:%S') AS time, status, rows, redactions, duration_ms,
  substr(replace(sql, chr(10), ' '), 1, 120) AS query FROM ({AUDIT}) a ORDER BY ts DESC, query_id DESC LIMIT 30"""
ORACLES["audit_top_reasons"] = f"""SELECT reason, queries, rank() OVER (ORDER BY queries DESC) AS rank
  FROM (SELECT reason, count(*) AS queries FROM ({AUDIT}) a WHERE status = 'blocked'
    GROUP BY reason) r"""
ORACLES["audit_stream_append"] = f"SELECT query_id, ts, status, sql, error FROM ({AUDIT_ISO}) a"
ORACLES["audit_stream_windowed"] = f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, database, status,
  count(*) AS queries, CAST(sum(redactions) AS BIGINT) AS redactions
  FROM (SELECT *, date_trunc('hour', ts) AS w FROM ({AUDIT}) a) b GROUP BY w, database, status"""

# A window that ends ten minutes before the newest entry of an earlier delivery is closed.
_DELIVERY = "CAST(floor((floor(epoch(ts)) - 1704067200) / 691200) AS INTEGER)"
ORACLES["audit_stream_watermark"] = f"""WITH a AS (
    SELECT *, date_trunc('hour', ts) AS w, {_DELIVERY} + CASE WHEN query_id % 17 = 0 THEN 1 ELSE 0 END AS d FROM ({AUDIT}) x),
  newest AS (SELECT d, max(ts) AS ts FROM a GROUP BY d),
  marks AS (SELECT d, max(ts) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM newest),
  judged AS (SELECT a.*, coalesce(w + INTERVAL 1 HOUR <= mark - INTERVAL 10 MINUTE, false) AS late FROM a JOIN marks USING (d))
  SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, database, status, count(*) FILTER (NOT late) AS queries,
    CAST(coalesce(sum(redactions) FILTER (NOT late), 0) AS BIGINT) AS redactions, count(*) FILTER (late) AS late
  FROM judged GROUP BY w, database, status"""
ORACLES["audit_sessions"] = f"""WITH a AS (
    SELECT *, coalesce(ts - lag(ts) OVER o > INTERVAL 30 MINUTE, true) AS first FROM ({AUDIT}) x WINDOW o AS (PARTITION BY database ORDER BY ts)),
  b AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY database ORDER BY ts) AS n FROM a)
  SELECT database, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended,
    count(*) AS queries, CAST(sum(redactions) AS BIGINT) AS redactions FROM b GROUP BY database, n"""
ORACLES["audit_sessions_stream"] = ORACLES["audit_sessions"]
ORACLES["audit_stream_dedup"] = f"""SELECT query_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, database, status, redactions
  FROM ({AUDIT}) a"""
ORACLES["match_outcomes_stream"] = f"""SELECT q.query_id, strftime(q.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, database,
    strftime(o.ts, '%Y-%m-%d %H:%M:%S.%f') AS answered, status
  FROM ({LOG}) q LEFT JOIN ({derived.REPLIES_SQL}) o
  ON o.query_id = q.query_id AND o.ts BETWEEN q.ts AND q.ts + INTERVAL 10 MINUTE"""

# ----------------------------------------------------- policies, verification

_BY_SOURCE = cascade(
    f"""SELECT contact_id, full_name,
      CASE WHEN source = 'prod' THEN {token('email')} ELSE {partial('email', 6)} END AS email,
      CASE WHEN source = 'prod' THEN NULL ELSE '[redacted]' END AS phone, '[redacted]' AS ssn, card, ip, note,
      CASE WHEN source = 'prod' THEN CAST(nationkey AS VARCHAR) ELSE '[redacted]' END AS nationkey, source FROM ({CONTACTS}) c""",
    ("full_name", "card", "ip", "note"),
)
ORACLES["redact_by_source"] = f"SELECT {CONTACT_COLUMNS} FROM ({_BY_SOURCE}) b"
ORACLES["redact_by_source_stream"] = ORACLES["redact_by_source"]
_PROD = cascade(f"SELECT contact_id, email, note FROM ({CONTACTS}) c WHERE source = 'prod'", ("note",), _DEFAULT)
_STAGING = cascade(f"SELECT contact_id, email, note, ip FROM ({CONTACTS}) c WHERE source = 'staging'", ("note", "ip"))
ORACLES["multi_source_redact"] = f"""
  SELECT 'prod' AS database, {token('contact_id')} AS key, {token('email')} AS email, note, CAST(NULL AS VARCHAR) AS ip
  FROM ({_PROD}) p
  UNION ALL SELECT 'staging', CAST(contact_id AS VARCHAR), CASE WHEN email IS NOT NULL THEN '[redacted]' END, note, ip
  FROM ({_STAGING}) s"""
_RESCANNED = ("full_name", "phone", "ssn", "card", "ip", "note", "source")
_LEAKS = " UNION ALL ".join(
    [
        f"SELECT * FROM {_content('contacts', f'SELECT {CONTACT_COLUMNS} FROM ({FULL}) f', _RESCANNED)} x",
    ]
    + [
        f"SELECT * FROM {_content(t, cascade(f'SELECT {", ".join(_TEXT_OF[t])} FROM {t}', _TEXT_OF[t]), _TEXT_OF[t])} x"
        for t in _TEXT_OF
    ]
)
ORACLES["leak_check"] = f"""SELECT table_name, column_name, pattern, scanned, hits, hits > 0 AS leaked
  FROM ({_LEAKS}) l"""
ORACLES["value_leaks"] = f"""SELECT 'full_name' AS value_column, sha256('{SALT}' || full_name) AS digest, 'tickets' AS table_name,
  'note' AS column_name, count(*) AS texts FROM ({derived.TICKETS_SQL}) t WHERE ticket_id % 9 = 0 GROUP BY full_name"""
_KEYS = f"""SELECT raw, {token('raw')} AS token, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM
  (SELECT o_custkey AS raw, count(*) AS l FROM orders GROUP BY 1) a
  FULL JOIN (SELECT c_custkey AS raw, count(*) AS r FROM customer GROUP BY 1) b USING (raw)"""
ORACLES["hash_join_integrity"] = f"""SELECT CAST(sum(n) AS BIGINT) AS raw_keys, count(*) AS tokens,
  CAST(sum(CAST(n > 1 AS BIGINT)) AS BIGINT) AS collisions, CAST(sum(rp) AS BIGINT) AS raw_pairs,
  CAST(sum(tp) AS BIGINT) AS token_pairs, CAST(sum(greatest(rp - tp, 0)) AS BIGINT) AS lost_pairs,
  CAST(sum(greatest(tp - rp, 0)) AS BIGINT) AS extra_pairs
  FROM (SELECT token, count(*) AS n, sum(l * r) AS rp, sum(l) * sum(r) AS tp FROM ({_KEYS}) k GROUP BY token) t"""

# -------------------------------------------- composition with Spark's own SQL

_JOINED = cascade(
    f"""SELECT o_orderkey, o_totalprice, {token('email')} AS email, note
        FROM orders JOIN ({CONTACTS}) c ON o_custkey = contact_id""",
    ("note",),
)
ORACLES["join_then_redact"] = f"SELECT o_orderkey, o_totalprice, email, note FROM ({_JOINED}) j"
ORACLES["hash_key_join"] = """SELECT c_mktsegment, count(*) AS orders,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
_ON_LIST = "(c_nationkey < 4 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))"
ORACLES["suppression_anti_join"] = f"SELECT {token('c_custkey')} AS token, c_name FROM customer WHERE NOT {_ON_LIST}"
ORACLES["suppression_semi_join"] = f"SELECT {token('c_custkey')} AS token, c_name FROM customer WHERE {_ON_LIST}"
ORACLES["agg_then_redact"] = f"""SELECT {token('o_custkey')} AS o_custkey, count(*) AS orders,
  max(o_totalprice) AS largest FROM orders GROUP BY orders.o_custkey"""
ORACLES["hash_key_distinct"] = (
    "SELECT count(DISTINCT o_custkey) AS raw_keys, count(DISTINCT o_custkey) AS hashed_keys FROM orders"
)
ORACLES["redactions_rollup"] = f"""SELECT lang, source, CAST(sum({total(('text',))}) AS BIGINT) AS hits,
  count(*) AS docs FROM ({_DOCS}) d GROUP BY ROLLUP (lang, source)"""
ORACLES["topk_per_group_then_redact"] = f"""SELECT o_orderkey, {token('o_custkey')} AS o_custkey, o_orderpriority,
  o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) o WHERE place <= 5"""
ORACLES["union_sources_redact"] = f"""SELECT database, count(*) AS rows, count(DISTINCT email) AS emails,
  count(ip) AS ips FROM ({ORACLES['multi_source_redact']}) m GROUP BY database"""
