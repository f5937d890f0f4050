r"""Lexical view of a SQL text as column expressions.

This is a screen for *logs* of query texts, not a parser and not an execution
gate.  Comments, literals and quoted identifiers are blanked in one pass, so
that none of them can hide another; whatever then looks doubtful is reported
as not parseable and gets blocked.

All repeated groups are possessive: Java runs those in a loop, so a literal of
any length cannot exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace trimmed from both ends of a text.
BLANKS = " \t\n\r\x0b\x0c"

# One alternation, first match wins.  Group 1 is a comment that opens another
# comment (its "/*" is kept, which makes the text doubtful), group 2 the first
# quote of a literal, group 3 the name inside a quoted identifier, group 4 the
# dollar and tag that open a dollar quote, group 5 that tag.
NESTED_COMMENT = r"(/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*))[^*/]*+)*+/\*)"
LINE_COMMENT = r"--[^\n\r]*+"
BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
LITERAL = r"(')(?:[^']++|'')*+'"
IDENTIFIER = r'"((?:[^"]++|"")*+)"'
DOLLAR_LITERAL = r"(?<![A-Za-z0-9_$\x{80}-\x{10ffff}])(\$([A-Za-z_][A-Za-z0-9_]*+|)\$)[\s\S]*?\$\5\$"
TOKENS = "|".join((NESTED_COMMENT, LINE_COMMENT, BLOCK_COMMENT, LITERAL, IDENTIFIER, DOLLAR_LITERAL))
QUOTED = "QUOTED__"
# What brackets the opening of a literal while texts are blanked; the text itself is freed of both first.
_OPEN, _CLOSE = "\x01", "\x02"
# What stands for a literal in a blanked text.
VALUE = "0"

# Spellings that change how a literal or a name is read: backslash in an
# escape string, Unicode-escaped identifier.
ESCAPES = r"""[Ee]'(?:[^'\\]++|'')*+\\|[Uu]&\""""


def tidy(sql: Column) -> Column:
    """Trimmed text without trailing semicolons; '' for NULL."""
    trimmed = F.btrim(F.coalesce(sql, F.lit("")), F.lit(BLANKS))
    return F.btrim(F.rtrim(trimmed, F.lit(";")), F.lit(BLANKS))


def blank(text: Column) -> Column:
    """Upper-case text with comments blanked, literals as ``0`` and one space between words."""
    c = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), TOKENS, f" $1 {_OPEN}$2$4{_CLOSE} {QUOTED}$3 ")
    c = F.regexp_replace(c, f"{_OPEN}[^{_OPEN}{_CLOSE}]+{_CLOSE}", VALUE)
    c = F.regexp_replace(F.translate(c, _OPEN + _CLOSE, ""), rf"{QUOTED}( |$)", " ")  # only quoted identifiers keep the mark
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r" ?\. ?", ".")
    return F.upper(F.regexp_replace(c, r"^[; ]+|[; ]+$", ""))


def doubtful(text: Column, blanked: Column) -> Column:
    """True if the blanked text may not mean what it seems to."""
    opened = F.length(F.replace(blanked, F.lit("("), F.lit("")))
    closed = F.length(F.replace(blanked, F.lit(")"), F.lit("")))
    leftover = r"""["']|/\*|\$(?:[^0-9]|$)"""
    return (opened != closed) | blanked.rlike(leftover) | text.rlike(ESCAPES)


# Statement kinds as the Postgres grammar names them, by leading
# keyword(s).  A text that starts with none of these and is not a read is not SQL.
STATEMENT_KINDS = {
    "ABORT": "TransactionStmt",
    "ALTER": "AlterStmt",
    "ALTER ROLE": "AlterRoleStmt",
    "ALTER TABLE": "AlterTableStmt",
    "ALTER USER": "AlterRoleStmt",
    "ANALYZE": "VacuumStmt",
    "BEGIN": "TransactionStmt",
    "CALL": "CallStmt",
    "CHECKPOINT": "CheckPointStmt",
    "CLUSTER": "ClusterStmt",
    "COMMENT": "CommentStmt",
    "COMMIT": "TransactionStmt",
    "COPY": "CopyStmt",
    "CREATE": "CreateStmt",
    "CREATE FUNCTION": "CreateFunctionStmt",
    "CREATE INDEX": "IndexStmt",
    "CREATE PROCEDURE": "CreateFunctionStmt",
    "CREATE ROLE": "CreateRoleStmt",
    "CREATE SCHEMA": "CreateSchemaStmt",
    "CREATE USER": "CreateRoleStmt",
    "CREATE VIEW": "ViewStmt",
    "DEALLOCATE": "DeallocateStmt",
    "DECLARE": "DeclareCursorStmt",
    "DELETE": "DeleteStmt",
    "DISCARD": "DiscardStmt",
    "DO": "DoStmt",
    "DROP": "DropStmt",
    "DROP ROLE": "DropRoleStmt",
    "DROP USER": "DropRoleStmt",
    "END": "TransactionStmt",
    "EXECUTE": "ExecuteStmt",
    "FETCH": "FetchStmt",
    "GRANT": "GrantStmt",
    "INSERT": "InsertStmt",
    "LISTEN": "ListenStmt",
    "LOCK": "LockStmt",
    "MERGE": "MergeStmt",
    "NOTIFY": "NotifyStmt",
    "PREPARE": "PrepareStmt",
    "REFRESH": "RefreshMatViewStmt",
    "REINDEX": "ReindexStmt",
    "RELEASE": "TransactionStmt",
    "RESET": "VariableSetStmt",
    "REVOKE": "GrantStmt",
    "ROLLBACK": "TransactionStmt",
    "SAVEPOINT": "TransactionStmt",
    "SET": "VariableSetStmt",
    "START": "TransactionStmt",
    "TRUNCATE": "TruncateStmt",
    "UPDATE": "UpdateStmt",
    "VACUUM": "VacuumStmt",
}
READS = r"^[( ]*(?:SELECT|WITH|VALUES|TABLE|SHOW|EXPLAIN)(?:[^A-Z0-9_]|$)"
_CREATE_AS = r"^CREATE (?:TEMP |TEMPORARY |UNLOGGED )?TABLE .* AS [( ]*(?:SELECT|WITH|VALUES|TABLE|EXECUTE)\b"
_MODIFIERS = r"^(CREATE) (?:OR REPLACE |TEMP |TEMPORARY |UNLOGGED |UNIQUE |RECURSIVE )*"


def statement_kind(blanked: Column) -> Column:
    """Grammar name of a non-read statement; NULL if its first word starts none."""
    head = F.regexp_replace(blanked, _MODIFIERS, "$1 ")
    kinds = F.expr("map(" + ", ".join(f"'{words}', '{kind}'" for words, kind in STATEMENT_KINDS.items()) + ")")
    pair = F.regexp_extract(head, r"^([A-Z]+ [A-Z]+)\b", 1)
    word = F.regexp_extract(head, r"^([A-Z]+)\b", 1)
    named = F.coalesce(F.try_element_at(kinds, pair), F.try_element_at(kinds, word))
    return F.when(blanked.rlike(_CREATE_AS), F.lit("CreateTableAsStmt")).otherwise(named)


def first_word(blanked: Column) -> Column:
    return F.regexp_extract(blanked, r"^([^ ]*)", 1)


RUNS_QUERY = r"^[( ]*EXPLAIN ?(?:ANALY[SZ]E\b|VERBOSE ANALY[SZ]E\b|\([^)]*ANALY[SZ]E\b)"

# Shapes that no grammar accepts: a clause without an operand or followed by the
# next one, a head word alone, a WITH list without AS, an empty place in a list,
# an operator without a right side, three plain words in a row.
_CLAUSE = r"(?:(?<!DISTINCT )FROM|WHERE|JOIN|HAVING|GROUP BY|ORDER BY|UNION|EXCEPT|INTERSECT)"
# Words of the grammar that can stand next to names without a comma or an operator between.
GRAMMAR_WORDS = (
    "ABSENT ALL ANALYSE ANALYZE AND ANY ARRAY AS ASC ASYMMETRIC AT BERNOULLI BETWEEN BOTH BY CASE CHARACTER COLLATE "
    "COLUMNS CONDITIONAL CROSS CUBE CURRENT CYCLE DATE DAY DEFAULT DEPTH BREADTH DESC DISTINCT DOCUMENT DOUBLE ELSE EMPTY END "
    "ERROR ESCAPE EXCEPT EXCLUDE EXISTS EXPLAIN FALSE FETCH FILTER FIRST FOLLOWING FOR FORMAT FROM FULL GROUP "
    "GROUPING GROUPS HAVING HOUR ILIKE IN INNER INTERSECT INTERVAL INTO IS ISNULL ISOLATION JOIN JSON KEEP KEY KEYS LAST LATERAL "
    "LEADING LEFT LIKE LIMIT LOCAL LOCKED MATERIALIZED MINUTE MONTH NATIONAL NATURAL NESTED NEXT NFC NFD NFKC NFKD NO "
    "NORMALIZED NOT NOTNULL NOWAIT NULL NULLS OBJECT OF OFFSET OMIT ON ONLY OR ORDER ORDINALITY OTHERS OUTER OVER "
    "OVERLAPS PARTITION PASSING PATH PLACING PRECEDING PRECISION QUOTES RANGE RECURSIVE REPEATABLE RETURNING RIGHT ROLLUP ROW "
    "ROWS SCALAR SEARCH SECOND SELECT SET SETS SHARE SHOW SIMILAR SKIP SOME SYMMETRIC SYSTEM TABLE TABLESAMPLE TEMP "
    "TEMPORARY THEN TIES TIME TIMESTAMP TO TRAILING TRUE UESCAPE UNBOUNDED UNCONDITIONAL UNION UNIQUE UNKNOWN UNLOGGED "
    "UPDATE USING VALUE VALUES VARYING VERBOSE WHEN WHERE WINDOW WITH WITHIN WITHOUT WRAPPER YEAR ZONE"
).split()
_PLAIN_WORD = rf"(?!(?:{'|'.join(GRAMMAR_WORDS)})\b)[A-Z_][A-Z0-9_$]*+"
_NEXT_CLAUSE = r"(?:FROM|WHERE|HAVING|GROUP BY|ORDER BY|LIMIT|OFFSET|UNION|EXCEPT|INTERSECT)"
_INCOMPLETE = "|".join(
    (
        rf"\b{_CLAUSE} ?(?:$|[),;])",
        rf"\b{_CLAUSE} (?:FROM|WHERE|JOIN|HAVING|GROUP BY|ORDER BY|LIMIT|UNION|EXCEPT|INTERSECT)\b",
        r"^[( ]*(?:SHOW|EXPLAIN|WITH|VALUES|TABLE)[ )]*$",
        rf", ?(?:,|\)|$|{_NEXT_CLAUSE}\b)|\( ?,|\b(?:SELECT|DISTINCT|VALUES|BY) ?,",
        r"[-+/%<>=|&^](?<!OPERATOR\([^)]{0,60}) ?(?:$|[),])",
        r"\b(?:LIMIT|OFFSET) ?(?:$|[),]|(?:LIMIT|OFFSET|FOR|FETCH)\b)",
        r"^[( ]*SHOW (?!TIME ZONE$|SESSION AUTHORIZATION$|TRANSACTION ISOLATION LEVEL$)[^ ]+ [^ ]",
        rf"\b(?=[A-Z_][A-Z0-9_$]*+ [A-Z_][A-Z0-9_$]*+ [A-Z_]){_PLAIN_WORD} {_PLAIN_WORD} {_PLAIN_WORD}\b",
    )
)
_WITH_LIST = r"^[( ]*(?:EXPLAIN ?(?:\([^)]*\) ?)?(?:VERBOSE )?)?WITH\b"
_WITH_AS = r"\bAS ?(?:NOT )?(?:MATERIALIZED ?)?\("


def incomplete(blanked: Column) -> Column:
    return blanked.rlike(_INCOMPLETE) | (blanked.rlike(_WITH_LIST) & ~blanked.rlike(_WITH_AS))


# Where a statement can start inside a read: after "(", after a CTE list, after EXPLAIN.
_WRITES_IN = r"(?:[(] ?|^EXPLAIN ?(?:\([^)]*\) ?)?(?:VERBOSE )?)(INSERT|UPDATE|DELETE|MERGE|CREATE|REFRESH|EXECUTE) "
_WRITES_AFTER = r"[)] ?(INSERT|UPDATE|DELETE|MERGE) "
# And wherever it stands, what can hardly be anything else.
_WRITES_ANYWHERE = (
    ("INSERT", r"\bINSERT INTO\b"),
    ("DELETE", r"\bDELETE FROM\b"),
    ("MERGE", r"\bMERGE INTO\b"),
    ("UPDATE", r"\bUPDATE (?:ONLY )?[^ (),;]+ (?:AS )?(?:[^ (),;]+ )?SET\b"),
)
_WRITE_NAMES = {"CREATE": "CREATETABLEAS", "REFRESH": "REFRESHMATVIEW"}
INTO_LABEL = "SELECT INTO"
LOCK_LABEL = "row-locking clause (FOR UPDATE/SHARE)"


def writes(blanked: Column) -> Column:
    """Kinds of write inside a read, distinct and sorted; empty for what is no read."""
    found = F.concat(*[F.regexp_extract_all(blanked, F.lit(r), F.lit(1)) for r in (_WRITES_IN, _WRITES_AFTER)])
    anywhere = [F.when(blanked.rlike(r), F.lit(kind)) for kind, r in _WRITES_ANYWHERE]
    found = F.concat(found, F.array_compact(F.array(*anywhere)))
    for word, name in _WRITE_NAMES.items():
        found = F.when(F.array_contains(found, word), F.array_append(F.array_remove(found, word), F.lit(name))).otherwise(
            found
        )
    return F.when(blanked.rlike(READS), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def selects_into(blanked: Column) -> Column:
    return F.regexp_replace(blanked, r"\b(INSERT|MERGE) INTO\b", "$1").rlike(r"\bINTO\b")


def locks_rows(blanked: Column) -> Column:
    return blanked.rlike(r"\bFOR (?:NO KEY UPDATE|UPDATE|KEY SHARE|SHARE)\b")


_STAR = r"\) ?\* ?(?:FROM\b|,)|(?:\bSELECT|\bSELECT DISTINCT|\bSELECT ALL|,|\.|\bRETURNING) ?\*|\bTABLE "
_NAME = r"[\p{L}_][\p{L}\p{N}_$]*"
_RELATION = rf"(?:\bFROM|\bJOIN|,|\bTABLE|\bONLY)[ (]*(?:ONLY\b[ (]*)?((?:{_NAME}\.)*{_NAME})"


def has_star(blanked: Column) -> Column:
    """A star projection anywhere; ``count(*)`` is none."""
    return blanked.rlike(_STAR)


def relations_among(blanked: Column, tables: Column) -> Column:
    """Which of ``tables`` (an array of lower-case names) the text reads from: sorted, schema ignored."""
    full = F.regexp_extract_all(blanked, F.lit(_RELATION), F.lit(1))
    bare = F.transform(full, lambda r: F.lower(F.replace(F.substring_index(r, ".", -1), F.lit(QUOTED), F.lit(""))))
    # Names that need quotes never match the pattern above; look for the quoted form.
    quoted = F.filter(
        tables,
        lambda t: ~t.rlike(r"^[\p{L}\p{N}_$]+$")
        & F.contains(F.lower(blanked), F.concat(F.lit(QUOTED.lower()), t, F.lit(" "))),
    )
    return F.array_sort(F.array_distinct(F.concat(F.array_intersect(tables, bare), quoted)))
