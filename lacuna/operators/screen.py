"""Screen a table or stream of query texts against the read-only policy.

One projection chain per text: no shuffle, no Python, so a log in which one
text makes up a third of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import sqltext
from lacuna.functions.names import unused
from lacuna.functions.nested import name
from lacuna.operators.asof import as_of_join
from lacuna.policy import ReadPolicy
from lacuna.sources.sizing import lookup_join, shared_folder

RULE_COLUMNS = (
    "is_empty",
    "parse_error",
    "is_multi",
    "bad_top",
    "explain_analyze",
    "violations",
    "star_pii",
)
_VERDICT = ("rule", "reason", "allowed")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that is used often, so that a pushed-down filter copies it once."""
    return F.transform(F.array(value), body)[0]


def _rules(text: Column, b: Column, guarded: Column | None) -> Column:
    """Outcome of every rule as one struct, from the trimmed and the blanked text.

    ``guarded`` has the tables that must not be read by star, None for none.
    """
    kind = sqltext.statement_kind(b)
    read = b.rlike(sqltext.READS)
    parse_error = (
        F.when(sqltext.doubtful(text, b), F.lit("unbalanced or ambiguous text"))
        .when((b != "") & ~read & kind.isNull(), F.concat(F.lit("unexpected "), sqltext.first_word(b)))
        .when(read & sqltext.incomplete(b), F.lit("incomplete statement"))
    )
    extra = F.array_compact(
        F.array(
            F.when(sqltext.selects_into(b), F.lit(sqltext.INTO_LABEL)),
            F.when(sqltext.locks_rows(b), F.lit(sqltext.LOCK_LABEL)),
        )
    )
    tables = F.array().cast("array<string>")
    if guarded is not None:
        tables = F.when(sqltext.has_star(b), sqltext.relations_among(b, guarded)).otherwise(tables)
    return F.struct(
        (text == "").alias("is_empty"),
        parse_error.alias("parse_error"),
        ((text != "") & ((b == "") | b.contains(";"))).alias("is_multi"),
        F.when((b != "") & ~read, kind).alias("bad_top"),
        b.rlike(sqltext.RUNS_QUERY).alias("explain_analyze"),
        F.array_sort(F.concat(sqltext.writes(b), extra)).alias("violations"),
        tables.alias("star_pii"),
    )


def _guarded(policy: ReadPolicy | None) -> Column | None:
    if policy is None or policy.allow_star or not policy.pii_tables:
        return None
    return F.array(*[F.lit(t) for t in sorted({t.lower() for t in policy.pii_tables})])


def _outcome(sql: str, guarded: Column | None) -> Column:
    tidy = sqltext.tidy(F.col(sql))
    return _let(tidy, lambda t: _let(sqltext.blank(t), lambda b: _rules(t, b, guarded)))


def rule_columns(df: DataFrame, sql: str = "sql", policy: ReadPolicy | None = None) -> DataFrame:
    """Add the outcome of every rule, whether or not an earlier rule already decided."""
    found = unused("_screen", df.columns, RULE_COLUMNS)
    screened = df.withColumn(found, _outcome(sql, _guarded(policy)))
    return screened.withColumns({c: F.col(f"{found}.{c}") for c in RULE_COLUMNS}).drop(found)


# The wording of the verdicts.
def _verdict(r: Column) -> Column:
    """(rule, reason) of the first rule that blocks; both NULL when none does."""
    ladder: list[tuple[str, Column, Column]] = [
        ("empty", r["is_empty"], F.lit("empty query")),
        (
            "parse",
            r["parse_error"].isNotNull(),
            F.concat(F.lit("could not parse SQL ("), r["parse_error"], F.lit(")")),
        ),
        ("multi", r["is_multi"], F.lit("only a single statement is allowed per call")),
        (
            "top",
            r["bad_top"].isNotNull(),
            F.concat(F.lit("only SELECT / SHOW / EXPLAIN are allowed (got "), r["bad_top"], F.lit(")")),
        ),
        ("analyze", r["explain_analyze"], F.lit("EXPLAIN ANALYZE executes the query and is not allowed")),
        (
            "write",
            F.size(r["violations"]) > 0,
            F.concat(F.lit("write or DDL operation detected: "), F.array_join(r["violations"], ", ")),
        ),
        (
            "star",
            F.size(r["star_pii"]) > 0,
            F.concat(
                F.lit("SELECT * is not allowed on PII table(s): "),
                F.array_join(r["star_pii"], ", "),
                F.lit(". List the columns you need explicitly."),
            ),
        ),
    ]
    return F.coalesce(
        *[F.when(hit, F.struct(F.lit(label).alias("rule"), text.alias("reason"))) for label, hit, text in ladder]
    )


def screen_queries(df: DataFrame, sql: str = "sql", policy: ReadPolicy | None = None) -> DataFrame:
    """Add ``rule`` (the first that blocked), ``reason`` and ``allowed`` to each query text."""
    return _judged(df, sql, _guarded(policy))


def screen_by_source(df: DataFrame, policies: DataFrame, sql: str = "sql", source: str = "database") -> DataFrame:
    """``screen_queries`` with each row's policy taken from its source.

    ``policies`` has (source, pii_tables array<string>, allow_star); a NULL
    source is the shared policy, which holds for sources without one.  Without
    either no table is guarded.  Of several policies for a source the strictest
    parts hold together: all tables, and no star unless all allow it.
    """
    merged = policies.groupBy("source").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pii_tables")))).alias("pii_tables"),
        F.bool_and(F.coalesce("allow_star", F.lit(False))).alias("allow_star"),
    )
    key, own_tables, shared_tables = (unused(n, df.columns, _VERDICT) for n in ("_source", "_guarded", "_shared"))
    tables = merged.select("source", _tables_of(F.col("pii_tables"), F.col("allow_star")).alias(own_tables))
    shared = tables.where("source IS NULL").select(own_tables).scalar()
    own = tables.where("source IS NOT NULL").withColumnRenamed("source", key)
    joined = lookup_join(df.withColumn(key, F.col(name(source))), own, key).withColumn(shared_tables, shared)
    guarded = F.coalesce(own_tables, shared_tables, F.array().cast("array<string>"))
    return _judged(joined, sql, guarded).select(*[F.col(name(c)) for c in df.columns if c not in _VERDICT], *_VERDICT)


def screen_as_of(df: DataFrame, versions: DataFrame, sql: str = "sql", source: str = "database", at: str = "ts") -> DataFrame:
    """``screen_by_source`` with the policy that was in force when each query ran.

    ``versions`` has (source, since, pii_tables array<string>, allow_star): a version holds for its source from ``since``
    until the next one.  Versions of a NULL source are the shared policy, used where the source has none yet.  A query
    without a time or before every version is guarded by nothing.
    """
    own, shared = (unused(n, df.columns, _VERDICT) for n in ("_guarded", "_shared"))
    listed = versions.select("source", "since", _tables_of(F.col("pii_tables"), F.col("allow_star")).alias(own))
    dated = as_of_join(df, listed.where("source IS NOT NULL"), source, at, "source", "since", [own])
    general = listed.where("source IS NULL").select("since", F.col(own).alias(shared))
    guarded = F.coalesce(own, F.array().cast("array<string>"))
    if not general.isEmpty():
        # The second join looks at its rows several times, so the first is done once and written.
        folder = shared_folder(df.sparkSession, "as-of")
        plain = [f"c{i}" for i in range(len(dated.columns))]
        dated.toDF(*plain).write.parquet(folder)
        back = df.sparkSession.read.parquet(folder).toDF(*dated.columns)
        dated = as_of_join(back, general, None, at, None, "since", [shared])
        guarded = F.coalesce(own, shared, F.array().cast("array<string>"))
    return _judged(dated, sql, guarded).select(*[F.col(name(c)) for c in df.columns if c not in _VERDICT], *_VERDICT)


def _tables_of(pii_tables: Column, allow_star: Column) -> Column:
    """The tables that a policy keeps from being read by star, in lower case and in order."""
    lower = F.array_sort(F.array_distinct(F.transform(F.coalesce(pii_tables, F.array().cast("array<string>")), lambda t: F.lower(t))))
    return F.when(F.coalesce(allow_star, F.lit(False)), F.array().cast("array<string>")).otherwise(lower)


def _judged(df: DataFrame, sql: str, guarded: Column | None) -> DataFrame:
    found = unused("_verdict", df.columns, _VERDICT)
    judged = df.withColumn(found, _let(_outcome(sql, guarded), _verdict))
    rule, reason = F.col(f"{found}.rule"), F.col(f"{found}.reason")
    return judged.withColumns({"rule": rule, "reason": reason, "allowed": rule.isNull()}).drop(found)


def screen_summary(screened: DataFrame, *by: str) -> DataFrame:
    """Verdict totals: one small row per group, combined before the shuffle."""
    keys = [*by, "allowed", "rule"]
    return screened.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"))
