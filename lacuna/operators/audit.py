"""Audit rows from query outcomes, and what one asks of an audit table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.patterns import cascade
from lacuna.functions.sqltext import BLANKS
from lacuna.functions.wire import json_text
from lacuna.policy import PatternToggles

SQL_CHARS = 2000
MASK_NOTE = "Personal data was masked: bracketed words and sha256 tokens stand for values that are withheld on purpose."
# The fields of an audit entry.
AUDIT_COLUMNS = (
    "ts",
    "database",
    "status",
    "sql",
    "reason",
    "error",
    "rows",
    "redactions",
    "truncated",
    "duration_ms",
)


def status(reason: Column, error: Column) -> Column:
    """blocked, error or allowed, decided by which text is present (empty counts as present)."""
    return F.when(reason.isNotNull(), "blocked").when(error.isNotNull(), "error").otherwise("allowed")


def audit_rows(outcomes: DataFrame, scrub: bool = True, patterns: PatternToggles | None = None) -> DataFrame:
    """Outcome rows as audit rows.

    Input columns: ts, database, sql, reason, error, rows, redactions,
    truncated, duration_ms; others are carried along.  PII is scrubbed from
    the SQL and error texts before the SQL is cut, so a cut never leaves half
    a hit behind.
    """
    kept = [c for c in outcomes.columns if c not in AUDIT_COLUMNS]
    df = outcomes.withColumn("status", status(F.col("reason"), F.col("error")))
    if scrub:
        df = cascade(df, ["sql", "error"], (patterns or PatternToggles()).enabled())
    return df.withColumns(
        {
            "sql": F.substring(F.btrim(F.col("sql"), F.lit(BLANKS)), 1, SQL_CHARS),
            "duration_ms": F.bround("duration_ms", 1),
        }
    ).select(*kept, *AUDIT_COLUMNS)


def rollup_by_status(audit: DataFrame, *by: str) -> DataFrame:
    """Queries, redactions and truncated reads per group and status."""
    return audit.groupBy(*(by or ("database",)), "status").agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum("redactions"), F.lit(0)).cast("bigint").alias("redactions"),
        F.count_if(F.col("truncated")).cast("bigint").alias("truncated"),
    )


def newest(entries: DataFrame, n: int = 30, ties: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows of a table with ``ts``, newest first (per-task top-n, then a merge).

    Also for outcomes: taken before ``audit_rows``, only these are scrubbed.
    """
    return entries.orderBy(F.desc("ts"), *[F.desc(c) for c in ties]).limit(n)


def last_entries(audit: DataFrame, n: int = 30, ties: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` audit rows in display form."""
    return display(newest(audit, n, ties), ties)


def display(audit: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Audit rows in display form: time of day, shape and the start of the text on one line."""
    return audit.select(
        *ties,
        F.date_format("ts", "HH:mm:ss").alias("time"),
        "status",
        "rows",
        "redactions",
        "duration_ms",
        F.substring(F.translate(F.coalesce("sql", F.lit("")), "\n", " "), 1, 120).alias("query"),
    )


def top_reasons(audit: DataFrame) -> DataFrame:
    """Every block reason with its count and rank, the most frequent first; ties share a rank.

    Counting combines before the shuffle.  Ranks are cumulated over the
    distinct counts, of which there are few, and joined back to the reasons.
    """
    counted = (
        audit.where(F.col("status") == "blocked").groupBy("reason").agg(F.count(F.lit(1)).alias("queries"))
    )
    sizes = counted.groupBy("queries").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("queries")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("queries", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).cast("bigint").alias("rank"))
    return counted.join(ranks, "queries").select("reason", "queries", "rank")


def outcome_payload(outcomes: DataFrame, name: str = "payload") -> DataFrame:
    """Add the JSON a caller receives for each outcome.

    Blocked and failed queries report why; successful ones their shape, their
    ``result_columns`` when the table has them, and a note if anything was
    masked.  The rows themselves are a table of their own (``wire_json``).
    """
    c = F.col
    base = [F.lit("ok").alias("status"), c("database")]
    if "result_columns" in outcomes.columns:
        base.append(c("result_columns").alias("columns"))
    base += [c("rows").alias("row_count"), c("truncated"), c("redactions")]
    ok = F.when(c("redactions") > 0, json_text(*base, F.lit(MASK_NOTE).alias("note"))).otherwise(json_text(*base))
    failed = json_text(F.lit("error").alias("status"), c("database"), c("error"))
    blocked = json_text(F.lit("blocked").alias("status"), c("database"), c("reason"))
    text = F.when(c("reason").isNotNull(), blocked).when(c("error").isNotNull(), failed).otherwise(ok)
    return outcomes.withColumn(name, text)
