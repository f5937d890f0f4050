"""The full redactor: column rules, then the pattern cascade, then the backstop.

``redact`` works on batch and streaming DataFrames alike: it is a chain of
projections with no shuffle.  Counts come in three forms:

* ``redact_with_hits``  one BIGINT column per row,
* ``redaction_counts``  a one-row aggregate, exact under task retries,
* ``redact_observed``   metrics gathered while the redacted rows are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.column_rules import apply_strategy
from lacuna.functions.nested import holds_text, literal
from lacuna.functions.nested import name as name_of
from lacuna.functions.patterns import PATTERNS, cascade
from lacuna.operators.catalog import rows_from
from lacuna.policy import ColumnRule, PatternToggles, RedactPolicy

RULES, FREE_TEXT = "column_rules", "free_text"
KINDS = (RULES, *PATTERNS, FREE_TEXT)


def redact_text(df: DataFrame, column: str, patterns: PatternToggles | None = None) -> DataFrame:
    """The pattern cascade on one column, in place."""
    return cascade(df, [column], (patterns or PatternToggles()).enabled())


def text_hits(
    df: DataFrame, column: str, patterns: PatternToggles | None = None, name: Callable[[str], str] | None = None
) -> DataFrame:
    """The cascade plus one BIGINT column of hits per active pattern (and ``hits``, their sum)."""
    enabled = (patterns or PatternToggles()).enabled()
    label = name or (lambda pattern: f"{pattern}_hits")
    done = cascade(df, [column], enabled, counts=lambda _, p: label(p))
    return done.withColumn("hits", F.expr(" + ".join(["0L", *[name_of(label(p)) for p in enabled]])))


def apply_rules(df: DataFrame, policy: RedactPolicy) -> DataFrame:
    """Column rules only; columns without a rule pass through untouched."""
    return redact(df, replace(policy, patterns=PatternToggles.only(), free_text=None))


def redact(df: DataFrame, policy: RedactPolicy) -> DataFrame:
    """Column rules, patterns and backstop; the column names stay as they are."""
    return _Plan.of(df, policy, counting=False).result()


def redact_with_hits(df: DataFrame, policy: RedactPolicy, hits: str = "redactions") -> DataFrame:
    """``redact`` plus the number of redactions in each row."""
    plan = _Plan.of(df, policy, counting=True)
    return plan.result(extra=[F.expr(plan.every_kind()).alias(hits)])


def redaction_counts(df: DataFrame, policy: RedactPolicy) -> DataFrame:
    """One row: redactions by kind, their total and the rows scanned."""
    plan = _Plan.of(df, policy, counting=True)
    return plan.frame.agg(*plan.metrics())


def redact_observed(df: DataFrame, policy: RedactPolicy, observation: Observation | str) -> DataFrame:
    """``redact`` that also reports the counts of ``redaction_counts`` as it runs.

    The metrics arrive with the job that consumes the rows (batch) or with
    every micro-batch's progress (stream); the data is read once.  Write the
    result directly: if a shuffle follows and its map stage is run again, its
    rows are counted again.  ``redaction_counts`` has no such limit.
    """
    plan = _Plan.of(df, policy, counting=True)
    return plan.result(frame=plan.frame.observe(observation, *plan.metrics()))


def column_rule_counts(df: DataFrame, rules: tuple[ColumnRule, ...] | list[ColumnRule]) -> DataFrame:
    """(column, strategy, cells): non-null cells each matching rule redacts."""
    policy = RedactPolicy(rules=tuple(rules))
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    hit = [(i, name, policy.rule_for(name)) for i, name in enumerate(df.columns)]
    hit = [(i, name, rule) for i, name, rule in hit if rule is not None]
    if not hit:
        return df.sparkSession.createDataFrame([], "column string, strategy string, cells bigint")
    totals = frame.agg(*[F.count(f"c{i}").alias(f"c{i}") for i, _, _ in hit])
    rows = [[literal(n), literal(r.strategy), f"c{i}"] for i, n, r in hit]
    return totals.select(rows_from(rows, "column, strategy, cells"))


@dataclass(frozen=True)
class _Plan:
    """A redacted frame with positional names, its real names and its count columns."""

    frame: DataFrame
    names: tuple[str, ...]
    counted: dict[str, tuple[str, ...]]  # kind -> BIGINT columns of ``frame``

    @classmethod
    def of(cls, df: DataFrame, policy: RedactPolicy, counting: bool) -> _Plan:
        # Positional names make duplicate and case-variant columns safe.
        names = tuple(df.columns)
        keys = [f"c{i}" for i in range(len(names))]
        frame = df.toDF(*keys)
        counted: dict[str, list[str]] = {k: [] for k in KINDS}
        policy.warn_if_guessable()

        changed: dict[str, Column] = {}
        sealed: set[str] = set()
        for key, name in zip(keys, names):
            rule = policy.rule_for(name)
            if rule is None:
                continue
            dtype = frame.schema[key].dataType
            changed[key] = apply_strategy(F.col(key), dtype, rule.strategy, rule.keep, policy.salt, policy.digits)
            if rule.strategy in ("mask", "null") or (rule.strategy == "hash" and not policy.rescan_hashed):
                sealed.add(key)  # nothing left in these cells that a pattern should touch
            if counting:
                changed[f"{key}_rule"] = F.col(key).isNotNull().cast("bigint")
                counted[RULES].append(f"{key}_rule")
        if changed:
            frame = frame.withColumns(changed)

        scanned = [k for k in keys if k not in sealed and holds_text(frame.schema[k].dataType, policy.nested)]
        enabled = policy.patterns.enabled()
        frame = cascade(frame, scanned, enabled, counts=(lambda c, p: f"{c}_{p}") if counting else None)
        if counting:
            for p in enabled:
                counted[p] = [f"{k}_{p}" for k in scanned]

        if policy.free_text is not None:
            for key in scanned:
                if isinstance(frame.schema[key].dataType, T.StringType):
                    frame = policy.free_text(frame, key, f"{key}_free")
                    counted[FREE_TEXT].append(f"{key}_free")
        return cls(frame, names, {k: tuple(v) for k, v in counted.items()})

    def kind(self, name: str) -> str:
        return " + ".join(["0L", *self.counted[name]])

    def every_kind(self) -> str:
        return " + ".join(self.kind(k) for k in KINDS)

    def metrics(self) -> list[Column]:
        sums = [F.expr(f"coalesce(sum({self.kind(k)}), 0L) AS {k}") for k in KINDS]
        total = F.expr(f"coalesce(sum({self.every_kind()}), 0L) AS redactions")
        return [*sums, total, F.count(F.lit(1)).alias("rows")]

    def result(self, frame: DataFrame | None = None, extra: list[Column] | None = None) -> DataFrame:
        cells = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)]
        return (frame or self.frame).select(*cells, *(extra or []))
