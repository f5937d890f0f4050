"""Find columns with personal data by name and by content, and check for leaks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.column_rules import hash_token
from lacuna.functions.nested import holds_text, literal
from lacuna.functions.patterns import WORD, cascade
from lacuna.operators.catalog import rows_from
from lacuna.policy import ColumnRule, PatternToggles, RedactPolicy
from lacuna.sources.bloom import bloom_filter, may_hold

# A column is suspicious if its lower-cased name contains one of these.
NAME_HINTS = (
    "email",
    "e_mail",
    "phone",
    "mobile",
    "fax",
    "name",
    "first",
    "last",
    "address",
    "street",
    "city",
    "zip",
    "postal",
    "ssn",
    "social",
    "dob",
    "birth",
    "passport",
    "license",
    "ip_address",
)
# Names that contain one of these get a joinable hash instead of a mask.
KEY_HINTS = ("email", "id")


def _contains_any(name: Column, hints: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(F.lower(name), h))


def suggested_strategy(column_name: Column) -> Column:
    return F.when(_contains_any(column_name, KEY_HINTS), "hash").otherwise("mask")


def looks_personal(column_name: str) -> bool:
    """The same test on a name at hand, for ``column_catalog``."""
    return any(h in column_name.lower() for h in NAME_HINTS)


def pii_columns_by_name(catalog: DataFrame) -> DataFrame:
    """Rows of ``column_catalog`` whose column name looks personal."""
    return catalog.where(_contains_any(F.col("column_name"), NAME_HINTS))


def pii_rule_suggestions(catalog: DataFrame) -> DataFrame:
    """One rule per distinct column name: the first place it occurs, the strategy, the cells it covers."""
    place = Window.partitionBy("column_name").orderBy("table_name", "ordinal")
    same = Window.partitionBy("column_name")
    found = pii_columns_by_name(catalog).withColumns(
        {
            "place": F.row_number().over(place),
            "cells": F.sum("filled").over(same),
            "strategy": suggested_strategy(F.col("column_name")),
        }
    )
    return found.where(F.col("place") == 1).select("table_name", "ordinal", "column_name", "strategy", "cells")


def pii_tables(catalog: DataFrame) -> DataFrame:
    """Tables with a suspicious column, sorted, with their number of columns and cells at stake."""
    return (
        pii_columns_by_name(catalog)
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("pii_columns"), F.sum("filled").alias("cells"))
        .orderBy("table_name")
    )


def content_profile(
    df: DataFrame, table: str, patterns: PatternToggles | None = None, skip: tuple[str, ...] = ()
) -> DataFrame:
    """Pattern hits per column: (table_name, column_name, pattern, scanned, rows_hit, hits, share).

    One pass over all text columns and one combined row per task; counts follow
    the cascade, so each hit belongs to one pattern only.
    """
    enabled = (patterns or PatternToggles.all()).enabled()
    skipped = {s.lower() for s in skip}
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [
        (f.name, name)
        for f, name in zip(frame.schema.fields, df.columns)
        if holds_text(f.dataType) and name.lower() not in skipped
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], _CONTENT)
    keys = [key for key, _ in cells]
    # The cascade rewrites the cells in place, so what was there is noted first.
    present = frame.selectExpr(*keys, *[f"CAST({k} IS NOT NULL AS BIGINT) AS {k}_seen" for k in keys])
    counted = cascade(present, keys, enabled, counts=lambda c, p: f"{c}_{p}")
    sums: list[str] = []
    rows: list[list[str]] = []
    for key, name in cells:
        sums.append(f"coalesce(sum({key}_seen), 0L) AS {key}_seen")
        for p in enabled:
            hits = f"{key}_{p}"
            sums += [f"coalesce(sum({hits}), 0L) AS {hits}", f"count_if({hits} > 0) AS {hits}_rows"]
            rows.append([literal(table), literal(name), literal(p), f"{key}_seen", f"{hits}_rows", hits])
    long = counted.agg(*[F.expr(s) for s in sums]).select(
        rows_from(rows, "table_name, column_name, pattern, scanned, rows_hit, hits")
    )
    return long.withColumn("share", F.expr("CASE WHEN scanned > 0 THEN rows_hit / scanned ELSE 0D END"))


_CONTENT = (
    "table_name string, column_name string, pattern string, scanned bigint, rows_hit bigint, hits bigint, share double"
)


def profile_content(tables: Mapping[str, DataFrame], patterns: PatternToggles | None = None) -> DataFrame:
    """``content_profile`` over several tables."""
    return reduce(DataFrame.unionAll, [content_profile(df, name, patterns) for name, df in tables.items()])


def policy_suggestions(catalog: DataFrame, content: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Column rules backed by the name, by the content, or by both.

    A column qualifies by content when the share of its cells with a hit of any
    one pattern reaches ``threshold``.  Both sides have one row per column.
    """
    by_name = pii_columns_by_name(catalog).select(
        "table_name", "column_name", suggested_strategy(F.col("column_name")).alias("named")
    )
    by_content = (
        content.groupBy("table_name", "column_name")
        .agg(F.max("share").alias("share"), F.sum("hits").alias("hits"))
        .where(F.col("share") >= threshold)
    )
    basis = (
        F.when(F.col("named").isNull(), "content").when(F.col("share").isNull(), "name").otherwise("name+content")
    )
    return by_name.join(by_content, ["table_name", "column_name"], "full_outer").select(
        "table_name",
        "column_name",
        F.coalesce("named", F.lit("mask")).alias("strategy"),
        basis.alias("basis"),
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


def suggested_rules(suggestions: DataFrame, keep: int = 4) -> DataFrame:
    """``policy_suggestions`` as the rule table that ``redact_by_source`` takes, a table being a source."""
    return suggestions.select(
        F.col("table_name").alias("source"), F.col("column_name").alias("column"), "strategy", F.lit(keep).alias("keep")
    )


def suggested_policy(suggestions: DataFrame, table: str, salt: str, patterns: PatternToggles | None = None) -> RedactPolicy:
    """The suggested rules of one table, at most one for each of its columns, as a policy for ``redact``."""
    own = suggestions.where(F.col("table_name") == table).select("column_name", "strategy").collect()
    rules = tuple(ColumnRule(r["column_name"], r["strategy"]) for r in sorted(own))
    return RedactPolicy(rules=rules, patterns=patterns or PatternToggles(), salt=salt)


def leak_check(redacted: DataFrame, policy: RedactPolicy, table: str) -> DataFrame:
    """Rescan redacted output: residual hits per column and active pattern, and whether any is left.

    Hashed columns are skipped: digits in a token can look like a phone number.
    """
    hashed = tuple(c for c in redacted.columns if (r := policy.rule_for(c)) is not None and r.strategy == "hash")
    found = content_profile(redacted, table, policy.patterns, skip=hashed)
    return found.select("table_name", "column_name", "pattern", "scanned", "hits", (F.col("hits") > 0).alias("leaked"))


#: Values of fewer characters are no sign of anything, and those of more words are not looked for.
LEAK_CHARS, LEAK_WORDS = 5, 12
_TEXT_WORDS = rf"{WORD}+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TEXT_WORDS), F.lit(0))


def _candidates(texts: DataFrame, lengths: list[int], bits: DataFrame, firsts: DataFrame) -> DataFrame:
    """(row, run) of the runs of words of the column ``words`` that have one of the lengths and that the filters let through.

    Each word is a row of its own, so that a filter is asked by generated code and is nowhere a column, which every row would
    hold a copy of.
    """
    # The outer form, as Spark would work the words out twice to leave rows without any out.
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    word = rows.select("row", "words", F.posexplode_outer("words").alias("at", "word"))
    word = word.where(F.col("word").isNotNull() & may_hold(firsts.scalar(), F.xxhash64("word")))
    run = lambda n: F.when(F.col("at") + n <= F.size("words"), F.array_join(F.slice("words", F.col("at") + 1, n), " "))
    runs = word.select("row", F.explode_outer(F.array(*[run(n) for n in lengths])).alias("run"))
    return runs.where(F.col("run").isNotNull() & may_hold(bits.scalar(), F.xxhash64("run")))


def value_leaks(raw: DataFrame, policy: RedactPolicy, texts: Mapping[str, DataFrame], salt: str = "") -> DataFrame:
    """Whether masked, dropped or hashed values of ``raw`` still stand in a text: value_column, digest, table_name,
    column_name, texts.

    A value stands in a text if its words stand there one after the other.  Values of fewer than ``LEAK_CHARS`` characters, of
    no word or of more than ``LEAK_WORDS`` words are not looked for.  ``digest`` is SHA-256 of the salt and the value,
    ``texts`` counts the rows of each text column that hold it.

    The values fill a filter, sized by their number.  A text gives the runs of words that have the length of some value and
    that the filter lets through; only these are joined to the values, by the words themselves.
    """
    hidden = [c for c in dict.fromkeys(raw.columns) if (r := policy.rule_for(c)) is not None and r.strategy != "partial"]
    empty = raw.sparkSession.createDataFrame([], "value_column string, digest string, table_name string, column_name string, texts bigint")
    frames = {t: [c for c, f in zip(df.columns, df.schema.fields) if isinstance(f.dataType, T.StringType)] for t, df in texts.items()}
    if not hidden or not any(frames.values()):
        return empty
    frame = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    parts = [frame.select(F.lit(c).alias("value_column"), F.col(f"c{raw.columns.index(c)}").cast("string").alias("value")).distinct() for c in hidden]
    values = reduce(DataFrame.unionAll, parts).where(F.length("value") >= LEAK_CHARS)
    values = values.withColumn("n", F.size(_words(F.col("value")))).where(F.col("n").between(1, LEAK_WORDS))
    values = values.select("value_column", "n", F.array_join(_words(F.col("value")), " ").alias("run"), F.sha2(F.concat(F.lit(salt), F.col("value")), 256).alias("digest"))
    lengths = sorted(r["n"] for r in values.select("n").distinct().collect())  # at most LEAK_WORDS numbers
    if not lengths:
        return empty
    bits = bloom_filter(values.select(F.xxhash64("run")))
    firsts = bloom_filter(values.select(F.xxhash64(F.substring_index("run", " ", 1))).distinct())
    found = []
    for table, df in texts.items():
        own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        for c in dict.fromkeys(frames[table]):
            words = own.select(_words(F.col(f"c{df.columns.index(c)}")).alias("words"))
            hits = _candidates(words, lengths, bits, firsts).distinct().groupBy("run").agg(F.count(F.lit(1)).alias("texts"))
            found.append(hits.select("run", F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "texts"))
    met = reduce(DataFrame.unionAll, found).join(values, "run")
    return met.groupBy("value_column", "digest", "table_name", "column_name").agg(F.sum("texts").alias("texts"))


def hash_join_integrity(left: DataFrame, right: DataFrame, key: str, salt: str = "", digits: int = 12) -> DataFrame:
    """One row on whether joining hash tokens equals joining raw keys.

    Pairs are counted from per-key row counts, never by building the join, so
    a key that holds a third of the rows costs one row per task.
    """
    def per_key(df: DataFrame, n: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("raw")).agg(
            F.count(F.lit(1)).alias(n)
        )

    # Pairs of a hot key can exceed 64 bits.
    both = per_key(left, "l").join(per_key(right, "r"), "raw", "full_outer").select(
        hash_token(F.col("raw"), salt, digits).alias("token"),
        F.expr("CAST(coalesce(l, 0L) AS DECIMAL(18,0)) AS l"),
        F.expr("CAST(coalesce(r, 0L) AS DECIMAL(18,0)) AS r"),
    )
    tokens = both.groupBy("token").agg(
        F.expr(f"CAST(sum(l * r) AS {_PAIRS}) AS raw_pairs"),
        F.expr(f"CAST(CAST(sum(l) AS DECIMAL(18,0)) * CAST(sum(r) AS DECIMAL(18,0)) AS {_PAIRS}) AS token_pairs"),
        F.count(F.lit(1)).alias("raw_keys"),
    )
    sums = {
        "raw_pairs": "raw_pairs",
        "token_pairs": "token_pairs",
        "lost_pairs": "greatest(raw_pairs - token_pairs, 0)",
        "extra_pairs": "greatest(token_pairs - raw_pairs, 0)",
    }
    return tokens.agg(
        F.expr("coalesce(sum(raw_keys), 0L) AS raw_keys"),
        F.count(F.lit(1)).alias("tokens"),
        F.count_if(F.col("raw_keys") > 1).alias("collisions"),
        *[F.expr(f"CAST(coalesce(sum({e}), 0) AS {_PAIRS}) AS {n}") for n, e in sums.items()],
    )


_PAIRS = "DECIMAL(38,0)"
