"""Inventory and column profiles of registered tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.nested import literal

# Schemas that hold the system's own tables.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")

_FAMILIES: tuple[tuple[type, str], ...] = (
    (T.StringType, "text"),
    (T.BooleanType, "boolean"),
    (T.IntegralType, "integer"),
    (T.FractionalType, "number"),
    (T.TimestampType, "timestamp"),
    (T.TimestampNTZType, "timestamp"),
    (T.DateType, "date"),
    (T.BinaryType, "binary"),
    (T.ArrayType, "array"),
    (T.MapType, "map"),
    (T.StructType, "struct"),
)


def type_family(dtype: T.DataType) -> str:
    return next((name for kind, name in _FAMILIES if isinstance(dtype, kind)), "other")


def split_name(table: str, default_schema: str = "public") -> tuple[str, str]:
    """'schema.table' split at the first dot."""
    schema, dot, name = table.partition(".")
    return (schema, name) if dot else (default_schema, table)


def catalog_tables(spark: SparkSession, schemas: list[str] | None = None) -> dict[str, DataFrame]:
    """The session catalog's tables and views as ``schema.table -> DataFrame``, system schemas left out."""
    found: dict[str, DataFrame] = {}
    for schema in schemas or [d.name for d in spark.catalog.listDatabases()]:
        if schema in SYSTEM_SCHEMAS:
            continue
        for t in spark.catalog.listTables(schema):
            name = t.name if t.isTemporary else f"{schema}.{t.name}"
            found[name] = spark.table(name)
    return dict(sorted(found.items()))


def rows_from(entries: list[list[str]], columns: str) -> Column:
    """A generator of one row per list of SQL values, e.g. for ``columns`` = "a, b"."""
    values = ", ".join(v for entry in entries for v in entry)
    return F.expr(f"stack({len(entries)}, {values}) AS ({columns})")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_columns, n_rows), sorted; one count per table, which Parquet answers from footers."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_rows"
        )
        for name, df in tables.items()
        if split_name(name)[0] not in SYSTEM_SCHEMAS
    ]
    return _union(parts).orderBy("table_name")


_PROFILE = "ordinal, column_name, family, data_type, nullable, nulls, distinct_values, max_length"


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column in ordinal order: family, data type, nullable, nulls, distinct values, longest text.

    By default one pass in which distinct values are HyperLogLog estimates,
    merged per task, so that only one row per task moves.

    ``exact=True`` counts distinct 128-bit digests: the scan turns every cell
    into (ordinal, digest), equal ones are combined per task, and one shuffle
    serves all columns.  No value itself is shuffled.
    """
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    longest = {f.name: isinstance(f.dataType, T.StringType) for f in frame.schema.fields}
    told = [
        [f"{i + 1}L", literal(name), literal(type_family(f.dataType)), literal(f.dataType.simpleString()), str(f.nullable)]
        for i, (name, f) in enumerate(zip(df.columns, frame.schema.fields))
    ]
    if not exact:
        sums, rows = [], []
        for entry, c in zip(told, frame.columns):
            length = f"CAST(max(length({c})) AS BIGINT)" if longest[c] else "CAST(NULL AS BIGINT)"
            sums += [f"count(1) - count({c}) AS {c}_nulls", f"approx_count_distinct({c}) AS {c}_distinct", f"{length} AS {c}_longest"]
            rows.append([*entry, f"{c}_nulls", f"{c}_distinct", f"{c}_longest"])
        return frame.agg(*[F.expr(e) for e in sums]).select(rows_from(rows, _PROFILE))
    cells = []
    for i, f in enumerate(frame.schema.fields):
        c = f"to_json({f.name})" if _holds_map(f.dataType) else f.name  # maps have no hash
        length = f"length({f.name})" if longest[f.name] else "CAST(NULL AS INT)"
        cells.append(f"struct({i + 1}L AS ordinal, {f.name} IS NULL AS empty, xxhash64({c}) AS d1, xxhash64(7, {c}) AS d2, {length} AS size)")
    exploded = frame.select(F.expr(f"inline(array({', '.join(cells)}))"))
    each = exploded.groupBy("ordinal", "empty", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    totals = each.groupBy("ordinal").agg(
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(~F.col("empty")).alias("distinct_values"),
        F.max("size").cast("bigint").alias("max_length"),
    )
    names = frame.sparkSession.range(1).select(rows_from(told, "ordinal, column_name, family, data_type, nullable"))
    joined = names.join(totals, "ordinal", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("nulls", "distinct_values")})
    return filled.select(*_PROFILE.split(", "))


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_holds_map(f.dataType) for f in dtype.fields)


def profile_tables(tables: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    """``column_profile`` of several tables, tagged with ``table_name``."""
    return _union(
        [column_profile(df, exact).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    )


def column_catalog(tables: Mapping[str, DataFrame], wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, filled): every column with its number of non-null cells.

    ``wanted`` picks columns by name before anything is counted, so that no other is read.
    """
    parts = []
    for table, df in tables.items():
        frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        chosen = [(i, c) for i, c in enumerate(df.columns) if wanted is None or wanted(c)]
        if not chosen:
            continue
        counted = frame.agg(*[F.expr(f"count(c{i}) AS c{i}") for i, _ in chosen])
        rows = [[literal(table), f"{i + 1}L", literal(c), f"c{i}"] for i, c in chosen]
        parts.append(counted.select(rows_from(rows, "table_name, ordinal, column_name, filled")))
    if not parts:
        spark = SparkSession.active()
        return spark.createDataFrame([], "table_name string, ordinal bigint, column_name string, filled bigint")
    return _union(parts)


# ---------------------------------------------------------- growing profiles

#: Buckets of a sketch as a power of two; the estimate's standard error is 1.04 / sqrt(2 ** this), here 0.8 %.
SKETCH_POWER = 14
_PLACE = ("table_name", "ordinal", "column_name", "family")


def profile_sketches(df: DataFrame, table: str) -> DataFrame:
    """One row per column with what a profile can be merged from: rows, nulls, longest text and a sketch of the values.

    One pass; a row of sketches per task moves.  Values other than whole numbers, texts and bytes count by their text.
    """
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    sums, rows = [], []
    for i, (name, f) in enumerate(zip(df.columns, frame.schema.fields)):
        c, kind = f.name, type_family(f.dataType)
        value = f"CAST({c} AS BIGINT)" if kind == "integer" else c if kind in ("text", "binary") else f"CAST({c} AS STRING)"
        if kind in ("array", "map", "struct") or isinstance(f.dataType, T.VariantType):
            value = f"to_json({c})"
        length = f"CAST(max(length({c})) AS BIGINT)" if kind == "text" else "CAST(NULL AS BIGINT)"
        sums += [f"count({c}) AS {c}_filled", f"{length} AS {c}_longest", f"hll_sketch_agg({value}, {SKETCH_POWER}) AS {c}_sketch"]
        rows.append([literal(table), f"{i + 1}L", literal(name), literal(kind), "n", f"n - {c}_filled", f"{c}_longest", f"{c}_sketch"])
    totals = frame.agg(F.count(F.lit(1)).alias("n"), *[F.expr(e) for e in sums])
    return totals.select(rows_from(rows, f"{', '.join(_PLACE)}, n_rows, nulls, max_length, sketch"))


def merge_sketches(parts: DataFrame) -> DataFrame:
    """The sketches of all parts of every column as those of the whole."""
    return parts.groupBy(*_PLACE).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.max("max_length").alias("max_length"), F.hll_union_agg("sketch").alias("sketch")
    )


def profile_of(sketches: DataFrame) -> DataFrame:
    """The profile that sketches stand for; distinct values are estimates."""
    return sketches.select(*_PLACE, "n_rows", "nulls", F.hll_sketch_estimate("sketch").alias("distinct_values"), "max_length")


def keep_profile(sketches: DataFrame, folder: str, part: str) -> None:
    """Keep the sketches of new files below ``folder`` as a part of their own; a part that is kept again is replaced."""
    sketches.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={part}")


def kept_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The merged sketches of all parts kept so far; no file but theirs is read."""
    return merge_sketches(spark.read.parquet(folder).drop("part"))
