"""JSON-safe values for every Spark type, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.VariantType)


def _iso(c: Column) -> Column:
    """ISO date-time text: six fraction digits, or none when they are all zero."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def wire_value(c: Column, dtype: T.DataType) -> Column:
    """The JSON-safe form of one value; nulls stay null."""
    if isinstance(dtype, _PLAIN):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return _iso(c)
    if isinstance(dtype, T.TimestampType):
        # Count from the epoch so that the session time zone plays no part.
        utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.expr("INTERVAL '0.000001' SECOND") * F.unix_micros(c)
        return F.concat(_iso(utc), F.lit("+00:00"))
    if isinstance(dtype, T.DateType):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: wire_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        values = F.transform_values(c, lambda _, v: wire_value(v, dtype.valueType))
        if isinstance(dtype.keyType, T.StringType):
            return values
        return F.transform_keys(values, lambda k, _: k.cast("string"))
    if isinstance(dtype, T.StructType):
        cells = [wire_value(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*cells))
    return c.cast("string")


def wire(df: DataFrame) -> DataFrame:
    """Every column in its JSON-safe form; names stay, duplicates included."""
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return frame.select(
        *[wire_value(F.col(f.name), f.dataType).alias(name) for f, name in zip(frame.schema.fields, df.columns)]
    )


def json_text(*columns: Column) -> Column:
    """One JSON object from the given (aliased) columns, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def wire_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row; of columns with one name each is written, in order."""
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [wire_value(F.col(f.name), f.dataType).alias(c) for f, c in zip(frame.schema.fields, df.columns)]
    return frame.select(json_text(*cells).alias(name))
