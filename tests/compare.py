"""Compare a Spark result with its SQL oracle, column by name and row by row."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame


def normal(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    return value


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def spark_table(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(connection: Any, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), table(columns, cursor.fetchall())
