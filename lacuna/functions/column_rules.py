"""Column strategies as native expressions: mask, null, hash, partial."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK_TOKEN = "[redacted]"
HASH_PREFIX = "sha256:"


def mask(c: Column) -> Column:
    """A fixed token for every non-null cell."""
    return F.when(c.isNotNull(), F.lit(MASK_TOKEN))


def nullify(dtype: T.DataType) -> Column:
    """NULL, keeping the column's type."""
    return F.lit(None).cast(dtype)


def hash_token(c: Column, salt: str = "", digits: int = 12) -> Column:
    """Prefix + leading hex digits of SHA-256(salt, text): equal cells stay equal."""
    digest = F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)
    return F.concat(F.lit(HASH_PREFIX), F.substring(digest, 1, digits))


def partial(c: Column, keep: int | Column = 4) -> Column:
    """Stars for all but the last ``keep`` characters; all stars when there are no more than that."""
    text = c.cast("string")
    size = F.length(text)
    shown = F.greatest(keep if isinstance(keep, Column) else F.lit(keep), F.lit(0))
    hidden = F.when(size > shown, size - shown).otherwise(size)
    tail = F.when(size > shown, F.right(text, shown)).otherwise(F.lit(""))
    return F.concat(F.repeat(F.lit("*"), hidden), tail)


def apply_strategy(
    c: Column, dtype: T.DataType, strategy: str, keep: int = 4, salt: str = "", digits: int = 12
) -> Column:
    if strategy == "mask":
        return mask(c)
    if strategy == "null":
        return nullify(dtype)
    if strategy == "hash":
        return hash_token(c, salt, digits)
    if strategy == "partial":
        return partial(c, keep)
    raise ValueError(f"unknown strategy {strategy!r}")
