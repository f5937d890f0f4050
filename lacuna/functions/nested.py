"""Apply a string expression to every string inside a (possibly nested) column.

Expressions are SQL text here: a table with many text columns then costs one
parsed expression per column instead of a tree of API calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

Rewrite = Callable[[str], str]


def name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` bound to ``value``, which is evaluated once however often it is used."""
    return f"transform(array({value}), {variable} -> {body})[0]"


def holds_text(dtype: T.DataType, nested: bool = True) -> bool:
    """True if a value of this type can contain a string cell."""
    if isinstance(dtype, T.StringType):
        return True
    if not nested:
        return False
    if isinstance(dtype, T.VariantType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(holds_text(f.dataType) for f in dtype.fields)
    return False


# A string literal of JSON text, with the colon behind it if it is a key.
JSON_STRING = literal(r'"(?:[^"\\]++|\\.)*+":?')


def variant_text(value: str, each: Callable[[str], str], result: Callable[[str, str, str], str]) -> str:
    """Walk the strings of a VARIANT of whatever shape and depth, in order, as those of its JSON text.

    ``each(text)`` is a struct of a field ``text`` and others.  ``result(json, new, found)`` gives the outcome from the JSON
    text, the one with the new strings, and an array with that struct as field ``v``, null for keys, which are not walked.  One
    pass, no recursion.
    """
    content = "from_json(concat('[', m, ']'), 'array<string>')[0]"
    seen = f"CASE WHEN NOT endswith(m, ':') THEN {let(content, 's', each('s'))} END"
    found = f"transform(regexp_extract_all(j, {JSON_STRING}, 0), m -> named_struct('raw', m, 'v', {seen}))"
    quoted = "CASE WHEN x.v IS NULL THEN x.raw ELSE substring(to_json(array(x.v.text)), 2, length(to_json(array(x.v.text))) - 2) END"
    joined = f"array_join(zip_with(split(j, {JSON_STRING}, -1), f, (gap, x) -> concat(gap, coalesce({quoted}, ''))), '')"
    return let(f"to_json({value})", "j", let(found, "f", let(joined, "w", result("j", "w", "f"))))


def map_text(value: str, dtype: T.DataType, fn: Rewrite, depth: int = 0, variant: Rewrite | None = None) -> str:
    """Rewrite every string in ``value``; map keys, other values and nulls pass through.

    ``variant`` rewrites a whole VARIANT; without it the strings inside are rewritten.
    """
    if not holds_text(dtype):
        return value
    x = f"x{depth}"
    if isinstance(dtype, T.VariantType):
        if variant is not None:
            return variant(value)
        changed = variant_text(value, lambda t: f"named_struct('text', {fn(t)})", lambda j, w, _: f"CASE WHEN {w} <=> {j} THEN {value} ELSE parse_json({w}) END")
        return changed
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {x} -> {map_text(x, dtype.elementType, fn, depth + 1, variant)})"
    if isinstance(dtype, T.MapType):
        return f"transform_values({value}, (k{depth}, {x}) -> {map_text(x, dtype.valueType, fn, depth + 1, variant)})"
    if isinstance(dtype, T.StructType):
        fields = ", ".join(
            f"{literal(f.name)}, {map_text(f'{value}.{name(f.name)}', f.dataType, fn, depth, variant)}" for f in dtype.fields
        )
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"
    return fn(value)


def sum_text(value: str, dtype: T.DataType, fn: Rewrite, depth: int = 0) -> str:
    """Add up a BIGINT expression over every string in ``value`` (0 when there is none)."""
    if not holds_text(dtype):
        return "0L"
    x = f"x{depth}"
    if isinstance(dtype, T.VariantType):
        return f"coalesce({fn(value)}, 0L)"
    if isinstance(dtype, T.ArrayType):
        inner = sum_text(x, dtype.elementType, fn, depth + 1)
        return f"coalesce(aggregate({value}, 0L, (total{depth}, {x}) -> total{depth} + {inner}), 0L)"
    if isinstance(dtype, T.MapType):
        return sum_text(f"map_values({value})", T.ArrayType(dtype.valueType), fn, depth)
    if isinstance(dtype, T.StructType):
        parts = (sum_text(f"{value}.{name(f.name)}", f.dataType, fn, depth) for f in dtype.fields)
        return "(" + " + ".join(p for p in parts if p != "0L") + ")"
    return f"coalesce({fn(value)}, 0L)"
