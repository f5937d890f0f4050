"""Where personal data stands: one row per hit of the text patterns, with its place in the original text.

The cascade runs on a text of which every hit is covered by as many characters that no pattern takes, so that the places of
later patterns are those of the original.  A step gives its matches and the lengths of the gaps before them; running sums over
these are the offsets.  Only hits leave the scan, and no text but a digest of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.nested import let, literal, name
from lacuna.functions.patterns import PATTERNS, Pattern
from lacuna.policy import PatternToggles

#: Stands for a character of a hit.  It is neither letter, digit, space nor punctuation, so a pattern sees the edge of a word.
COVER = chr(0xE000)


def _matches(text: str, p: Pattern) -> str:
    """Array of (gap, hit, good) of a step: the characters before each match, the match, whether it counts."""
    regex = literal(p.regex)
    good = p.accept("hit") if p.accept else "true"
    pairs = f"zip_with(split({text}, {regex}, -1), regexp_extract_all({text}, {regex}, 0), (gap, hit) -> named_struct('gap', length(gap), 'hit', hit, 'good', {good}))"
    found = f"filter({pairs}, x -> x.hit IS NOT NULL)"
    return f"CASE WHEN {text} RLIKE {regex} THEN {found} ELSE {_NONE} END"


_NONE = "CAST(array() AS array<struct<gap:int,hit:string,good:boolean>>)"


def _covered(text: str, p: Pattern, found: str) -> str:
    """The text with the counted matches covered."""
    regex = literal(p.regex)
    new = f"transform({found}, x -> CASE WHEN x.good THEN repeat('{COVER}', length(x.hit)) ELSE x.hit END)"
    joined = f"array_join(zip_with(split({text}, {regex}, -1), {new}, (gap, hit) -> concat(gap, coalesce(hit, ''))), '')"
    return f"CASE WHEN size({found}) > 0 THEN {joined} ELSE {text} END"


def _steps(text: str, steps: Sequence[Pattern]) -> str:
    """Array of (pattern, matches) of the cascade over one text."""

    def run(todo: Sequence[Pattern], start: str, seen: list[str]) -> str:
        if not todo:
            return f"array({', '.join(seen)})"
        p = todo[0]
        variable = f"f_{p.name}"
        seen = [*seen, f"named_struct('pattern', '{p.name}', 'matches', {variable})"]
        rest = let(_covered("t", p, variable), "t", run(todo[1:], "t", seen)) if len(todo) > 1 else run((), "", seen)
        return let(_matches("t", p), variable, rest)

    return let(text, "t", run(steps, "t", []))


def findings(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, patterns: PatternToggles | None = None, salt: str = ""
) -> DataFrame:
    """``key``, column_name, pattern, start, stop and digest of every hit.

    ``start`` and ``stop`` count characters of the original text from 0; ``digest`` is SHA-256 of the salt and the hit.  The
    hits are those that the cascade replaces: cutting the spans out and putting ``[pattern]`` in gives its text.  All
    top-level text columns are searched unless ``columns`` names some.  ``key`` tells the rows apart for the reader only;
    equal keys are kept apart.  Only hits are shuffled, to the other hits of their pattern and cell.
    """
    steps = [PATTERNS[n] for n in PATTERNS if n in (patterns or PatternToggles.all()).enabled()]
    names = list(df.columns)
    searched = [(i, n) for i, n in enumerate(names) if isinstance(df.schema.fields[i].dataType, T.StringType) and (columns is None or n in columns)]
    at = [names.index(k) for k in key]
    frame = df.toDF(*[f"c{i}" for i in range(len(names))])
    if not searched or not steps:
        empty = "column_name string, pattern string, start bigint, stop bigint, digest string"
        return df.select(*key).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in empty.split(", ")}).limit(0)
    cells = [f"named_struct('column_name', {literal(n)}, 'found', {_steps(f'c{i}', steps)})" for i, n in searched]
    row = frame.select(F.monotonically_increasing_id().alias("row"), *[f"c{i}" for i in sorted({*at, *[i for i, _ in searched]})])
    some = row.select("row", *[f"c{i}" for i in dict.fromkeys(at)], F.explode(F.expr(f"array({', '.join(cells)})")).alias("cell"))
    some = some.select("*", F.explode("cell.found").alias("step"))
    hits = some.select("row", *[f"c{i}" for i in dict.fromkeys(at)], "cell.column_name", "step.pattern", F.posexplode("step.matches").alias("place", "m"))
    before = Window.partitionBy("row", "column_name", "pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.hit")
    stop = F.sum(F.col("m.gap") + size).over(before)
    told = hits.withColumn("stop", stop.cast("bigint")).withColumn("start", F.col("stop") - size).where("m.good")
    return told.select(*[F.col(f"c{i}").alias(k) for i, k in zip(at, key)], "column_name", "pattern", "start", "stop", F.sha2(F.concat(F.lit(salt), F.col("m.hit")), 256).alias("digest"))


def cut(text: str, spans: str) -> str:
    """SQL for a text with its spans, an array of (start, stop, pattern), each replaced by ``[pattern]``."""
    ordered = f"array_sort({spans})"
    pieces = f"transform(s, (x, i) -> concat(substring({name(text)}, CASE WHEN i = 0 THEN 1 ELSE s[i - 1].stop + 1 END, x.start - CASE WHEN i = 0 THEN 0 ELSE s[i - 1].stop END), '[', x.pattern, ']'))"
    rest = f"substring({name(text)}, s[size(s) - 1].stop + 1)"
    return f"CASE WHEN {spans} IS NULL OR size({spans}) = 0 THEN {name(text)} ELSE {let(ordered, 's', f'concat(array_join({pieces}, {literal(str())}), {rest})')} END"
