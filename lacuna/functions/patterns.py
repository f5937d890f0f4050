r"""The text-pattern cascade: email, SSN, card, phone, IP.

A step sees the text the earlier steps left behind.  The whole cascade of a
cell is one native expression: no shuffle, no Python.  What keeps it fast:

* **Patterns that fail early.**  Each number pattern starts with a digit test
  and looks at its surroundings only afterwards, so nearly every position of a
  text costs one comparison.  Email has no such start and is gated by
  ``contains('@')``.
* **One gate for all number patterns.**  A text none of them can match is
  scanned once, not once per pattern.
* **Hits are counted only in cells that a step changed.**
* **Every value is bound once** (``let``).  Catalyst pushes a filter on a
  redacted column below the projection and copies the expression into it; an
  expression that repeated its input would double at every step.

Digits, letters and spaces are the Unicode ones.  Expressions are SQL text over
a named column or a lambda variable (see ``lacuna.functions.nested``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.nested import Rewrite, let, literal, map_text, name, sum_text, variant_text

# What counts as a hit. D is a decimal digit, WORD a word
# character and SPACE the whitespace characters, all in the Unicode sense.
D = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
# A look-behind steps over whole code points only if its text shows a character
# beyond the first plane; these two are members of their classes anyway.
WORD_BEHIND = WORD.replace("_", "_" + chr(0x10400))
D_BEHIND = f"[{D}{chr(0x1D7CE)}]"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
FIRST_DIGIT = rf"{D}(?<!{WORD_BEHIND}{D})"
EDGE = rf"(?:(?<={WORD_BEHIND})(?!{WORD})|(?<!{WORD_BEHIND})(?={WORD}))"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN = rf"{FIRST_DIGIT}{D}{{2}}-{D}{{2}}-{D}{{4}}(?!{WORD})"
CARD = rf"{FIRST_DIGIT}[ -]?(?:{D}[ -]?){{12,18}}{EDGE}"
PHONE = (
    rf"(?=[+({D}])(?<!{D_BEHIND})(?:\+?{D}{{1,2}}[{SPACE}.-]?)?"
    rf"\(?{D}{{3}}\)?[{SPACE}.-]?{D}{{3}}[{SPACE}.-]?{D}{{4}}(?!{D})"
)
IP = rf"{FIRST_DIGIT}{D}{{0,2}}(?:\.{D}{{1,3}}){{3}}(?!{WORD})"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    needs: str | None = None  # text without this has no hit
    core: str | None = None  # what must follow some digit of every hit
    accept: Callable[[str], str] | None = None  # SQL condition on a match, a second test

    @property
    def token(self) -> str:
        return f"[{self.name}]"


@cache
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and the ASCII digit each stands for."""
    found = [chr(i) for i in range(0x80, 0x20000) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(ch)) for ch in found)


def luhn_valid(candidate: str) -> str:
    """Luhn test on the digits of a card candidate."""
    digits = f"regexp_replace({candidate}, '[ -]', '')"
    foreign, plain = _decimal_digits()
    mapped = f"translate({digits}, '{foreign}', '{plain}')"
    return f"luhn_check(CASE WHEN {digits} RLIKE '[^0-9]' THEN {mapped} ELSE {digits} END)"


PATTERNS: Mapping[str, Pattern] = {
    p.name: p
    for p in (
        Pattern("email", EMAIL, needs="@"),
        Pattern("ssn", SSN, core=rf"-{D}{{2}}-{D}{{4}}"),
        Pattern("card", CARD, core=rf"(?:[ -]?{D}){{12}}", accept=luhn_valid),
        Pattern("phone", PHONE, core=rf"\)?[{SPACE}.-]?{D}{{3}}[{SPACE}.-]?{D}{{4}}"),
        Pattern("ip", IP, core=rf"(?:\.{D}{{1,3}}){{2}}\.{D}"),
    )
}


def replace_matches(text: str, regex: str, rewrite: Callable[[str], str]) -> str:
    """Replace each match of ``regex`` by ``rewrite(match)``, left to right.

    A match-dependent replacement from built-ins: the gaps between the matches
    and the rewritten matches are zipped back together.
    """
    swapped = f"transform(regexp_extract_all({text}, {regex}, 0), m -> {rewrite('m')})"
    joined = f"zip_with(split({text}, {regex}, -1), {swapped}, (gap, new) -> concat(gap, coalesce(new, '')))"
    return f"array_join({joined}, '')"


def scrub_sql(text: str, p: Pattern) -> str:
    regex, accept = literal(p.regex), p.accept
    if accept is not None:

        def rewrite(m: str) -> str:
            return f"CASE WHEN {accept(m)} THEN '{p.token}' ELSE {m} END"

        swapped = replace_matches("t", regex, rewrite)
        return let(text, "t", f"CASE WHEN t RLIKE {regex} THEN {swapped} ELSE t END")
    changed = f"regexp_replace({text}, {regex}, '{p.token}')"
    return f"CASE WHEN contains({text}, '{p.needs}') THEN {changed} ELSE {text} END" if p.needs else changed


def hits_sql(text: str, p: Pattern) -> str:
    regex, accept = literal(p.regex), p.accept
    if accept is not None:
        found = f"array_size(filter(regexp_extract_all({text}, {regex}, 0), m -> {accept('m')}))"
    else:
        found = f"regexp_count({text}, {regex})"
    if p.needs:
        found = f"CASE WHEN contains({text}, '{p.needs}') THEN {found} WHEN {text} IS NOT NULL THEN 0 END"
    return f"CAST({found} AS BIGINT)"


def step_sql(text: str, p: Pattern) -> str:
    """struct(text, hits) of one step."""
    found = f"named_struct('text', done, 'hits', CASE WHEN done <=> raw THEN 0L ELSE {hits_sql('raw', p)} END)"
    return let(text, "raw", let(scrub_sql("raw", p), "done", found))


def _split(steps: Sequence[Pattern]) -> tuple[list[Pattern], list[Pattern], str]:
    """Steps before the number patterns, the number patterns, and their common gate."""
    numbers = [p for p in steps if p.core is not None]
    gate = literal(rf"{D}(?:{'|'.join(p.core for p in numbers if p.core)})")
    return [p for p in steps if p.core is None], numbers, gate


def scrub_all_sql(text: str, steps: Sequence[Pattern]) -> str:
    """The cascade as one expression."""
    head, numbers, gate = _split(steps)
    for p in head:
        text = scrub_sql(text, p)
    if not numbers:
        return text
    chain = "x"
    for p in numbers:
        chain = scrub_sql(chain, p)
    return let(text, "x", f"CASE WHEN x RLIKE {gate} THEN {chain} ELSE x END")


def found_all_sql(text: str, steps: Sequence[Pattern]) -> str:
    """The cascade as one struct: the text and the hits of each pattern by name."""
    head, numbers, gate = _split(steps)

    def result(final: str, counted: Sequence[Pattern]) -> str:
        hits = {p.name: f"s_{p.name}.hits" if p in counted else "0L" for p in steps}
        return f"named_struct('text', {final}, {', '.join(f'{literal(n)}, {h}' for n, h in hits.items())})"

    def run(todo: list[Pattern], start: str, body: Callable[[str], str]) -> str:
        if not todo:
            return body(start)
        variable = f"s_{todo[0].name}"
        return let(step_sql(start, todo[0]), variable, run(todo[1:], f"{variable}.text", body))

    def gated(start: str) -> str:
        if not numbers:
            return result(start, head)
        hit = run(numbers, "x", lambda final: result(final, steps))
        return let(start, "x", f"CASE WHEN x RLIKE {gate} THEN {hit} ELSE {result('x', head)} END")

    return run(head, text, gated)


def found_variant_sql(value: str, steps: Sequence[Pattern]) -> str:
    """The cascade over all strings of a VARIANT as one struct: the VARIANT and the hits of each pattern by name."""
    sums = ", ".join(f"{literal(p.name)}, aggregate(f, 0L, (n, h) -> n + coalesce(h.v.{p.name}, 0L))" for p in steps)
    none = ", ".join(f"{literal(p.name)}, 0L" for p in steps)
    walked = variant_text(
        value,
        lambda t: found_all_sql(t, steps),
        lambda j, w, f: f"named_struct('text', CASE WHEN {w} <=> {j} THEN {value} ELSE parse_json({w}) END, {sums})",
    )
    return f"CASE WHEN {value} IS NULL THEN named_struct('text', {value}, {none}) ELSE {walked} END"


def scrub(column: str, p: Pattern) -> Column:
    """The column with the pattern's hits replaced by its token."""
    return F.expr(scrub_sql(name(column), p))


def hits(column: str, p: Pattern) -> Column:
    """How many hits ``scrub`` replaces (BIGINT, NULL for a NULL text)."""
    return F.expr(hits_sql(name(column), p))


def cascade(
    df: DataFrame,
    columns: Sequence[str],
    enabled: Sequence[str],
    counts: Callable[[str, str], str] | None = None,
    unless: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run the enabled patterns over ``columns``, in place.

    ``counts(column, pattern)`` names a BIGINT column to add with the hits of
    that cell.  ``unless[column]`` is an SQL condition under which the cell is
    left alone.  No shuffle, no Python.
    """
    steps = [PATTERNS[n] for n in PATTERNS if n in enabled]
    if not steps or not columns:
        return df
    dtypes = {c: df.schema[c].dataType for c in columns}

    def each(column: str, fn: Rewrite, kept: Rewrite, variant: Rewrite | None = None, variant_kept: Rewrite = str) -> Column:
        cell, dtype = name(column), dtypes[column]
        changed = map_text(cell, dtype, fn, variant=variant)
        skip = unless.get(column) if unless else None
        return F.expr(f"CASE WHEN {skip} THEN {map_text(cell, dtype, kept, variant=variant_kept)} ELSE {changed} END" if skip else changed)

    if counts is None:
        return df.withColumns({c: each(c, lambda t: scrub_all_sql(t, steps), str) for c in columns})
    # First every string, and every VARIANT as a whole, becomes its struct of text and hits, then those are taken apart.
    none = ", ".join(f"{literal(p.name)}, 0L" for p in steps)
    found = df.withColumns(
        {
            c: each(
                c,
                lambda t: found_all_sql(t, steps),
                lambda t: f"named_struct('text', {t}, {none})",
                lambda v: found_variant_sql(v, steps),
                lambda v: f"named_struct('text', {v}, {none})",
            )
            for c in columns
        }
    )
    taken: dict[str, Column] = {}
    for c in columns:
        taken[c] = F.expr(map_text(name(c), dtypes[c], lambda t: f"{t}.text", variant=lambda v: f"{v}.text"))
        for p in steps:
            taken[counts(c, p.name)] = F.expr(sum_text(name(c), dtypes[c], lambda t, p=p: f"{t}.{p.name}"))
    return found.withColumns(taken)
