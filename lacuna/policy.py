"""Policies: what to redact, what a governed read may return, and per-source overrides.

Policies are small driver-side values.  Everything that touches rows is an
expression built from them (``lacuna.functions``) or a DataFrame transform
(``lacuna.operators``).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

STRATEGIES = ("mask", "null", "hash", "partial")


@dataclass(frozen=True)
class ColumnRule:
    """Redact every output column with this name (compared without case)."""

    column: str
    strategy: str = "mask"
    keep: int = 4

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; use one of {', '.join(STRATEGIES)}")


@dataclass(frozen=True)
class PatternToggles:
    """Which text patterns are on.  ``ip`` is opt-in."""

    email: bool = True
    ssn: bool = True
    card: bool = True
    phone: bool = True
    ip: bool = False

    def enabled(self) -> tuple[str, ...]:
        """Names of the active patterns in cascade order."""
        return tuple(f.name for f in fields(self) if getattr(self, f.name))

    @classmethod
    def all(cls) -> PatternToggles:
        return cls(ip=True)

    @classmethod
    def only(cls, *names: str) -> PatternToggles:
        known = {f.name for f in fields(cls)}
        if set(names) - known:
            raise ValueError(f"unknown patterns: {sorted(set(names) - known)}")
        return cls(**{n: n in names for n in known})


@dataclass(frozen=True)
class RedactPolicy:
    """Column rules, text patterns and an optional free-text backstop.

    ``rescan_hashed``  also runs the patterns over hash tokens.  Off by default:
                       a run of digits in a token can look like a phone number,
                       and rewriting it would break joins on the token.
    ``nested``         also scans strings inside arrays, structs and map values.
    ``free_text``      a column transform from ``lacuna.operators.detect`` that
                       runs on text the patterns have already scrubbed.
    """

    rules: tuple[ColumnRule, ...] = ()
    patterns: PatternToggles = field(default_factory=PatternToggles)
    salt: str = ""
    digits: int = 12
    rescan_hashed: bool = False
    nested: bool = True
    free_text: Callable[..., Any] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(self.rules))
        if not 1 <= self.digits <= 64:
            raise ValueError("digits must be between 1 and 64")

    def rule_for(self, column: str) -> ColumnRule | None:
        """The last rule with this name, or None."""
        wanted = column.lower()
        return next((r for r in reversed(self.rules) if r.column.lower() == wanted), None)

    def warn_if_guessable(self) -> None:
        if not self.salt and any(r.strategy == "hash" for r in self.rules):
            warnings.warn("hash rules without a salt can be reversed with a dictionary", stacklevel=3)


@dataclass(frozen=True)
class ReadPolicy:
    """Limits for governed reads and for query-text screening."""

    allow_star: bool = False
    pii_tables: tuple[str, ...] = ()
    max_rows: int = 1000

    def __post_init__(self) -> None:
        object.__setattr__(self, "pii_tables", tuple(self.pii_tables))
        if self.max_rows < 0:
            raise ValueError("max_rows must not be negative")

    def is_pii(self, table: str) -> bool:
        bare = table.rsplit(".", 1)[-1].lower()
        return bare in {t.lower() for t in self.pii_tables}


@dataclass(frozen=True)
class Governance:
    """Shared policies plus per-source overrides, merged field by field.

    ``overrides = {"prod": {"read": {"max_rows": 50}}}`` changes one limit for
    ``prod`` and keeps every other shared setting, PII tables included.
    """

    read: ReadPolicy = field(default_factory=ReadPolicy)
    redact: RedactPolicy = field(default_factory=RedactPolicy)
    overrides: Mapping[str, Mapping[str, Mapping[str, Any]]] = field(default_factory=dict)

    def for_source(self, source: str, known: Iterable[str] | None = None) -> tuple[ReadPolicy, RedactPolicy]:
        if known is not None and source not in set(known):
            raise KeyError(f"unknown source {source!r}; registered: {', '.join(sorted(known))}")
        change = self.overrides.get(source, {})
        return replace(self.read, **change.get("read", {})), replace(self.redact, **change.get("redact", {}))
