"""Column names that no input has yet."""

from __future__ import annotations

from collections.abc import Iterable


def unused(wanted: str, *taken: Iterable[str]) -> str:
    """``wanted``, with underscores behind it until none of the ``taken`` names is equal without case."""
    known = {n.lower() for names in taken for n in names}
    while wanted.lower() in known:
        wanted += "_"
    return wanted
