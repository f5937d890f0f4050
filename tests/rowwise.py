"""A row-at-a-time oracle for the text cascade, in plain Python."""

from __future__ import annotations

import re

# The patterns in Python's dialect.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
SSN = re.compile(r"\b\d{3}-\d{2}-\d{4}\b")
CARD = re.compile(r"\b(?:\d[ -]?){13,19}\b")
PHONE = re.compile(r"(?<!\d)(?:\+?\d{1,2}[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\d)")
IP = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdecimal()]
    total = 0
    for place, digit in enumerate(reversed(digits)):
        total += sum(divmod(2 * digit, 10)) if place % 2 else digit
    return total % 10 == 0


def cascade(text: str, names=("email", "ssn", "card", "phone", "ip")) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(names, 0)
    for name, regex in (("email", EMAIL), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("ip", IP)):
        if name not in names:
            continue

        def swap(m: re.Match, name: str = name) -> str:
            if name == "card" and not luhn(m.group()):
                return m.group()
            counts[name] += 1
            return f"[{name}]"

        text = regex.sub(swap, text)
    return text, counts
