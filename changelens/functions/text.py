"""Text and number helpers as SQL text."""

from __future__ import annotations

import math
from fractions import Fraction

from changelens.functions.regex import JAVA_SPACE
from changelens.functions.sql import quote


def trim(text: str) -> str:
    """Strip every kind of white space at both ends."""
    return f"regexp_replace({text}, {quote(f'^[{JAVA_SPACE}]+|[{JAVA_SPACE}]+' + chr(92) + 'z')}, '')"


def is_blank(text: str) -> str:
    return f"NOT coalesce({text}, '') rlike {quote(f'[^{JAVA_SPACE}]')}"


def non_empty(text: str) -> str:
    return f"coalesce({text}, '') <> ''"


def round_half_up(number: str) -> str:
    return f"cast(floor({number} + 0.5D) as bigint)"


def _half_up_bounds() -> list[float]:
    """The smallest doubles that are not below 0.05, 0.15, … 0.95."""
    bounds = []
    for k in range(10):
        exact = Fraction(2 * k + 1, 20)
        near = float(exact)
        bounds.append(near if Fraction(near) >= exact else math.nextafter(near, 1.0))
    return bounds


def one_decimal(number: str) -> str:
    """One decimal, rounding the exact binary value half up; not for negative numbers.

    (Number formatting rounds the shortest decimal form instead, and would print
    1.45, which is really a bit less, as 1.5.)
    """
    steps = " + ".join(f"if({number} - floor({number}) >= {b!r}D, 1, 0)" for b in _half_up_bounds())
    n = f"(floor({number}) * 10 + {steps})"
    return f"concat({n} div 10, '.', {n} % 10)"


def first_match(text: str, pattern: str, group: int) -> str:
    """The group of the first match, null when there is none."""
    return f"if({text} rlike {quote(pattern)}, regexp_extract({text}, {quote(pattern)}, {group}), null)"


def all_matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)}, {group})"


def last(values: str) -> str:
    return f"try_element_at({values}, -1)"


def texts(*values: str) -> str:
    """An array of the given texts without the null ones, in order."""
    return f"array_compact(array({', '.join(values)}))"


def when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"
