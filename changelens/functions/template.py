"""Filling of prompt templates.

A template is cut up once on the driver into literal pieces, so text that is
put in is never looked at again.
"""

from __future__ import annotations

import re

from changelens.functions.sql import quote
from changelens.functions.text import non_empty

_PART = re.compile(r"\{\{#if\s+(\w+)\}\}(.*?)\{\{/if\}\}|\{\{(\w+)\}\}", re.S)


def number_text(number: str) -> str:
    """A number as a template value; zero prints as nothing."""
    return f"if({number} = 0, '', cast({number} as string))"


def fill(template: str, values: dict[str, str]) -> str:
    """SQL text of the template with ``{{name}}`` put in and ``{{#if name}}…{{/if}}``
    kept only where the value is not empty."""
    parts: list[str] = []
    at = 0
    for m in _PART.finditer(template):
        parts.append(quote(template[at : m.start()]))
        condition, block, name = m.groups()
        if condition:
            value = values.get(condition, "''")
            parts.append(f"if({non_empty(value)}, {fill(block, values)}, '')")
        else:
            parts.append(f"coalesce({values.get(name, quote(''))}, '')")
        at = m.end()
    return f"concat({', '.join([*parts, quote(template[at:])])})"


def around(template: str, name: str) -> tuple[str, str]:
    """The template before and after one placeholder."""
    before, after = template.split("{{" + name + "}}", 1)
    return before, after
