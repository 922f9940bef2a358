"""Small pieces of Spark SQL text for nested array expressions.

Deeply nested lambdas are written as SQL text: it reads better than chained
column calls and the session parses it in one go.
"""

from __future__ import annotations

from collections.abc import Iterable

_BLOCK = 64


def quote(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def either(conditions: Iterable[str]) -> str:
    return "(" + (" OR ".join(conditions) or "false") + ")"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it by ``name`` many times in ``body``.

    Inside a lambda an outer expression would be evaluated again for every
    element; a one-element array turns it into a lambda variable instead.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(values: str) -> str:
    """Running sums of a short array, with a leading zero."""
    return f"aggregate({values}, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"


def sums_before(values: str) -> str:
    """For each element of a BIGINT array, the sum of the elements before it.

    Two levels (within blocks, then over block totals) keep the work close to
    linear for arrays of any length.
    """
    blocks = (
        f"transform(sequence(0, cast(floor((size(sv) - 1) / {_BLOCK}) as int)),"
        f" b -> {_running(f'slice(sv, b * {_BLOCK} + 1, {_BLOCK})')})"
    )
    shifted = "transform(slice(blk, 1, size(blk) - 1), x -> x + get(base, i))"
    long = let(
        "blocks",
        blocks,
        let(
            "base",
            _running("transform(blocks, blk -> element_at(blk, -1))"),
            f"flatten(transform(blocks, (blk, i) -> {shifted}))",
        ),
    )
    short = f"slice({_running('sv')}, 1, size(sv))"
    return let("sv", values, f"CASE WHEN size(sv) <= {_BLOCK} THEN {short} ELSE {long} END")
