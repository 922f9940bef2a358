"""Pattern dialects.

Patterns in :mod:`changelens.functions.fixed` are written once, in the
ECMAScript dialect.  ``java`` and ``re2`` restate the few escapes whose meaning
differs between engines, so that Spark (Java) and an RE2 checker agree with the
original meaning on every character:

* ``\\s`` includes Unicode spaces, ``.`` stops at CR, LF, LS and PS,
* ``\\b`` and ``\\w`` are ASCII, ``$`` is the very end of the text.
"""

from __future__ import annotations

from collections.abc import Iterable

_SPACE_POINTS = [0x00A0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]


def _space(point: str) -> str:
    wide = "".join(
        point.format(p) if isinstance(p, int) else f"{point.format(p[0])}-{point.format(p[1])}"
        for p in _SPACE_POINTS
    )
    return r"\t\x0B\f\r \n" + wide


SPACE_CHARS = "\t\x0b\f\r \n" + "".join(
    chr(p) for point in _SPACE_POINTS for p in ([point] if isinstance(point, int) else range(point[0], point[1] + 1))
)
JAVA_SPACE = _space(r"\u{:04x}")
RE2_SPACE = _space(r"\x{{{:04x}}}")
JAVA_LINE_CHAR = r"[^\n\r\u2028\u2029]"
RE2_LINE_CHAR = r"[^\n\r\x{2028}\x{2029}]"
_WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _restate(pattern: str, outside: dict[str, str], space: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif in_class or token not in outside:
            out.append(token)
        else:
            out.append(outside[token])
        if token in "[]":
            in_class = token == "["
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as Spark's regular-expression functions need it."""
    body = _restate(pattern, {r"\b": _WORD_EDGE, "$": r"\z", ".": JAVA_LINE_CHAR}, JAVA_SPACE)
    return f"(?i:{body})" if ignore_case else body


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as an RE2 engine needs it."""
    body = _restate(pattern, {"$": r"\z", ".": RE2_LINE_CHAR}, RE2_SPACE)
    return f"(?i:{body})" if ignore_case else body


def any_of(patterns: Iterable[str], dialect=java, ignore_case: bool = False) -> str:
    return "|".join(f"(?:{dialect(p, ignore_case)})" for p in patterns)


def glob(pattern: str) -> str:
    """A path glob as an anchored Java pattern.

    ``.`` is literal, ``*`` any run of characters (also across ``/``) and ``?``
    any one character; everything else keeps its regular-expression meaning.
    """
    table = {".": r"\.", "*": ".*", "?": "."}
    return java("^" + "".join(table.get(c, c) for c in pattern) + "$")
