"""Unified diffs to file, hunk and line rows.

Parsing is row-local: a diff row is split into files, and every file row holds
its hunks and lines as nested arrays.  No step shuffles or sorts, whatever the
size of a change set.  Flat hunk and line tables are plain explodes.

Rules kept on purpose:

* a line is classified by its prefix alone, so a deleted line that starts with
  ``-- `` (in the diff: ``--- ``) or an added one that starts with ``++ `` is
  taken for a path line and is neither counted nor numbered;
* empty lines are skipped;
* only files with at least one hunk are emitted;
* a malformed ``@@`` line is ignored and reported in ``parse_warning``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from changelens.functions import paths
from changelens.functions.regex import JAVA_LINE_CHAR
from changelens.functions.rows import FILES_PER_PART, each, each_with_position
from changelens.functions.running import running
from changelens.functions.sql import let, quote, sums_before
from changelens.functions.text import all_matches, last
from changelens.sources.tables import BROADCAST_BYTES, cut, lookup

FILE_KEY = ["change_id", "file_idx"]

HUNK = r"@@ -[0-9]+,?[0-9]* \+[0-9]+,?[0-9]* @@"
_HUNK_PARTS = r"^@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@"
COUNTED = (
    "(startswith(s, '+') AND NOT startswith(s, '+++ ')) OR (startswith(s, '-') AND NOT startswith(s, '--- '))"
    " OR startswith(s, ' ')"
)
_OLD_PATH = rf"^--- a/({JAVA_LINE_CHAR}+)$"
_NEW_PATH = rf"^\+\+\+ b/({JAVA_LINE_CHAR}+)$"
# What path lines tell of a file; of several the last counts.
NEW_LINE = rf"(?md)^\+\+\+ (?:b/{JAVA_LINE_CHAR}+|/dev/null)$"
NULL_MARK = r"(?md)^(---|\+\+\+) /dev/null$"
ABOVE_NULL = rf"(?md){_OLD_PATH}(?=[\s\S]*^\+\+\+ /dev/null$)"
WARNING = rf"(?md)^@@(?!{HUNK[2:]})"


def split_files(diffs: DataFrame) -> DataFrame:
    """One row per emitted file: the diff row's columns plus ``file_idx, segment, marks``.

    ``file_idx`` orders a change set's files and is unique where ``part_idx`` is.
    It is the dense number 0, 1, … where the rows come from ``number_parts``; the
    default needs no second pass.

    ``marks`` holds the path, binary and hunk lines alone: one pass over the
    text finds them, and all that is read off them later works on a short text.
    Both come out of a generator, so no filter on something derived from them
    can be pushed below and repeat the pass.
    """
    pieces = f"split(diff_text, {quote('(?md)^(?=diff --git )')}, -1)"
    marked = (
        "transform(filter({pieces}, s -> startswith(s, 'diff --git ')), s -> named_struct('segment', s,"
        " 'marks', array_join(regexp_extract_all(s, {marks}, 0), '\\n')))"
    ).format(pieces=pieces, marks=quote(r"(?md)^(?:--- |\+\+\+ |Binary files |@@)[^\n]*"))
    emitted = f"filter({marked}, f -> f.marks rlike {quote(f'(?md)^{HUNK}')})"
    if "part_idx" not in diffs.columns:
        raise ValueError("diffs need a part_idx, unique for each change set")
    part = "coalesce(cast(part_idx as bigint), raise_error('a part_idx is null'))"
    keep = [c for c in diffs.columns if c not in ("diff_text", "part_idx", "file_offset")]
    first = "file_offset" if "file_offset" in diffs.columns else f"{part} * {FILES_PER_PART}L"
    rows = each_with_position(diffs, [*keep, f"{first} AS _first"], emitted, "_pos", "_f")
    return rows.selectExpr(*keep, "_first + _pos AS file_idx", "_f.segment AS segment", "_f.marks AS marks")


def number_parts(diffs: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``file_offset``, the files of the change set in the parts before, so
    that files are numbered 0, 1, … without a gap.

    A first pass counts each part's files; running totals over the parts are
    joined back by part, which no two rows share.
    """
    pieces = f"filter(split(diff_text, {quote('(?md)^(?=diff --git )')}, -1), s -> startswith(s, 'diff --git ') AND s rlike {quote(f'(?md)^{HUNK}')})"
    counts = diffs.selectExpr("change_id", "part_idx", f"cast(size({pieces}) as bigint) AS n_files").where("n_files > 0")
    offsets = cut(running(counts, ["change_id"], ["part_idx"], {"file_offset": "n_files"}).select("change_id", "part_idx", "file_offset"), "file-offsets")
    return lookup(diffs, offsets, ["change_id", "part_idx"], limit=limit)


def parse_files(diffs: DataFrame) -> DataFrame:
    """One row per file, in the order of ``file_idx``.

    Columns: the keys and extra columns of the diff rows, ``file_idx, path,
    old_path, status, language, binary, additions, deletions, n_hunks,
    parse_warning, hunks, added``.  ``hunks`` is ARRAY of (hunk_idx, old_start,
    old_lines, new_start, new_lines, header, changes) with changes ARRAY of
    (change_idx, line_number, old_line_number, type, content); ``added`` is the
    additions across hunks in order, ARRAY of (line_number, content).  Columns
    that are not used cost nothing.
    """
    files = split_files(diffs)
    keep = [c for c in files.columns if c not in ("segment", "marks")]
    new_path = last(all_matches("marks", rf"(?md){_NEW_PATH}", 1))
    new_line = last(all_matches("marks", NEW_LINE))
    null_mark = last(all_matches("marks", NULL_MARK, 1))
    # A deleted file is named by the last old path above its "+++ /dev/null".
    above_null = last(all_matches("marks", ABOVE_NULL, 1))
    pieces = f"split(segment, {quote(f'(?md)^(?={HUNK})')}, -1)"
    return files.selectExpr(
        *keep,
        f"coalesce(if({new_line} = '+++ /dev/null', {above_null}, {new_path}), '') AS path",
        f"{last(all_matches('marks', rf'(?md){_OLD_PATH}', 1))} AS old_path",
        f"CASE {null_mark} WHEN '---' THEN 'added' WHEN '+++' THEN 'deleted' ELSE 'modified' END AS status",
        f"{paths.language(new_path)} AS language",
        f"marks rlike {quote(r'(?md)^Binary files ')} AS binary",
        f"cast(regexp_count(marks, {quote(f'(?md)^{HUNK}')}) as bigint) AS n_hunks",
        f"marks rlike {quote(WARNING)} AS parse_warning",
        f"slice({pieces}, 2, n_hunks) AS _pieces",
    ).selectExpr(
        *keep,
        *("path", "old_path", "status", "language", "binary"),
        f"{_lines_with('+', '+++ ')} AS additions",
        f"{_lines_with('-', '--- ')} AS deletions",
        *("n_hunks", "parse_warning"),
        f"transform(_pieces, (piece, n) -> {hunk_sql()}) AS hunks",
    ).selectExpr("*", f"{additions_sql()} AS added")


def _lines_with(mark: str, but_not: str) -> str:
    """How many lines of the hunks start with a mark, by what their removal takes away.

    A hunk piece starts with its header line, so every such line follows a line end.
    """

    def occurrences(text: str) -> str:
        needle = f"'\\n{text}'"
        return f"(octet_length(piece) - octet_length(replace(piece, {needle}, ''))) div {1 + len(text)}"

    counts = f"transform(_pieces, piece -> {occurrences(mark)} - {occurrences(but_not)})"
    return f"aggregate({counts}, 0L, (acc, x) -> acc + x)"


def hunk_place(header: str = "header") -> str:
    """The four numbers of a hunk's header; counts left out are 1."""

    def number(group: int) -> str:
        digits = f"regexp_extract({header}, {quote(_HUNK_PARTS)}, {group})"
        return f"CASE WHEN {digits} = '' THEN 1L ELSE try_cast({digits} as bigint) END"

    return (
        f"named_struct('old_start', {number(1)}, 'old_lines', {number(2)},"
        f" 'new_start', {number(3)}, 'new_lines', {number(4)})"
    )


def hunk_sql(number_: str = "n") -> str:
    """A hunk piece (lambda variables ``piece``, ``n``) as a struct, under a number."""

    hunk = (
        f"named_struct('hunk_idx', cast({number_} as bigint), 'old_start', at.old_start, 'old_lines', at.old_lines,"
        f" 'new_start', at.new_start, 'new_lines', at.new_lines, 'header', header, 'changes', {changes_sql()})"
    )
    lines = f"filter(split(piece, '\\n', -1), s -> {COUNTED})"
    return let("header", "substring_index(piece, '\\n', 1)", let("at", hunk_place(), let("lines", lines, hunk)))


def changes_sql(first: str = "0L") -> str:
    """Numbered lines, from the counts of additions and deletions above each line;
    the first has the number ``first``."""

    def above(mark: str) -> str:
        return sums_before(f"transform(lines, s -> if(startswith(s, '{mark}'), 1L, 0L))")

    change = (
        f"named_struct('change_idx', i + {first},"
        " 'line_number', at.new_start + i - get(deleted_above, i),"
        " 'old_line_number', if(startswith(s, '+'), null, at.old_start + i - get(added_above, i)),"
        " 'type', CASE WHEN startswith(s, '+') THEN 'addition' WHEN startswith(s, '-') THEN 'deletion'"
        " ELSE 'context' END,"
        " 'content', substring(s, 2))"
    )
    return let(
        "added_above", above("+"), let("deleted_above", above("-"), f"transform(lines, (s, i) -> {change})")
    )


def hunks(files: DataFrame) -> DataFrame:
    """Flat hunk rows, keyed by change_id, file_idx, hunk_idx."""
    columns = ("hunk_idx", "old_start", "old_lines", "new_start", "new_lines", "header")
    return each(files, [*FILE_KEY, "path"], "hunks", "_h").selectExpr(
        *FILE_KEY, "path", *[f"_h.{c} AS {c}" for c in columns]
    )


def changes(files: DataFrame) -> DataFrame:
    """Flat line rows, keyed by change_id, file_idx, hunk_idx, change_idx."""
    by_hunk = each(files, [*FILE_KEY, "path"], "hunks", "_h")
    columns = ("change_idx", "line_number", "old_line_number", "type", "content")
    return each(by_hunk, [*FILE_KEY, "path", "_h.hunk_idx AS hunk_idx"], "_h.changes", "_c").selectExpr(
        *FILE_KEY, "path", "hunk_idx", *[f"_c.{c} AS {c}" for c in columns]
    )


def added_lines(files: DataFrame) -> DataFrame:
    """Contents of all additions, in order of the keys."""
    return _lines_of(files, "addition")


def deleted_lines(files: DataFrame) -> DataFrame:
    """Contents of all deletions, in order of the keys."""
    return _lines_of(files, "deletion")


def _lines_of(files: DataFrame, kind: str) -> DataFrame:
    rows = changes(files).where(f"type = '{kind}'")
    return rows.select(*FILE_KEY, "path", "hunk_idx", "change_idx", "line_number", "content")


def additions_sql(hunks: str = "hunks") -> str:
    """The additions across an array of hunks, in order, as (line_number, content)."""
    per_hunk = (
        "transform(filter(h.changes, c -> c.type = 'addition'),"
        " c -> named_struct('line_number', c.line_number, 'content', c.content))"
    )
    return f"flatten(transform({hunks}, h -> {per_hunk}))"
