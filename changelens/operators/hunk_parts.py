"""Unified diffs whose files come in several parts.

The parts of a change set may be cut at any line, so one file's diff, and one
hunk, of any size is many rows and many tasks.  What a part cannot know by itself
is carried to it from the parts before: which file and which hunk its first lines
belong to, how many hunks the file and how many lines of each kind the hunk has
had, and the file's path.  Those are running totals over thin rows, one or two
for each piece of a file; texts are read twice and joined to their carries by
part, which no two rows share.

Files are numbered 0, 1, … in their change set.  The results are those of
``parse`` on the whole diffs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import paths
from changelens.functions.running import CHUNK_ROWS, running
from changelens.functions.sql import let, quote
from changelens.functions.text import all_matches, last
from changelens.operators import parse
from changelens.sources.tables import BROADCAST_BYTES, cut, drop_tables, lookup

_PIECE = ["change_id", "part_idx", "piece"]
_AT_HUNKS = f"split(segment, {quote(f'(?md)^(?={parse.HUNK})')}, -1)"
_IS_HUNK = f"rlike {quote(f'^{parse.HUNK}')}"
# A part may begin with a hunk, or with lines of the hunk before.
_HUNKS = f"filter({_AT_HUNKS}, h -> h {_IS_HUNK})"
_LEAD = f"if(segment {_IS_HUNK}, '', {_AT_HUNKS}[0])"


@dataclass(frozen=True)
class HunkParts:
    """``files``: a thin row for each file, as of ``parse.parse_files`` without
    its nested columns.  ``pieces``: ``change_id, file_idx, path, hunks``, some of
    a file's hunks in each row; a hunk in several parts is in several rows, the
    first of which has its header."""

    files: DataFrame
    pieces: DataFrame

    def hunks(self) -> DataFrame:
        return parse.hunks(self.pieces).where("header IS NOT NULL")

    def changes(self) -> DataFrame:
        return parse.changes(self.pieces)


def _segments(diffs: DataFrame, *more: str) -> DataFrame:
    """Pieces of files in each part: the rest of a file begun before, then a piece
    for each file that begins here."""
    split = f"split(diff_text, {quote('(?md)^(?=diff --git )')}, -1)"
    return diffs.selectExpr("change_id", "part_idx", *more, f"posexplode_outer({split}) AS (piece, segment)").where("segment <> ''")


def _counts(text: str) -> str:
    """Lines of a hunk's text by kind."""

    def those(mark: str) -> str:
        return f"cast(size(filter(lines, s -> startswith(s, '{mark}'))) as bigint)"

    counts = f"named_struct('plus', {those('+')}, 'minus', {those('-')}, 'both', {those(' ')})"
    return let("lines", f"filter(split({text}, '\\n', -1), s -> {parse.COUNTED})", counts)


def _described(diffs: DataFrame) -> DataFrame:
    """What a piece tells of its file, its first lines and its last hunk."""
    marks = quote(r"(?md)^(?:--- |\+\+\+ |Binary files |@@)[^\n]*")
    heads = _segments(diffs).selectExpr(
        *_PIECE,
        "startswith(segment, 'diff --git ') AS is_head",
        f"array_join(regexp_extract_all(segment, {marks}, 0), '\\n') AS marks",
        f"{_HUNKS} AS _pieces",
        f"{_LEAD} AS lead",
    )
    last_hunk = "try_element_at(_pieces, -1)"
    return heads.selectExpr(
        *_PIECE,
        "is_head",
        "cast(size(_pieces) as bigint) AS n_hunks",
        f"{parse._lines_with('+', '+++ ')} AS additions",
        f"{parse._lines_with('-', '--- ')} AS deletions",
        f"if(is_head, null, {_counts('lead')}) AS lead",
        f"if(size(_pieces) > 0, {parse.hunk_place(last_hunk)}, null) AS last_hunk",
        f"if(size(_pieces) > 0, {_counts(last_hunk)}, null) AS tail",
        f"{last(all_matches('marks', parse.NEW_LINE))} AS new_line",
        f"{last(all_matches('marks', rf'(?md){parse._NEW_PATH}', 1))} AS new_path",
        f"{last(all_matches('marks', rf'(?md){parse._OLD_PATH}', 1))} AS old_path",
        f"{last(all_matches('marks', parse.NULL_MARK, 1))} AS null_mark",
        f"{last(all_matches('marks', parse.ABOVE_NULL, 1))} AS above_null",
        f"marks rlike {quote(r'(?md)^\+\+\+ /dev/null$')} AS ends_null",
        f"marks rlike {quote(r'(?md)^Binary files ')} AS binary",
        f"marks rlike {quote(parse.WARNING)} AS parse_warning",
    )


def _last(value: str, condition: str) -> str:
    return f"max(if({condition}, named_struct('place', place, 'value', {value}), null)).value"


def parse_hunk_parts(diffs: DataFrame, limit: int = BROADCAST_BYTES, chunk_rows: int = CHUNK_ROWS) -> HunkParts:
    """Diff rows ``change_id, part_idx, diff_text`` that begin at any line.

    Lines above the first file of a change set belong to none and are left out,
    as is text without any; lines between a file's head and its first hunk tell
    its paths alone.
    """
    used: list[str] = []
    told = running(_described(diffs), ["change_id"], ["part_idx", "piece"], {"heads": "if(is_head, 1L, 0L)"}, paths=used, chunk_rows=chunk_rows)
    owned = told.withColumn("file", F.expr("heads + if(is_head, 1L, 0L)")).where("file > 0").drop("place", "heads")
    by_file = ["change_id", "file"]
    carried = cut(
        running(
            owned,
            by_file,
            ["part_idx", "piece"],
            {"hunks_before": "n_hunks"},
            {"old_before": ("old_path", "old_path IS NOT NULL")},
            used,
            chunk_rows,
        ).withColumn("lead", F.expr("if(hunks_before > 0, lead, null)")),
        "pieces",
        used,
    )
    # a hunk's fragments: the end of the piece with its head, then the first lines of pieces after it
    rest = carried.where("lead IS NOT NULL").selectExpr(
        *by_file, "part_idx", "piece", "hunks_before - 1 AS hunk", "0 AS head", "0L AS old", "0L AS new", "lead.*"
    )
    begun = carried.where("n_hunks > 0").selectExpr(
        *by_file, "part_idx", "piece", "hunks_before + n_hunks - 1 AS hunk", "1 AS head",
        "last_hunk.old_start AS old", "last_hunk.new_start AS new", "tail.*",
    )
    fragments = rest.unionByName(begun)
    leads = running(
        fragments,
        [*by_file, "hunk"],
        ["part_idx", "piece"],
        {
            "old_start": "old + minus + both",
            "new_start": "new + plus + both",
            "change_idx": "plus + minus + both",
        },
        paths=used,
        chunk_rows=chunk_rows,
    ).where("head = 0").selectExpr(
        *by_file, "part_idx", "piece", "named_struct('hunk', hunk, 'old_start', old_start, 'new_start', new_start, 'first', change_idx) AS open"
    )
    above = "coalesce(above_null, old_before.value)"
    whole = carried.groupBy(*by_file).agg(
        F.expr("sum(n_hunks) AS n_hunks"),
        F.expr("sum(additions + coalesce(lead.plus, 0L)) AS additions"),
        F.expr("sum(deletions + coalesce(lead.minus, 0L)) AS deletions"),
        F.expr("bool_or(binary) AS binary"),
        F.expr("bool_or(parse_warning) AS parse_warning"),
        F.expr(f"{_last('new_line', 'new_line IS NOT NULL')} AS new_line"),
        F.expr(f"{_last('new_path', 'new_path IS NOT NULL')} AS new_path"),
        F.expr(f"{_last('old_path', 'old_path IS NOT NULL')} AS old_path"),
        F.expr(f"{_last('null_mark', 'null_mark IS NOT NULL')} AS null_mark"),
        F.expr(f"{_last(above, f'ends_null AND {above} IS NOT NULL')} AS above_null"),
    ).where("n_hunks > 0")
    numbered = running(whole, ["change_id"], ["file"], {"file_idx": "1L"}, paths=used, chunk_rows=chunk_rows)
    files = cut(
        numbered.selectExpr(
            *by_file,
            "file_idx",
            "coalesce(if(new_line = '+++ /dev/null', above_null, new_path), '') AS path",
            "old_path",
            "CASE null_mark WHEN '---' THEN 'added' WHEN '+++' THEN 'deleted' ELSE 'modified' END AS status",
            f"{paths.language('new_path')} AS language",
            "binary",
            "additions",
            "deletions",
            "n_hunks",
            "parse_warning",
        ),
        "part-files",
    )
    # a file in many parts is dealt to several tasks
    places = lookup(
        carried.where("n_hunks > 0 OR lead IS NOT NULL").select(*by_file, "part_idx", "piece", "hunks_before"),
        files.select(*by_file, "file_idx", "path"),
        by_file,
        spread="part_idx",
        limit=limit,
    ).join(leads, [*by_file, "part_idx", "piece"], "left")
    # a part's list has an entry for each piece of its own text
    carries = cut(
        places.groupBy("change_id", "part_idx").agg(
            F.expr("collect_list(named_struct('piece', piece, 'own', named_struct('file_idx', file_idx, 'path', path,"
                   " 'hunks_before', hunks_before, 'open', open))) AS carry")
        ),
        "carries",
    )
    drop_tables(diffs.sparkSession, used)
    rows = lookup(diffs.select("change_id", "part_idx", "diff_text"), carries, ["change_id", "part_idx"], limit=limit)
    lines = f"filter(split(lead, '\\n', -1), s -> {parse.COUNTED})"
    at = "named_struct('old_start', open.old_start, 'new_start', open.new_start)"
    first_lines = (
        "named_struct('hunk_idx', open.hunk, 'old_start', open.old_start, 'old_lines', cast(null as bigint),"
        " 'new_start', open.new_start, 'new_lines', cast(null as bigint), 'header', cast(null as string), 'changes', "
        + let("at", at, let("lines", lines, parse.changes_sql("open.first")))
        + ")"
    )
    pieces = (
        _segments(rows, "map_from_arrays(carry.piece, carry.own) AS carry")
        .selectExpr("change_id", "carry[piece] AS own", "segment")
        .where("own IS NOT NULL")
        .selectExpr("change_id", "own.*", f"{_HUNKS} AS _pieces", f"{_LEAD} AS lead")
        .selectExpr(
            "change_id",
            "file_idx",
            "path",
            f"concat(if(open IS NULL, array(), array({first_lines})), transform(_pieces, (piece, n) -> {parse.hunk_sql('n + hunks_before')})) AS hunks",
        )
    )
    return HunkParts(files.drop("file"), pieces)
