"""Filters on parsed file rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import paths
from changelens.functions.rows import first_n
from changelens.functions.sql import let, sums_before
from changelens.operators.parse import additions_sql


def include(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Keep files whose path matches any glob; no globs keep all."""
    return files.where(paths.matches_glob(patterns)) if patterns else files


def exclude(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drop files whose path matches any glob."""
    return files.where(f"NOT {paths.matches_glob(patterns)}") if patterns else files


def cap_lines(files: DataFrame, max_lines: int) -> DataFrame:
    """Cut files with more than ``max_lines`` counted lines to their first lines.

    Context lines count towards the cut; the addition and deletion counters
    stay as they were.
    """
    if max_lines <= 0:
        return files
    fits = f"get(before, i) + size(h.changes) <= {max_lines}"
    some = f"get(before, i) < {max_lines}"
    part = (
        "named_struct('hunk_idx', h.hunk_idx, 'old_start', h.old_start, 'old_lines', h.old_lines,"
        " 'new_start', h.new_start, 'new_lines', h.new_lines, 'header', h.header,"
        f" 'changes', if({fits}, h.changes, slice(h.changes, 1, cast({max_lines} - get(before, i) as int))))"
    )
    cut = let(
        "before",
        sums_before("transform(hunks, h -> cast(size(h.changes) as bigint))"),
        f"array_compact(transform(hunks, (h, i) -> if({fits} OR {some}, {part}, null)))",
    )
    capped = files.selectExpr("*", f"if(additions + deletions > {max_lines}, {cut}, null) AS _cut")
    new = {
        "hunks": "coalesce(_cut, hunks)",
        "n_hunks": "cast(if(_cut IS NULL, n_hunks, size(_cut)) as bigint)",
        "added": f"if(_cut IS NULL, added, {additions_sql('_cut')})",
    }
    return capped.selectExpr(*[f"{new[c]} AS {c}" if c in new else c for c in files.columns])


def apply_filters(
    files: DataFrame,
    include_patterns: Sequence[str] = (),
    exclude_patterns: Sequence[str] = (),
    max_lines_per_file: int = 0,
) -> DataFrame:
    """Include globs, then exclude globs, then the line cap."""
    return cap_lines(exclude(include(files, include_patterns), exclude_patterns), max_lines_per_file)


def wanted_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files whose (change_id, path) is in the ``wanted`` table."""
    return files.join(wanted, ["change_id", "path"], "left_semi")


def contains_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (change_id, path) rows with ``contained``."""
    found = files.select("change_id", "path").distinct().withColumn("_hit", F.lit(True))
    return wanted.join(found, ["change_id", "path"], "left").select(
        "change_id", "path", F.coalesce("_hit", F.lit(False)).alias("contained")
    )


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    """The first file of that path in every change set that has one."""
    return first_n(files.where(F.col("path") == path), 1, ["change_id"], ["file_idx"]).drop("rank")
