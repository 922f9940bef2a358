"""Diff tables.

A row of a diff table is a piece of one change set's unified diff:

``change_id, part_idx, source_kind, base_branch, diff_text``

A change set may come as one row or as many; every row starts at a file
boundary and ``part_idx`` orders the rows.  Large change sets should come in
many rows, because one row is parsed by one task.

``part_idx`` must be there, and be unique for each change set and source: files
are numbered by it.  ``part_faults`` lists rows that break this, and
``choose_source`` stops on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import is_blank
from changelens.sources.tables import BROADCAST_BYTES, cut

SOURCE_KINDS = ("staged", "worktree", "branch")
PART_KEY = ["change_id", "source_kind", "part_idx"]
FILE_MARK = "diff --git "
HUNK_MARK = "@@ "


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of diffs."""
    return spark.read.parquet(path)


def write_diffs(diffs: DataFrame, table: str, buckets: int) -> None:
    """Write a diff table of the catalog, bucketed by part: joins by part, such
    as the choice of sources, then leave the texts where they are."""
    diffs.write.bucketBy(buckets, *PART_KEY).sortBy(*PART_KEY).format("parquet").saveAsTable(table)


def read_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of ``*.diff`` files, one change set per file and one part per
    file in it, so a large diff is read by several tasks.

    The reader cuts at ``diff --git`` lines.  A part's number is the place of its
    split in the file plus its place in the task; a split has more bytes than
    rows, and only the last of a file shares a task, so numbers are unique and in
    order.
    """
    parts = _cut_at(spark, path, FILE_MARK)
    return parts.where(F.col("diff_text") != FILE_MARK)


def read_diff_hunks(spark: SparkSession, path: str) -> DataFrame:
    """The same cut at hunk heads, a part for each hunk, so that one file's diff
    of any size is read by several tasks; for ``hunk_parts.parse_hunk_parts``.
    A file's head stands at the end of the part before its first hunk."""
    return _cut_at(spark, path, HUNK_MARK)


def _cut_at(spark: SparkSession, path: str, mark: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n" + mark).text(path)
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    starts = F.startswith("value", F.lit(FILE_MARK)) | F.startswith("value", F.lit(mark))
    return rows.select(
        F.col("_metadata.file_path").alias("change_id"),
        (F.col("_metadata.file_block_start") + in_task).alias("part_idx"),
        F.lit("branch").alias("source_kind"),
        F.lit(None).cast("string").alias("base_branch"),
        F.when(starts, F.col("value")).otherwise(F.concat(F.lit(mark), "value")).alias("diff_text"),
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of source files as ``path, text`` rows for the content scan."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def part_faults(diffs: DataFrame) -> DataFrame:
    """Keys that number no file or more than one row: ``change_id, source_kind,
    part_idx, n_rows``."""
    counts = diffs.groupBy(*PART_KEY).agg(F.count("*").alias("n_rows"))
    return counts.where("n_rows > 1 OR part_idx IS NULL")


def choose_source(diffs: DataFrame, staged_only: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Keep, per change set, the rows of its first source that is not blank.

    Sources rank staged, worktree, branch.  Blank rows are dropped, so a change
    set without any text disappears.  A part number that is null or repeated is
    an error.

    One pass over the table leaves a thin one of keys; the choice is made on it,
    and a second pass takes the texts of the chosen sources.  As long as the
    choices are small they are sent to the executors and no text is moved.
    Beyond ``limit`` bytes texts are joined by part, so no task gets a change set
    whole, and a table bucketed by part (``write_diffs``) stays where it is.
    Rows without a change id are one change set, read by a pass of their own.
    """
    if "part_idx" not in diffs.columns:
        raise ValueError("diffs need a part_idx, unique for each change set and source")
    kinds = SOURCE_KINDS[:1] if staged_only else SOURCE_KINDS
    rows = diffs.where(F.col("source_kind").isin(*kinds)).where(f"NOT ({is_blank('diff_text')})")
    every = F.array(*[F.lit(k) for k in SOURCE_KINDS])
    rank = F.array_position(every, F.col("source_kind"))
    parts = cut(rows.groupBy(*PART_KEY).agg(F.count("*").alias("n")).withColumn("rank", rank), "diff-keys")
    bad = F.when((F.col("n") > 1) | F.col("part_idx").isNull(), F.col("rank"))
    best = parts.groupBy("change_id").agg(
        F.element_at(every, F.min("rank").cast("int")).alias("source_kind"), (F.min(bad) == F.min("rank")).alias("bad")
    )
    seen = best.agg(
        F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes"),
        F.min(F.when(F.col("bad"), F.coalesce(F.col("change_id").cast("string"), F.lit("null")))).alias("bad"),
        F.max(F.when(F.col("change_id").isNull(), F.col("source_kind"))).alias("nameless"),
    ).first()
    if seen["bad"] is not None:
        raise ValueError(f"a part_idx of change set {seen['bad']} is null or not unique")
    named = best.where("change_id IS NOT NULL").select("change_id", "source_kind")
    if (seen["bytes"] or 0) <= limit:
        chosen = rows.join(F.broadcast(named), ["change_id", "source_kind"], "left_semi")
    else:  # by part: no key has more than one row
        keys = parts.join(named, ["change_id", "source_kind"], "left_semi").select(*PART_KEY)
        chosen = rows.join(keys.hint("shuffle_merge"), PART_KEY, "left_semi")
    chosen = chosen.select(*diffs.columns)
    if seen["nameless"] is None:
        return chosen
    return chosen.unionByName(diffs.where("change_id IS NULL").where(F.col("source_kind") == seen["nameless"]).where(f"NOT ({is_blank('diff_text')})"))
