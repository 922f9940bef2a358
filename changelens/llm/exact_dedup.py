"""Exact duplicates by a tree merge of sorted digest runs.

A document's key is the SHA-256 of its text with white space collapsed, and a
second, independent digest with the length.  The scan's partitions are cut into
runs of bounded length.  In each round, runs whose numbers agree but for the
lowest bits meet: their rows, sorted by key, are merged into one run that keeps,
for each key, the smallest identifier and the number of documents.  Rows are
verified by the second digest at every level: texts that agree in one digest
alone never meet.  After the last round one run is left; its results go back
down the tree, level by level, to the rows.

A level's run is spread over the cluster by slices of the digest, and a key has
at most one row from each run that meets, up as well as down.  So a group of
copies of any size is never more than ``fan_in`` rows of a task's work above the
runs, and one run's rows at the bottom.  Everything is DataFrame operations on
thin rows; each level is a written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.tables import cut, drop_tables, fresh

_KEY = ["sha", "check"]


@dataclass(frozen=True)
class MergeParams:
    """``run_rows``: documents of a first run.  ``fan_in``: runs that meet in a
    round.  ``slices``: parts by digest that a run can be spread over."""

    run_rows: int = 4096
    fan_in: int = 16
    slices: int = 1 << 16


def normal_text(text: Column) -> Column:
    """The text with each stretch of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _tie(docs: DataFrame, without: str) -> Column:
    """A hash of a row's other columns, so that equal ids have an order."""
    sound = [f.name for f in docs.schema if f.name != without and not any(t in f.dataType.simpleString() for t in ("map<", "variant", "interval"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in sound]) if sound else F.lit(0).cast("long")


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, tie, sha, check`` of each row: thin, whatever the text."""
    normal = normal_text(F.col(f"`{text_col}`"))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), _tie(docs, text_col).alias("tie"), normal.alias("normal")
    ).select(
        "id",
        "tie",
        F.unhex(F.sha2("normal", 256)).alias("sha"),
        F.concat(F.unhex(F.md5("normal")), F.unhex(F.lpad(F.hex(F.octet_length("normal")), 16, "0"))).alias("check"),
    )


def _merged(rows: DataFrame, run: Column, params: MergeParams) -> DataFrame:
    """Runs merged into those of number ``run``: rows meet sorted by key, and a
    key's smallest identifier and count stay."""
    part = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long") % params.slices
    met = rows.withColumn("run", run).repartition("run", part.alias("slice"))
    return (
        met.sortWithinPartitions("run", *_KEY)
        .groupBy("run", *_KEY)
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    )


def exact_duplicates(
    docs: DataFrame, params: MergeParams = MergeParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256, tie`` for each row.

    Texts are equal when they are identical after each stretch of white space
    became one space; a null text counts as empty, and empty texts are one
    group.  Of equal texts the row of the smallest id stays; null ids come
    last, and a group of null ids alone has a null ``keep_id`` and keeps one
    row.  Of rows equal in id and text the one of the smallest hash of the
    other columns stays, whichever partition it is in; of rows alike in
    everything exactly one.  Texts of any length are reduced to digests in the
    scan.  Other columns are not read but for that hash; none clashes.  An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    used: list[str] = []
    place = F.monotonically_increasing_id()
    rows = cut(
        keyed_rows(docs, id_col, text_col).withColumn("place", place).select(
            "*",
            F.shiftright("place", 33).alias("part"),
            F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / params.run_rows).cast("long").alias("stretch"),
        ),
        "digests",
    )
    last = rows.agg(F.max("part"), F.max("stretch")).first()
    stretches = (last[1] or 0) + 1
    runs = ((last[0] or 0) + 1) * stretches
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "place")
    numbered = rows.withColumn("run", F.col("part") * stretches + F.col("stretch"))

    levels = [cut(_merged(numbered.select(*_KEY, best.alias("best"), F.lit(1).cast("long").alias("n"), "run"), F.col("run"), params), "run-0", used)]
    while runs > 1:
        runs = -(-runs // params.fan_in)
        levels.append(cut(_merged(levels[-1], F.floor(F.col("run") / params.fan_in).cast("long"), params), f"run-{len(levels)}", used))

    found = levels.pop().select("run", *_KEY, "best", "n")
    while levels:
        below = levels.pop().select("run", *_KEY, F.floor(F.col("run") / params.fan_in).cast("long").alias("up"))
        above = found.select(F.col("run").alias("up"), *_KEY, "best", "n")
        found = cut(below.join(above, ["up", *_KEY]).drop("up"), "found", used if levels else None)
    # a run has each key once and at most run_rows rows of it
    marked = numbered.join(found, ["run", *_KEY]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "tie",
    )
    if len(used) > 1:  # else there is one run alone, whose table is still to be read
        drop_tables(spark, used)
    return marked


def drop_copies(
    docs: DataFrame, params: MergeParams = MergeParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows that stay, with all their columns; cases as above."""
    marks = exact_duplicates(docs, params, id_col, text_col)
    id_, tie, sha = fresh(docs, "own_id", "own_tie", "own_sha")
    stay = marks.where("kept").select(
        F.col("id").alias(id_ + "s"), F.col("tie").alias(tie + "s"), F.col("text_sha256").alias(sha + "s")
    )
    keyed = docs.withColumn(tie, _tie(docs, text_col)).withColumn(sha, F.sha2(normal_text(F.col(f"`{text_col}`")), 256))
    keyed = keyed.withColumn(id_, F.col(f"`{id_col}`"))
    same = F.col(id_).eqNullSafe(F.col(id_ + "s")) & (F.col(tie) == F.col(tie + "s")) & (F.col(sha) == F.col(sha + "s"))
    # one of rows alike in everything first, with partial aggregates before the shuffle
    return keyed.dropDuplicates([id_, tie, sha]).join(stay, same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
