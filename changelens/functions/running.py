"""Running totals over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.sources.tables import cut, drop_tables

CHUNK_ROWS = 4096


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    lasts: dict[str, tuple[str, str]] | None = None,
    paths: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The rows with totals over the rows before each of its key, in order.

    ``sums`` name sums of expressions, 0 at the start; ``lasts`` name the last
    value (of an orderable type) where a condition held, as (place, value), null
    before the first.  ``place`` is added: it grows with keys and order.  Order
    must tell the rows of a key apart.

    No window sees a key whole: rows are written, as ranges are found by a pass
    of its own, then range-partitioned and sorted once and written; their place gives chunks of bounded length, and what windows over a
    key is one row for each chunk.
    """
    lasts = lasts or {}
    by = [*keys, *order]
    own: list[str] = []
    ordered = cut(
        cut(rows, "running-rows", own).repartitionByRange(*[F.col(c).asc_nulls_first() for c in by])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("_chunk", F.floor(F.col("place") / chunk_rows).cast("long")),
        "running",
        paths,
    )
    drop_tables(rows.sparkSession, own)
    last = {
        name: F.expr(f"max(if({condition}, named_struct('place', place, 'value', {value}), null))")
        for name, (value, condition) in lasts.items()
    }
    chunks = ordered.groupBy(*keys, "_chunk").agg(
        *[F.expr(f"sum({value})").alias(f"_{name}") for name, value in sums.items()],
        *[found.alias(f"_{name}") for name, found in last.items()],
    )
    above = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_chunk").alias("_of"),
        *[F.coalesce(F.sum(f"_{name}").over(above), F.lit(0)).alias(f"_{name}") for name in sums],
        *[F.max(f"_{name}").over(above).alias(f"_{name}") for name in lasts],
    )
    same = F.col("_chunk") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    before = Window.partitionBy(*keys, "_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.join(starts, same).select(
        *rows.columns,
        "place",
        *[
            (F.col(f"_{name}") + F.coalesce(F.sum(F.expr(value)).over(before), F.lit(0))).cast("long").alias(name)
            for name, value in sums.items()
        ],
        *[F.greatest(found.over(before), F.col(f"_{name}")).alias(name) for name, found in last.items()],
    )
