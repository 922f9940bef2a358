"""Parquet sinks that can be written again with the same result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_rows(
    rows: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    rows_per_file: int = 1_000_000,
) -> None:
    """Replace the partitions that the rows fall into; others stay.

    Rows are range-partitioned and sorted by partition and cluster columns, so
    files hold neighbours and can be skipped by their statistics, one partition
    with most of the rows is written by many tasks, and no file has more than
    ``rows_per_file``.  Writing again, after a failure too, replaces what was
    written.  Without partition columns the whole table is replaced.
    """
    by = [*partition_by, *cluster_by]
    if by:
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The changed rows of a streaming aggregate, a folder for each batch; takes
    what is there and stops.  A batch that is run again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last row of each key among those of ``write_updates``."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")
