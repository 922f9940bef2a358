"""Parquet tables, and intermediate tables in the folder that a session shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the session names in
    ``spark.checkpoint.dir``, else its warehouse, which executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = named or spark.conf.get("spark.sql.warehouse.dir", None)
    if not folder:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "changelens", paths: list[str] | None = None) -> DataFrame:
    """Write the rows to a new table in the shared folder and go on from there.

    A lost executor costs none of the work before it, and each reader gets the
    same rows and only its columns.  The table's path is added to ``paths``;
    ``drop_tables`` removes it, else it goes when the application ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a new table, gone when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop, files = _files(spark, path)
    files.deleteOnExit(hadoop)
    return path


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        hadoop, files = _files(spark, path)
        files.delete(hadoop, True)


#: Most bytes (as JSON) of a table that is sent to every executor.
BROADCAST_BYTES = 32 << 20
_SALTS = 32


def json_bytes(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: str | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows joined to a table of one row for each key, which is read twice.

    The table is sent to the executors if it is small, by its measured size.
    Beyond that the rows are shuffled, or stay where they are if they are
    bucketed by the keys; where one key may hold a large share of them,
    ``spread`` is an expression that tells them apart and deals each key to
    several tasks.  Null keys meet nothing.
    """
    if json_bytes(table) <= limit:
        return rows.join(F.broadcast(table), keys, how)
    if spread is None:
        return rows.join(table.hint("shuffle_merge"), keys, how)
    dealt = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.expr(spread)), F.lit(_SALTS)).cast("int"))
    return salted.join(dealt.hint("shuffle_merge"), [*keys, "_salt"], how).drop("_salt")


def _files(spark: SparkSession, path: str):
    """A path and its file system, whichever store it is in."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(context._jsc.hadoopConfiguration())
