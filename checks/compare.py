"""Runs catalogue queries and their statements side by side.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

TABLE_NAMES = ["documents", "labels", "pages", "conversations", "benchmark"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark: SparkSession, folder: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, folder)
    built = time.time()
    rows = [tuple(r) for r in df.collect()]
    took = f"{built - start:5.1f}s plan {time.time() - built:5.1f}s run"
    if sql is None:
        return bool(rows), f"{len(rows)} rows {took}, no statement"
    duck = duckdb.connect()
    for table in TABLE_NAMES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = duck.execute(sql)
    columns = [c[0] for c in got.description]
    theirs = sorted_rows(columns, got.fetchall())
    ours = sorted_rows(df.columns, rows)
    if ours == theirs:
        return True, f"{len(rows)} rows {took}"
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} / {theirs[0]}"
    left = [r for r in ours[1] if r not in set(theirs[1])][:3]
    right = [r for r in theirs[1] if r not in set(ours[1])][:3]
    return False, f"{len(ours[1])} / {len(theirs[1])} rows\n   spark {left}\n   other {right}"


def session(threads: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("changelens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from changelens.catalogue import QUERIES
    from checks.statements import STATEMENTS

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, bad = session(), 0
    for name in names:
        try:
            ok, note = compare(spark, folder, name, QUERIES[name], STATEMENTS.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
