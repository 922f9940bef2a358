"""Headline queries, timed.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from changelens.catalogue import QUERIES  # noqa: E402
from checks.compare import session  # noqa: E402

HEADLINE = [
    "scan_documents_findings",
    "scan_severity_by_source",
    "scan_max_findings",
    "diff_source_choice",
    "diff_files",
    "diff_changes",
    "diff_findings",
    "diff_scan_summary",
    "change_summary",
    "split_suggestions",
    "risk_overall",
    "risk_recommendations",
    "title_prompt",
    "test_prompt",
    "test_suggestions",
    "compact_report",
    "report_lines",
]
RUNS = 2
TABLES = ["documents", "labels", "pages", "conversations"]


def in_splits(spark, folder: str, scratch: str, n: int) -> str:
    """The tables again, in ``n`` files each: the ones given are one row group
    each, which one task would read, unlike any table of a size that matters."""
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(n).write.parquet(f"{scratch}/{name}.parquet")
    return scratch


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="bench-")
    try:
        split = in_splits(spark, folder, scratch, 2 * int(cpus))
        seconds = {name: round(min(timed(spark, split, name) for _ in range(RUNS)), 3) for name in names}
    finally:
        shutil.rmtree(scratch, ignore_errors=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
