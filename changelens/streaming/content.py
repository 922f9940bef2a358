"""Secret scan and totals over streams.

The scan looks at one row at a time, so a stream needs no state and no
watermark: new texts come in, their findings go out, in append mode.  A limit on
findings keeps one number for each key.  Totals are aggregates in update mode.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from changelens.operators import parse, scan, summary
from changelens.params import ScanOptions


def scan_stream(texts: DataFrame, keys: Sequence[str], options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of a streaming DataFrame with ``path`` and ``text``."""
    found = scan.scan_content(texts, keys, scan.unlimited(options))
    return limit_stream(found, keys, options.max_findings)


def scan_diff_stream(diffs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of a streaming DataFrame of diff rows."""
    found = scan.scan_diff(parse.parse_files(diffs), scan.unlimited(options))
    return limit_stream(found, ["change_id"], options.max_findings)


def limit_stream(findings: DataFrame, keys: Sequence[str], max_findings: int) -> DataFrame:
    """The first findings of each key, in order of arrival and, within a batch,
    of discovery: those of the batch analysis if parts arrive in order.

    The state of a key is how many it has given out; no more findings than the
    limit are held for a key, whatever the size of a batch.
    """
    if max_findings <= 0:
        return findings
    order = scan.discovery_order(findings)

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = state.get[0] if state.exists else 0
        left, held = max_findings - given, None
        for batch in batches:
            if left > 0:
                both = batch if held is None else pd.concat([held, batch])
                held = both.sort_values(order).head(left)
        if held is not None and len(held):
            state.update((given + len(held),))
            yield held

    return findings.groupBy(*keys).applyInPandasWithState(
        first, findings.schema, "given long", "append", GroupStateTimeout.NoTimeout
    )


def totals_stream(diffs: DataFrame) -> DataFrame:
    """Files, additions and deletions of growing change sets, for update mode."""
    return summary.change_totals(parse.parse_files(diffs))


def types_stream(diffs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of growing change sets by type and severity, for update mode;
    with ``totals_stream`` they make ``scan.summary_of_types``."""
    found = scan.scan_diff(parse.parse_files(diffs), scan.unlimited(options))
    return scan.type_counts(found, ["change_id", "severity"])


def write_findings(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings to a parquet table; takes what is there and stops."""
    return (
        findings.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
