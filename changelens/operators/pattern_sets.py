"""Secret scan with patterns as data: a set of them for each repository.

A table of patterns has a row for each pattern of each set, with its regular
expression in the engine's dialect, path rules and literals.  Sets are small and
are sent to the texts if their measured size allows, else joined by shuffling;
each text then meets the patterns of its own set.  One plan serves any number of
sets; for a single one the patterns are better literals of the plan (``scan``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.regex import any_of, java
from changelens.functions.rows import each
from changelens.functions.sql import let, quote
from changelens.operators import scan
from changelens.params import ScanOptions
from changelens.sources.tables import BROADCAST_BYTES, lookup

SCHEMA = (
    "pattern_set string, pattern_idx bigint, type string, severity string, pattern string, description string,"
    " recommendation string, confidence double, java_regex string, literals array<string>, only_path string,"
    " not_path string, any_file boolean"
)
_DESCRIBED = ("type", "severity", "pattern", "description", "recommendation", "confidence")


def pattern_sets(spark: SparkSession, sets: Mapping[str, ScanOptions]) -> DataFrame:
    """The patterns that each set of options chooses, as rows of ``SCHEMA``.

    A null path rule holds for every path; ``any_file`` patterns are tried on
    files too that the scan leaves out otherwise.
    """
    rows = [
        (
            name, n, p.type, p.severity, p.regex, p.description, p.recommendation, float(p.confidence),
            java(p.regex, ignore_case=True), list(p.any_literal),
            any_of(p.include_files) if rule and p.include_files else None,
            any_of(p.exclude_files) if rule and p.exclude_files else None,
            rule is None,
        )
        for name, options in sets.items()
        for n, p, rule in scan.chosen_patterns(options)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def scan_with_sets(
    texts: DataFrame,
    keys: Sequence[str],
    patterns: DataFrame,
    set_column: str,
    path: str = "path",
    text: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Findings in whole texts, each by the patterns of the set that its
    ``set_column`` names; like ``scan.scan_content`` with that set's options.

    Texts of a set without patterns, or of none, have no findings.
    """
    fields = ("pattern_idx", "java_regex", "literals", "only_path", "not_path", "any_file", *_DESCRIBED)
    # a set is as large as its list of patterns
    sets = patterns.groupBy(F.col("pattern_set").alias("_set")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_patterns")
    )
    rows = texts.selectExpr(*keys, f"{path} AS _path", f"{text} AS _text", f"{set_column} AS _set")
    met = lookup(rows, sets, ["_set"], spread="_text", limit=limit)
    allowed = (
        f"filter(_patterns, p -> (p.any_file OR {scan.is_scanned('_path')})"
        " AND (p.only_path IS NULL OR _path rlike p.only_path) AND (p.not_path IS NULL OR NOT _path rlike p.not_path))"
    )
    quick = "(size(p.literals) = 0 OR exists(p.literals, x -> contains(lower(l.content), x)))"
    hits = f"filter(lines, l -> {quick} AND l.content rlike p.java_regex)"
    found = (
        "transform({hits}, l -> transform(filter({positioned}, m -> NOT m.content rlike {false}),"
        " m -> named_struct('line_ord', l.i, 'pattern_idx', m.pattern_idx, 'match_idx', m.match_idx,"
        " 'line', l.i + 1L, 'column', m.column, 'content', m.content)))"
    ).format(
        hits=hits,
        positioned=let(
            "q",
            "named_struct('pattern_idx', p.pattern_idx, 'found', regexp_extract_all(l.content, p.java_regex, 0),"
            " 'pieces', split(l.content, p.java_regex, -1))",
            scan.positioned("q"),
        ),
        false=quote(scan.FALSE_POSITIVE),
    )
    lines = "transform(split(_text, '\\n', -1), (s, i) -> named_struct('i', cast(i as bigint), 'content', s))"
    findings = let("lines", lines, f"array_sort(flatten(flatten(transform({allowed}, p -> {found}))))")
    flat = each(
        met.selectExpr(*keys, "_path", "map_from_arrays(_patterns.pattern_idx, _patterns) AS _by_idx", f"{findings} AS _found"),
        [*keys, "_path AS file", "_by_idx"],
        "_found",
        "_m",
    )
    described = [f"_by_idx[_m.pattern_idx].{c} AS {c}" for c in _DESCRIBED]
    return flat.selectExpr(
        *keys, "file", "_m.line AS line", "_m.column AS column", "_m.content AS content", *described,
        "_m.line_ord AS line_ord", "_m.pattern_idx AS pattern_idx", "_m.match_idx AS match_idx",
    )
