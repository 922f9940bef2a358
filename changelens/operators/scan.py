"""Secret scan over text lines.

Every pattern is a literal in the plan (compiled once per task, never joined
in as data).  Work is cut down in two steps, all in native expressions: path
rules per file, then required literals per line; only the lines that are left
meet the patterns themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import fixed, paths
from changelens.functions.regex import any_of, java
from changelens.functions.rows import each, first_n
from changelens.functions.sql import either, let, quote, sums_before
from changelens.functions.text import round_half_up
from changelens.operators.parse import FILE_KEY
from changelens.params import ScanOptions, SecretPattern

# Lower-case literals that a match of the n-th built-in pattern cannot do
# without; the address pattern has a short test of its own.
_LITERALS = [
    ("akia",), ("key",), ("ghp_",), ("gho_",), ("token",), ("aiza",), ("xox",), ("key",), ("key",),
    ("token",), ("token",), ("secret",), ("://",), ("database",), ("passw",), ("passw",),
    ("-----begin",), ("key",), ("key",), ("-----begin",), ("@",), (),
    ("credential", "auth", "token", "secret"),
]
_SHORT_TEST = {"IP_ADDRESS": r"[0-9]\.[0-9]"}

BUILT_IN = tuple(
    SecretPattern(
        type=kind,
        regex=regex,
        severity=severity,
        confidence=confidence,
        description=fixed.ISSUE_DESCRIPTIONS[kind],
        recommendation=fixed.ISSUE_RECOMMENDATIONS[kind],
        exclude_files=exclude,
        any_literal=_LITERALS[n],
    )
    for n, (kind, regex, severity, confidence, exclude) in enumerate(fixed.SECRET_PATTERNS)
)

FALSE_POSITIVE = "|".join(java(p, ignore_case) for p, ignore_case in fixed.FALSE_POSITIVES)

HIGH_CONFIDENCE = 0.8


# --- the patterns as a table ----------------------------------------------------


def pattern_table(spark: SparkSession, patterns: Sequence[SecretPattern] = BUILT_IN) -> DataFrame:
    """The patterns as rows: ``pattern_idx, type, regex, severity, confidence, …``."""
    rows = [
        (n, p.type, p.regex, p.severity, p.confidence, p.description, p.recommendation,
         list(p.exclude_files), list(p.include_files))
        for n, p in enumerate(patterns)
    ]
    return spark.createDataFrame(
        rows,
        "pattern_idx bigint, type string, regex string, severity string, confidence double, "
        "description string, recommendation string, exclude_files array<string>, include_files array<string>",
    )


def by_severity(patterns: DataFrame, severity: str) -> DataFrame:
    return patterns.where(F.col("severity") == severity)


def by_type(patterns: DataFrame, kind: str) -> DataFrame:
    return patterns.where(F.col("type") == kind)


def high_confidence(rows: DataFrame) -> DataFrame:
    """Patterns or findings of at least 0.8 confidence."""
    return rows.where(f"confidence >= {HIGH_CONFIDENCE}")


def critical_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where("severity IN ('CRITICAL', 'HIGH')")


def patterns_for_files(
    files: DataFrame, keys: Sequence[str], patterns: Sequence[SecretPattern] = BUILT_IN, path: str = "path"
) -> DataFrame:
    """One row per file and pattern whose own path rules allow the file."""
    applies = ", ".join(
        f"if({_rule_holds((p.exclude_files, p.include_files), path)}, {n}L, null)" for n, p in enumerate(patterns)
    )
    rows = each(files, [*keys, path], f"array_compact(array({applies}))", "pattern_idx")
    return rows.selectExpr("*", f"{_attribute([p.type for p in patterns], 'pattern_idx')} AS type")


def active_patterns(files: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """One row per file and built-in pattern that applies to its path; excluded files have none."""
    return patterns_for_files(files.where(f"NOT {paths.is_excluded(path)}"), keys, BUILT_IN, path)


# --- the scan plan ------------------------------------------------------------------


Rule = tuple[tuple[str, ...], tuple[str, ...]]


def chosen_patterns(options: ScanOptions) -> list[tuple[int, SecretPattern, Rule | None]]:
    """The patterns to try, with their numbers and path rules (excluded, included).

    Custom patterns are added after the path rules, so those do not bind them.
    """
    least = fixed.SEVERITY_PRIORITY.get(options.min_severity or "", 0)
    ruled = [(p, (p.exclude_files, p.include_files)) for p in BUILT_IN]
    every = ruled + [(p, None) for p in options.custom_patterns]
    return [
        (n, p, rule)
        for n, (p, rule) in enumerate(every)
        if p.type not in options.exclude_types and fixed.SEVERITY_PRIORITY[p.severity] >= least
    ]


def is_scanned(path: str) -> str:
    return f"NOT {paths.is_excluded(path)}"


class _Scan:
    """Chosen patterns and the SQL expressions to run them.

    Lambda variables: ``rules`` (booleans per path rule), ``line``, ``low`` (the
    line in lower case).
    """

    def __init__(self, options: ScanOptions):
        self.patterns = [*BUILT_IN, *options.custom_patterns]
        used = chosen_patterns(options)
        self._rules = sorted({rule for _, _, rule in used if rule is not None})
        self._used = [(n, p, None if rule is None else self._rules.index(rule)) for n, p, rule in used]

    def rules(self, path: str) -> str:
        """Per file: which distinct path rules hold, as an array of booleans."""
        scanned = is_scanned(path)
        return "array(" + ", ".join(f"{scanned} AND {_rule_holds(r, path)}" for r in self._rules) + ")"

    def any_rule(self) -> str:
        if any(rule is None for _, _, rule in self._used):
            return "true"
        return either(_open(i) for i in range(len(self._rules)))

    def may_match(self) -> str:
        """A cheap test that keeps every line with a match."""
        users: dict[str, set] = {}
        for _, p, rule in self._used:
            for test in _quick_tests(p):
                users.setdefault(test, set()).add(rule)
        tests = [f"({either(map(_open, rules))} AND {test})" for test, rules in users.items()]
        return let("low", "lower(line)", either(tests))

    def matches(self) -> str:
        """All matches in a line, in pattern and text order, false positives left out."""

        def one(n: int, p: SecretPattern, rule: int | None) -> str:
            regex = quote(java(p.regex, ignore_case=True))
            return (
                f"if({_open(rule)} AND {either(_quick_tests(p))}, named_struct('pattern_idx', {n}L,"
                f" 'found', regexp_extract_all(line, {regex}, 0), 'pieces', split(line, {regex}, -1)), null)"
            )

        if not self._used:
            return f"cast(array() as {_MATCHES})"
        by_pattern = ", ".join(one(n, p, rule) for n, p, rule in self._used)
        with_hits = let("low", "lower(line)", f"filter(array_compact(array({by_pattern})), p -> size(p.found) > 0)")
        return (
            f"filter(flatten(transform({with_hits}, p -> {positioned()})),"
            f" m -> NOT m.content rlike {quote(FALSE_POSITIVE)})"
        )

    def describe(self, idx: str) -> list[str]:
        columns = {
            "type": [p.type for p in self.patterns],
            "severity": [p.severity for p in self.patterns],
            "pattern": [p.regex for p in self.patterns],
            "description": [p.description for p in self.patterns],
            "recommendation": [p.recommendation for p in self.patterns],
            "confidence": [p.confidence for p in self.patterns],
        }
        return [f"{_attribute(values, idx)} AS {name}" for name, values in columns.items()]


_MATCHES = "array<struct<pattern_idx:bigint,match_idx:bigint,column:bigint,content:string>>"


def positioned(p: str = "p") -> str:
    """The matches of one pattern (a lambda variable with ``pattern_idx, found,
    pieces``) with their columns: the text before the j-th match is the first j+1
    pieces between matches plus the first j matches."""
    lengths = f"transform({p}.found, (f, j) -> cast(char_length(f) + char_length(get({p}.pieces, j)) as bigint))"
    return let(
        "before",
        sums_before(lengths),
        f"transform({p}.found, (f, j) -> named_struct('pattern_idx', {p}.pattern_idx, 'match_idx', cast(j as bigint),"
        f" 'column', get(before, j) + char_length(get({p}.pieces, j)), 'content', f))",
    )


def _rule_holds(rule: tuple[tuple[str, ...], tuple[str, ...]], path: str) -> str:
    exclude, include = rule
    out = "true"
    if exclude:
        out += f" AND NOT {path} rlike {quote(any_of(exclude))}"
    if include:
        out += f" AND {path} rlike {quote(any_of(include))}"
    return out


def _open(rule: int | None) -> str:
    return "true" if rule is None else f"get(rules, {rule})"


def _quick_tests(p: SecretPattern) -> list[str]:
    if p.any_literal:
        return [f"contains(low, {quote(lit)})" for lit in p.any_literal]
    return [f"line rlike {quote(_SHORT_TEST.get(p.type, java(p.regex, ignore_case=True)))}"]


def _attribute(values: list, idx: str) -> str:
    literals = ", ".join(quote(v) if isinstance(v, str) else f"{v}D" for v in values)
    return f"get(array({literals}), cast({idx} as int))"


# --- findings -----------------------------------------------------------------------

_RESULT = ["file", "line", "column", "type", "severity", "content", "pattern", "description", "recommendation",
           "confidence", "line_ord", "pattern_idx", "match_idx"]


def findings_sql(path: str, lines: str, options: ScanOptions, skip: str = "false") -> str:
    """All findings in an array of (i, line, content), as an array in discovery order."""
    scan = _Scan(options)
    context, contents = "", "null"
    if options.include_context:
        n = options.context_size
        start = f"greatest(c.i - {n}, 0)"
        context = (
            f", 'context_before', slice(contents, {start} + 1, c.i - {start})"
            f", 'context_after', slice(contents, c.i + 2, {n})"
        )
        contents = "transform(lines, c -> c.content)"
    finding = (
        "named_struct('line_ord', cast(c.i as bigint), 'line', c.line, 'pattern_idx', m.pattern_idx,"
        f" 'match_idx', m.match_idx, 'column', m.column, 'content', m.content{context})"
    )
    hits = f"filter(lines, c -> {let('line', 'c.content', scan.may_match())})"
    in_line = f"transform({let('line', 'c.content', scan.matches())}, m -> {finding})"
    in_text = let("lines", lines, let("contents", contents, f"flatten(transform({hits}, c -> {in_line}))"))
    return let("rules", scan.rules(path), f"if({scan.any_rule()} AND NOT {skip}, {in_text}, null)")


def text_findings(path: str, text: str, options: ScanOptions = ScanOptions()) -> str:
    """The findings in a whole text column as an array; lines count from one."""
    lines = f"transform(split({text}, '\\n', -1), (s, i) -> named_struct('i', i, 'line', i + 1L, 'content', s))"
    return findings_sql(path, lines, options)


def file_findings(options: ScanOptions = ScanOptions()) -> str:
    """The findings in a diff file's added lines as an array; binary files have none."""
    line = "named_struct('i', i, 'line', c.line_number, 'content', c.content)"
    lines = f"transform(added, (c, i) -> {line})"
    return findings_sql("path", lines, options, skip="binary")


def scan_content(
    texts_df: DataFrame,
    keys: Sequence[str],
    options: ScanOptions = ScanOptions(),
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """Findings in whole texts, one row per match, in discovery order of
    ``line_ord, pattern_idx, match_idx`` within a text.

    Row-local but for ``max_findings``, so it also runs on a stream.
    """
    found = texts_df.selectExpr(*keys, f"{path} AS _path", f"{text_findings(path, text, options)} AS findings")
    return explode_findings(found, keys, options, path="_path")


def scan_diff(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings in the added lines of parsed diffs, one row per match.

    Discovery order within a change set is ``file_idx, line_ord, pattern_idx,
    match_idx``.  Context lines are neighbours among the file's added lines.
    """
    found = files.selectExpr(*FILE_KEY, "path", f"{file_findings(options)} AS findings")
    return explode_findings(found, FILE_KEY, options, ["change_id"])


def explode_findings(
    rows: DataFrame,
    keys: Sequence[str],
    options: ScanOptions = ScanOptions(),
    limit_keys: Sequence[str] | None = None,
    path: str = "path",
) -> DataFrame:
    """Findings rows of rows that carry a path and the ``findings`` array."""
    scan = _Scan(options)
    context = ["context_before", "context_after"] if options.include_context else []
    found = each(rows, [*keys, f"{path} AS file"], "findings", "_m")
    fields = ("line", "column", "content", "line_ord", "pattern_idx", "match_idx", *context)
    flat = found.selectExpr(
        *keys, "file", *scan.describe("_m.pattern_idx"), *[f"_m.{c} AS {c}" for c in fields]
    ).select(*keys, *_RESULT, *context)
    return limit(flat, limit_keys or keys, options.max_findings)


def discovery_order(findings: DataFrame) -> list[str]:
    """Discovery order within a text or change set."""
    return [c for c in ("file_idx", "line_ord", "pattern_idx", "match_idx") if c in findings.columns]


def unlimited(options: ScanOptions) -> ScanOptions:
    return replace(options, max_findings=0)


def limit(findings: DataFrame, keys: Sequence[str], max_findings: int) -> DataFrame:
    """The first findings in discovery order, per text or change set."""
    if max_findings <= 0:
        return findings
    return first_n(findings, max_findings, keys, discovery_order(findings), rank="_n").drop("_n")


def priority(severity: str = "severity") -> str:
    whens = " ".join(f"WHEN '{s}' THEN {p}" for s, p in fixed.SEVERITY_PRIORITY.items())
    return f"CASE {severity} {whens} END"


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(f"{priority()} >= {fixed.SEVERITY_PRIORITY[severity]}")


def apply_filters(findings: DataFrame, keys: Sequence[str], options: ScanOptions) -> DataFrame:
    """The result filters alone: least severity, then the first N per key."""
    if options.min_severity:
        findings = at_least(findings, options.min_severity)
    return limit(findings, keys, options.max_findings)


def severity_order() -> list[str]:
    """Sort keys of a report: worst first, then discovery order."""
    return [f"{priority()} DESC", "file_idx", "line_ord", "pattern_idx", "match_idx"]


def severity_count(severity: str, options: ScanOptions = ScanOptions()) -> str:
    """How many elements of a ``findings`` array have the severity."""
    patterns = _Scan(options).patterns
    wanted = ", ".join(f"{n}L" for n, p in enumerate(patterns) if p.severity == severity)
    return f"coalesce(size(filter(findings, m -> m.pattern_idx IN ({wanted or 'null'}))), 0)"


def severity_counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by severity and in total for every key that has findings."""
    return findings.groupBy(*keys).agg(
        *[F.expr(f"count_if(severity = '{s}') AS n_{s.lower()}") for s in fixed.SEVERITY_PRIORITY],
        F.expr("count(*) AS n_findings"),
    )


def type_counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by issue type; ``first_seen`` orders types as a sorted report meets them."""
    seen = ", ".join(f"'{c}', {c}" for c in discovery_order(findings))
    return findings.groupBy(*keys, "type").agg(
        F.expr("count(*) AS n"), F.expr(f"min(named_struct('p', -{priority()}, {seen})) AS first_seen")
    )


def scan_summary(change_sets: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per change set, also those without findings.

    ``change_sets`` needs ``change_id, total_files``.
    """
    return summary_of_types(change_sets, type_counts(findings, ["change_id", "severity"]))


def summary_of_types(change_sets: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from ``type_counts`` by change set and severity."""
    names = [f"n_{s.lower()}" for s in fixed.SEVERITY_PRIORITY]
    # One entry per issue type and severity at most is collected.
    entries = "transform(array_sort(collect_list(struct(first_seen, type, n))), t -> struct(t.type, t.n))"
    by_type = counts.groupBy("change_id", "type").agg(
        F.expr("sum(n) AS n"),
        F.expr("min(first_seen) AS first_seen"),
        *[F.expr(f"sum(if(severity = '{s}', n, 0L)) AS n_{s.lower()}") for s in fixed.SEVERITY_PRIORITY],
    )
    totals = by_type.groupBy("change_id").agg(
        *[F.expr(f"sum({c}) AS {c}") for c in names],
        F.expr("sum(n) AS n_findings"),
        F.expr(f"map_from_entries({entries}) AS by_type"),
    )
    return (
        change_sets.selectExpr("change_id", "total_files AS files_scanned")
        .join(totals, "change_id", "left")
        .selectExpr(
            "change_id",
            "files_scanned",
            *[f"coalesce({c}, 0L) AS {c}" for c in (*names, "n_findings")],
            "coalesce(n_critical, 0L) > 0 AS has_critical_issues",
            "coalesce(by_type, cast(map() as map<string, bigint>)) AS by_type",
        )
    )


def finding_text(findings: DataFrame) -> DataFrame:
    """Adds ``finding_text``, the printed form of a finding."""
    text = (
        "concat(severity, ' - ', type, '\\n   File: ', file, ':', line, '\\n   Issue: ', description,"
        f" '\\n   Fix: ', recommendation, '\\n   Confidence: ', {round_half_up('confidence * 100')}, '%')"
    )
    return findings.selectExpr("*", f"{text} AS finding_text")
