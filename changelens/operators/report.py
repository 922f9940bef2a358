"""Reports as rows.

A report is lines ordered by ``section_idx, line_idx, entry_no``; only tables
that are bounded per change set or limited to a few rows go into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from changelens.functions.rows import each, first_n
from changelens.functions.sql import quote
from changelens.functions.text import non_empty, one_decimal, round_half_up, texts, when
from changelens.operators import risk, scan, summary
from changelens.operators.parse import FILE_KEY
from changelens.params import ScanOptions
from changelens.sources.tables import lookup

HEADER, RISK, CONTENT, SUMMARY, FINDINGS, TESTS, FOOTER = range(7)
_COLUMNS = ["change_id", "section_idx", "line_idx", "entry_no", "line"]
_SCORE = f"concat(overall_risk, ' (', {round_half_up('overall_score')}, '/100)')"


def compact(assessment: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The short form: ``change_id, compact_text``."""
    parts = [
        f"concat('**Risk:** ', {_SCORE})",
        "concat('**Changes:** ', total_files, ' files, +', total_additions, ' -', total_deletions)",
        when("n_findings > 0",
             "concat('**Security:** ', n_findings, ' issue(s)', if(n_critical > 0, ' (CRITICAL)', ''))"),
    ]
    rows = assessment
    if titles is not None:
        rows = rows.join(titles.select("change_id", "title"), "change_id", "left")
        parts.append("concat('**Title:** ', title)")
    return rows.selectExpr("change_id", rf"concat_ws('\n', {', '.join(parts)}) AS compact_text")


def _numbered(lines: str, start: str | int = 0) -> str:
    """An array of lines as an array of (line_idx, line), numbered from ``start``."""
    return f"transform({lines}, (x, i) -> named_struct('line_idx', {start} + cast(i as bigint), 'line', x))"


def _in_section(section: int, *blocks: str) -> str:
    """Arrays of (line_idx, line) as one of (section_idx, line_idx, line)."""
    placed = f"named_struct('section_idx', {section}L, 'line_idx', cast(l.line_idx as bigint), 'line', l.line)"
    return f"transform(concat({', '.join(blocks)}), l -> {placed})"


def _rows(df: DataFrame, *sections: str) -> DataFrame:
    """Report rows of arrays of (section_idx, line_idx, line), in one pass."""
    return each(df, ["change_id"], f"concat({', '.join(sections)})", "_l").selectExpr(
        "change_id", "_l.section_idx AS section_idx", "_l.line_idx AS line_idx", "0L AS entry_no", "_l.line AS line"
    )


def _lines(df: DataFrame, section: int, *blocks: str) -> DataFrame:
    """Report rows of arrays of (line_idx, line)."""
    return _rows(df, _in_section(section, *blocks))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_HEADER = _numbered(
    "array('# PR Readiness Analysis', concat('**Files Changed:** ', total_files, ' | **Lines:** +', total_additions,"
    f" ' -', total_deletions, if({non_empty('base_branch')}, concat(' | **Base:** ', base_branch), '')))"
)


def _risk_lines() -> list[str]:
    """Level, factors with up to two details each, critical issues, and the
    heading of the recommendations."""
    top = _numbered(f"array('## Risk Assessment', concat('**Overall Risk:** ', {_SCORE}), '### Risk Factors')")
    capitalized = "concat(upper(left(f.category, 1)), substring(f.category, 2))"
    factor = texts(
        f"concat('- **', {capitalized}, '** (', f.share, '% weight)')",
        f"concat('  - Score: ', {one_decimal('f.score')}, '/100')",
        "concat('  - ', f.explanation)",
    )
    detail = "transform(if(f.score > 30, slice(f.details, 1, 2), array()), d -> concat('    - ', d))"
    factors = f"flatten(transform(factors, f -> {_numbered(f'concat({factor}, {detail})', 'f.factor_idx * 10 + 10')}))"
    complex_ = quote("    - " + risk.COMPLEX_FILES)
    listed = (
        f"if(complexity_score > 30 AND n_complex > 0, array(named_struct('line_idx', 24L, 'line', {complex_})), array())"
    )
    found = _numbered(
        "if(size(critical_issues) = 0, array(), concat(array('### Critical Issues'),"
        " transform(critical_issues, x -> concat('- ', x))))",
        60,
    )
    return [top, factors, listed, found, _numbered("array('### Recommendations')", 80)]


def risk_lists(assessment: DataFrame, facts: DataFrame) -> DataFrame:
    """What grows with a change set: the names of all complex files, and five
    recommendations with the entries of theirs."""
    scored = assessment.where("complexity_score > 30").select("change_id")
    complex_part = (
        lookup(risk.complex_file_details(facts), scored, ["change_id"], "left_semi", spread="path")
        .selectExpr("change_id", f"{RISK}L AS section_idx", "24L AS line_idx", "entry_no", "path AS line")
    )
    recs = risk.recommendations(assessment, facts).where("rec_idx < 5").selectExpr(
        "change_id", f"{RISK}L AS section_idx", "rec_idx + 81 AS line_idx", "entry_no",
        "if(entry_no = 0, concat('- ', recommendation), recommendation) AS line",
    )
    return _union(complex_part, recs)


def content_section(pr_content: DataFrame) -> DataFrame:
    """Title and description, for change sets that have both."""

    def part(heading: str, column: str) -> list[str]:
        return [when(non_empty(column), f"'**{heading}**'"), when(non_empty(column), column)]

    lines = texts(
        "'## Suggested PR Content'", "'### Title'", "'```'", "title", "'```'",
        when("is_conventional", "'✓ Follows conventional commit format'"),
        "'### Description'",
        *part("What Changed", "what_changed"),
        *part("Why", "why_changed"),
        *part("Impact", "impact"),
        when("size(breaking_changes) > 0", "'**Breaking Changes**'"),
    )
    breaking = "transform(breaking_changes, c -> concat('- ', c))"
    return _lines(pr_content, CONTENT, _numbered(f"concat({lines}, {breaking})"))


_LIST_TITLES = {"added": "Added", "modified": "Modified", "deleted": "Deleted", "critical": "Critical Files",
                "test": "Test Files"}


def summary_section(facts: DataFrame) -> DataFrame:
    """The first three paths of five lists and how many more there are.

    Every file is in a list by status, so the heading comes from one of them.
    """
    names = ", ".join(f"'{x}'" for x in _LIST_TITLES)
    title = "CASE list " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LIST_TITLES.items()) + " END"
    line = (
        f"concat('**', {title}, ' (', size, '):** ', array_join(head, ', '),"
        " if(size > 3, concat(' and ', size - 3, ' more'), ''))"
    )
    order = f"cast(array_position(array({names}), list) as bigint)"
    return summary.list_heads(facts, 3).where(f"list IN ({names})").selectExpr(
        "change_id", f"{SUMMARY}L AS section_idx", f"{order} AS line_idx", "0L AS entry_no", f"{line} AS line"
    )


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The worst ``n`` findings of every change set, ranked."""
    return first_n(findings, n, ["change_id"], scan.severity_order())


def _finding_counts() -> str:
    """Counts of change sets that have findings, and the heading of the list."""
    counts = texts(
        "'## Security Findings'",
        "concat('**Total Issues:** ', n_findings)",
        *[f"concat('- {s}: ', n_{s.lower()})" for s in ("Critical", "High", "Medium", "Low")],
        when("n_critical > 0", "'**Contains critical security issues that must be fixed!**'"),
    )
    heading = _numbered("array('### Top Findings')", 10)
    return f"if(n_findings > 0, {_in_section(FINDINGS, _numbered(counts), heading)}, array())"


def findings_list(facts: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The top five findings."""
    found = top_findings(scan.explode_findings(facts, FILE_KEY, options, ["change_id"]))
    entry = texts(
        "concat(rank, '. **', type, '** (', severity, ')')",
        "concat('   - File: ', file, ':', line)",
        "concat('   - ', description)",
        "concat('   - Fix: ', recommendation)",
    )
    return _lines(found, FINDINGS, _numbered(entry, "rank * 10 + 10"))


def tests_section(combined: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts, three unit tests and two integration tests."""
    counts = texts(
        "'## Test Suggestions'",
        "concat('**Total Suggestions:** ', total_suggestions)",
        "concat('- Unit Tests: ', n_unit)",
        "concat('- Integration Tests: ', n_integration)",
        "concat('- E2E Tests: ', n_e2e)",
        when("coverage_improvement > 0", "concat('**Estimated Coverage Improvement:** +', coverage_improvement, '%')"),
    )
    units = _numbered("if(n_unit > 0, array('### Unit Tests'), array())", 10)
    integrations = _numbered("if(n_integration > 0, array('### Integration Tests'), array())", 50)
    shown = f"type = 'unit' AND {non_empty('code_snippet')}"
    entry = texts(
        "concat(number, '. ', description)",
        when("type = 'unit'", "concat('   - Priority: ', priority)"),
        "concat('   - ', scenario)",
        when(shown, "'```typescript'"),
        when(shown, r"array_join(slice(split(code_snippet, '\n', -1), 1, 10), '\n')"),
        when(shown, "'```'"),
    )
    first = combined.where("(type = 'unit' AND number <= 3) OR (type = 'integration' AND number <= 2)")
    return _union(
        _lines(totals.where("total_suggestions > 0"), TESTS, _numbered(counts), units, integrations),
        _lines(first, TESTS, _numbered(entry, "number * 10 + if(type = 'unit', 10, 50)")),
    )


_NEXT_STEPS = {
    "HIGH": ["Address critical issues and security findings", "Consider splitting large changes",
             "Add comprehensive tests", "Schedule thorough code review", "Test in staging environment"],
    "MEDIUM": ["Review security findings", "Add suggested tests", "Request code review", "Verify CI/CD passes"],
    "LOW": ["Review looks good!", "Add any suggested tests", "Request standard code review",
            "Merge when approved"],
}


def _footer() -> str:
    steps = " ".join(
        f"WHEN '{level}' THEN array({', '.join(f"'{i}. {step}'" for i, step in enumerate(names, 1))})"
        for level, names in _NEXT_STEPS.items()
    )
    time = f"concat('**Estimated Review Time:** ', {risk.review_time('overall_score', long=True)})"
    return _numbered(f"concat(array('---', '## Next Steps'), CASE overall_risk {steps} END, array({time}))")


def complete(
    assessment: DataFrame,
    facts: DataFrame,
    pr_content: DataFrame | None = None,
    combined: DataFrame | None = None,
    totals: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
) -> DataFrame:
    """All sections: ``change_id, section_idx, line_idx, entry_no, line``.

    Lines that an assessment row holds come from one projection of it.
    """
    fixed_lines = _rows(
        assessment,
        _in_section(HEADER, _HEADER),
        _in_section(RISK, *_risk_lines()),
        _in_section(SUMMARY, _numbered("array('## Change Summary')")),
        _finding_counts(),
        _in_section(FOOTER, _footer()),
    )
    parts = [fixed_lines, risk_lists(assessment, facts), summary_section(facts), findings_list(facts, options)]
    if pr_content is not None:
        parts.append(content_section(pr_content))
    if combined is not None and totals is not None:
        parts.append(tests_section(combined, totals))
    return _union(*parts).select(*_COLUMNS)
