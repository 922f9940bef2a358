"""Review risk of change sets.

``assess`` is a projection over one profile row per change set plus three
bounded side tables.  Everything that can grow with a change set (paths in a
detail or recommendation) is handed out as rows: entry 0 is a line or a list's
heading, and the entries after it are the list, whatever its length.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import fixed
from changelens.functions.rows import each_with_position, first_n
from changelens.functions.sql import quote
from changelens.functions.text import one_decimal, round_half_up, texts, when
from changelens.operators import summary
from changelens.params import RiskParams, ScanOptions
from changelens.sources.tables import lookup

FACTORS = ["security", "complexity", "changeSize", "criticalFiles"]
_SCORES = dict(zip(FACTORS, ("security_score", "complexity_score", "size_score", "critical_score"), strict=True))
_HIGH_COMPLEXITY = f"complexity >= {fixed.COMPLEXITY_THRESHOLDS['high']}"


# --- scores: columns over a profile row, later ones use earlier ones -------------------------


def security_score() -> dict[str, str]:
    points = " + ".join(f"n_{s} * {p}" for s, p in fixed.SECURITY_POINTS.items())
    return {
        "security_score": f"least(100D, cast({points} as double))",
        "has_blocking_issues": "n_critical > 0 OR n_high > 2",
    }


def complexity_score() -> dict[str, str]:
    return {
        "avg_complexity": "if(total_files > 0, total_complexity / total_files, 0D)",
        "complexity_score": "least(100D, n_complex * 20 + least(50D, avg_complexity * 3))",
    }


def size_score() -> dict[str, str]:
    at = fixed.SIZE_THRESHOLDS
    lines = "(total_additions + total_deletions)"

    def band(n: str, large: int, medium: int, most: int, half: int) -> str:
        return f"CASE WHEN {n} >= {large} THEN {most}D WHEN {n} >= {medium} THEN {half}D ELSE {n} / {medium}D * {half}D END"

    files_part = band("total_files", at["large_files"], at["medium_files"], 40, 20)
    lines_part = band(lines, at["large_lines"], at["medium_lines"], 60, 30)
    return {
        "net_lines": "abs(total_additions - total_deletions)",
        "size_score": f"least(100D, {files_part} + {lines_part})",
        "is_too_large": f"total_files >= {at['large_files']} OR {lines} >= {at['large_lines']}",
    }


def _seen(*categories: str) -> str:
    return "(" + " OR ".join(f"first_{c} IS NOT NULL" for c in categories) + ")"


def critical_score() -> dict[str, str]:
    """The n-th critical file counts 30, 25, … down to 5 points: in closed form
    30n - 5n(n-1)/2 up to five files and 100 + 5(n-5) beyond."""
    n = "n_critical_files"
    points = f"if({n} <= 5, {n} * 30 - 5 * {n} * ({n} - 1) / 2, {n} * 5 + 75)"
    seen = texts(
        *[
            when(f"first_{c} IS NOT NULL", f"named_struct('at', first_{c}, 'i', {i}, 'name', '{c}')")
            for i, c in enumerate(fixed.CRITICAL_CATEGORIES)
        ]
    )
    return {
        "categories": f"array_sort({seen}).name",
        "affects_core": _seen("core", "api", "database"),
        "critical_score": f"least(100D, {points} + if({_seen('core', 'authentication')}, 20D, 0D))",
    }


def weighted_score(params: RiskParams = RiskParams()) -> str:
    """The weighted sum of the four scores."""
    return "(" + " + ".join(f"{_SCORES[f]} * {params.weights[f]}D" for f in FACTORS) + ")"


def risk_level(score: str, params: RiskParams = RiskParams()) -> str:
    return f"CASE WHEN {score} >= {params.high} THEN 'HIGH' WHEN {score} >= {params.medium} THEN 'MEDIUM' ELSE 'LOW' END"


def review_time(score: str, long: bool = False) -> str:
    def wording(time: str, note: str) -> str:
        return f"'{time} ({note})'" if long else f"'{time}'"

    return (
        f"CASE WHEN {score} >= 75 THEN {wording('2-4 hours', 'thorough review required')}"
        f" WHEN {score} >= 40 THEN {wording('1-2 hours', 'careful review recommended')}"
        f" ELSE {wording('30-60 minutes', 'standard review')} END"
    )


def percent(score: str) -> str:
    return f"concat({round_half_up(score)}, '%')"


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{expression} AS {name}" for name, expression in columns.items()])


def scores(profile: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """All four scores, the overall score and the level, next to the profile."""
    return _with(
        profile,
        {
            **security_score(),
            **complexity_score(),
            **size_score(),
            **critical_score(),
            "overall_score": f"least(100D, greatest(0D, {weighted_score(params)}))",
            "overall_risk": risk_level("overall_score", params),
        },
    )


# --- texts ------------------------------------------------------------------------------


def _explanations() -> dict[str, str]:
    found = "severity security issue(s) found"
    return {
        "security": "CASE WHEN n_critical > 0 THEN concat(n_critical, ' critical security issue(s) found')"
        + "".join(f" WHEN n_{s} > 0 THEN concat(n_{s}, ' {s} {found}')" for s in ("high", "medium", "low"))
        + " ELSE 'No security issues detected' END",
        "complexity": "CASE WHEN n_complex > 0 THEN concat(n_complex, ' file(s) with high complexity')"
        f" WHEN avg_complexity >= {fixed.COMPLEXITY_THRESHOLDS['medium']} THEN 'Moderate code complexity'"
        " ELSE 'Low code complexity' END",
        "changeSize": "CASE WHEN is_too_large THEN 'Large change set - consider splitting'"
        f" WHEN total_files >= {fixed.SIZE_THRESHOLDS['medium_files']} THEN 'Medium-sized change set'"
        " ELSE 'Small, focused change set' END",
        "criticalFiles": "if(n_critical_files > 0, concat(n_critical_files, ' critical file(s) affected'),"
        " 'No critical files affected')",
    }


def _fixed_details() -> dict[str, str]:
    """Details that do not grow with the change set, as arrays."""
    worst = (
        "CASE "
        + " ".join(
            f"WHEN n_{s} > 0 THEN concat(n_{s}, ' {s} severity findings')" for s in ("critical", "high", "medium", "low")
        )
        + " ELSE 'Clean security scan' END"
    )
    some = "n_critical_files > 0"
    return {
        "security": texts(worst, when("has_blocking_issues", "'⚠️ Contains blocking security issues'")),
        "complexity": f"array(concat('Average complexity: ', {one_decimal('avg_complexity')}))",
        "changeSize": texts(
            "concat(total_files, ' files changed')",
            "concat('+', total_additions, ' -', total_deletions, ' lines')",
            when("is_too_large", "split_directory"),
        ),
        "criticalFiles": texts(
            f"if({some}, concat('Categories: ', array_join(categories, ', ')), 'Changes are in non-critical areas')",
            when(f"{some} AND affects_core", "'⚠️ Affects core functionality'"),
        ),
    }


def critical_issues() -> str:
    """Issues that must be dealt with before a merge, as an array."""
    return texts(
        when("n_critical > 0", "concat(n_critical, ' critical security vulnerability(ies) detected')"),
        when("has_blocking_issues", "'Security scan contains blocking issues that prevent merge'"),
        when("n_complex > 3", "concat(n_complex, ' files with very high complexity')"),
        when("total_files > 30", "concat('Large change set (', total_files, ' files) - difficult to review')"),
        when("affects_core AND n_critical_files > 5", "concat(n_critical_files, ' critical system files modified')"),
    )


_SLOT = "Suggested splits: "


def recommendation_array() -> str:
    """The recommendations in order as (slot, text, is_fix); the slot ``types``
    stands for the split by file type, whose entries are rows of their own."""
    security, complexity = "security_score > 50", "complexity_score > 50"
    rules: list[tuple[str, str]] = [
        (f"{security} AND n_critical > 0", "'🚨 CRITICAL: Fix all critical security issues before merging'"),
        (f"{security} AND n_critical > 0", "'Remove hardcoded secrets and use environment variables'"),
        (f"{security} AND n_high > 0", "'⚠️ Address high severity security findings'"),
        (f"{security} AND has_blocking_issues", "'Security scan has blocking issues - review required'"),
        (f"{complexity} AND n_complex > 0", "'Consider refactoring high complexity functions'"),
        (f"{complexity} AND n_complex > 0", "concat('Review these files: ', complex_head)"),
        (complexity, "'Add unit tests for complex logic'"),
        ("is_too_large", "'📦 Consider splitting this PR into smaller, focused changes'"),
        ("is_too_large AND split_directory IS NOT NULL", f"concat('{_SLOT}', split_directory)"),
        ("is_too_large AND split_directory IS NULL AND split_type_fix IS NOT NULL", f"'{_SLOT}'"),
        ("affects_core", "'🔍 Extra review needed - changes affect core functionality'"),
        ("affects_core", "'Ensure comprehensive test coverage for critical changes'"),
        ("overall_risk = 'HIGH'", "'⏰ Schedule thorough code review with senior team members'"),
        ("overall_risk = 'HIGH'", "'Consider staging deployment before production'"),
        ("overall_risk = 'MEDIUM'", "'👀 Standard code review recommended'"),
        ("overall_risk = 'MEDIUM'", "'Verify test coverage is adequate'"),
        ("overall_risk = 'LOW'", "'✅ Low risk - standard review process applies'"),
        ("complexity_score > 30 OR critical_score > 30", "'Add integration tests for changed components'"),
    ]
    items = []
    for condition, text in rules:
        slot = "types" if text == f"'{_SLOT}'" else "text"
        fix = "split_type_fix" if slot == "types" else f"{text} rlike 'Fix|Remove|Add'"
        items.append(when(condition, f"named_struct('slot', '{slot}', 'text', {text}, 'is_fix', {fix})"))
    return texts(*items)


def _factor_array(params: RiskParams) -> str:
    details, explanations = _fixed_details(), _explanations()
    items = [
        f"named_struct('factor_idx', {i}L, 'category', '{f}', 'score', {_SCORES[f]}, 'weight', {params.weights[f]}D,"
        f" 'weighted_score', {_SCORES[f]} * {params.weights[f]}D, 'share', '{_whole_percent(params.weights[f])}',"
        f" 'explanation', {explanations[f]}, 'details', {details[f]})"
        for i, f in enumerate(FACTORS)
    ]
    return f"array({', '.join(items)})"


def _whole_percent(weight: float) -> str:
    return str(Decimal(weight * 100).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def complex_files(facts: DataFrame) -> DataFrame:
    return facts.where(_HIGH_COMPLEXITY).select("change_id", "file_idx", "path")


def assess(
    facts: DataFrame, params: RiskParams = RiskParams(), options: ScanOptions = ScanOptions()
) -> DataFrame:
    """One row per change set: profile, scores, level, and the arrays ``factors``,
    ``recommendations`` and ``critical_issues``, all of bounded size.

    Side tables are aggregated by change set first, so the joins are between
    one-row-per-change-set tables that share a partitioning.
    """
    scored = scores(summary.profile(facts, options), params)
    # At most three entries per group are collected.
    head = (
        first_n(complex_files(facts), 3, ["change_id"], ["file_idx"])
        .groupBy("change_id")
        .agg(F.expr("array_join(array_sort(collect_list(struct(rank, path))).path, ', ') AS complex_head"))
    )
    counts = summary.name_counts(facts)
    joined = (
        scored.join(head, "change_id", "left")
        .join(summary.directory_split(counts), "change_id", "left")
        .join(summary.type_split_marks(counts), "change_id", "left")
    )
    return _with(
        joined,
        {
            "factors": _factor_array(params),
            "recommendations": recommendation_array(),
            "critical_issues": critical_issues(),
        },
    )


def risk_factors(assessment: DataFrame) -> DataFrame:
    """Four rows per change set: ``change_id, factor_idx, category, score, weight,
    weighted_score, explanation, breakdown_text``."""
    breakdown = (
        "concat('### ', category, ' (Weight: ', share, '%)\\n- Score: ', "
        f"{one_decimal('score')}, '/100\\n- Weighted: ', {one_decimal('weighted_score')}, '\\n- ', explanation)"
    )
    return assessment.selectExpr("change_id", "inline(factors)").selectExpr(
        "change_id", "factor_idx", "category", "score", "weight", "weighted_score", "explanation",
        f"{breakdown} AS breakdown_text",
    )


def complex_file_details(facts: DataFrame) -> DataFrame:
    """The entries of the list of complex files: ``change_id, entry_no, path``."""
    return complex_files(facts).selectExpr("change_id", "file_idx + 1 AS entry_no", "path")


COMPLEX_FILES = "High complexity files: "


def risk_details(assessment: DataFrame, facts: DataFrame) -> DataFrame:
    """What stands behind each factor: ``change_id, factor_idx, detail_idx,
    entry_no, detail``.

    Entry 0 is the detail, or the heading of a list of all complex files or file
    types; the entries after it are the list.
    """
    by_factor = assessment.selectExpr("change_id", "inline(factors)")
    fixed_rows = each_with_position(by_factor, ["change_id", "factor_idx"], "details", "detail_idx", "detail")
    heading = assessment.where("n_complex > 0").selectExpr(
        "change_id", "1L AS factor_idx", "1L AS detail_idx", "0L AS entry_no", f"{quote(COMPLEX_FILES)} AS detail"
    )
    file_rows = complex_file_details(facts).selectExpr(
        "change_id", "1L AS factor_idx", "1L AS detail_idx", "entry_no", "path AS detail"
    )
    large = assessment.where("is_too_large").selectExpr(
        "change_id", "if(split_directory IS NULL, 2L, 3L) AS detail_idx"
    )
    types = summary.type_split(summary.name_counts(facts))
    type_rows = lookup(types, large, ["change_id"], spread="entry_no").selectExpr(
        "change_id", "2L AS factor_idx", "detail_idx", "entry_no", "text AS detail"
    )
    return (
        fixed_rows.selectExpr("change_id", "factor_idx", "detail_idx", "0L AS entry_no", "detail")
        .unionByName(heading)
        .unionByName(file_rows)
        .unionByName(type_rows)
    )


def breakdown(assessment: DataFrame, facts: DataFrame) -> DataFrame:
    """The detailed breakdown as lines: ``change_id, factor_idx, line_no,
    entry_no, line``.

    Line 0 of a factor is its head, line 1 says that details follow, the details
    come after it, their lists entry by entry.
    """
    head = risk_factors(assessment).selectExpr(
        "change_id", "factor_idx", "stack(2, 0L, breakdown_text, 1L, 'Details:') AS (line_no, line)"
    )
    details = risk_details(assessment, facts).selectExpr(
        "change_id", "factor_idx", "detail_idx + 2 AS line_no", "entry_no",
        "if(entry_no = 0, concat('  - ', detail), detail) AS line",
    )
    return head.selectExpr("change_id", "factor_idx", "line_no", "0L AS entry_no", "line").unionByName(details)


# --- recommendations --------------------------------------------------------------------


def _filled(assessment: DataFrame, facts: DataFrame, items: str, idx: str, name: str) -> DataFrame:
    """Recommendation rows; the split by type comes as a heading and its entries."""
    rows = each_with_position(assessment, ["change_id"], items, idx, "_r")
    plain = rows.where("_r.slot = 'text'").selectExpr("change_id", idx, "0L AS entry_no", f"_r.text AS {name}")
    slots = rows.where("_r.slot = 'types'").selectExpr("change_id", idx, "_r.text AS _prefix")
    entries = summary.type_split(summary.name_counts(facts))
    filled = lookup(entries, slots, ["change_id"], spread="entry_no").selectExpr(
        "change_id", idx, "entry_no", f"if(entry_no = 0, concat(_prefix, text), text) AS {name}"
    )
    return plain.unionByName(filled)


def recommendations(assessment: DataFrame, facts: DataFrame) -> DataFrame:
    """``change_id, rec_idx, entry_no, recommendation`` in order of the rules."""
    return _filled(assessment, facts, "recommendations", "rec_idx", "recommendation")


def quick_fixes(assessment: DataFrame, facts: DataFrame) -> DataFrame:
    """The first three recommendations that fix, remove or add something:
    ``change_id, fix_idx, entry_no, quick_fix``."""
    fixes = "slice(filter(recommendations, r -> r.is_fix), 1, 3)"
    return _filled(assessment, facts, fixes, "fix_idx", "quick_fix")


def risk_summary(assessment: DataFrame) -> DataFrame:
    """``change_id, level, score, concerns, estimated_review_time``; quick fixes are
    rows of their own."""
    high = "filter(factors, f -> f.score > 50)"
    return assessment.selectExpr(
        "change_id",
        "overall_risk AS level",
        f"{round_half_up('overall_score')} AS score",
        f"slice(transform({high}, f -> concat(f.category, ': ', f.explanation)), 1, 3) AS concerns",
        f"{review_time('overall_score')} AS estimated_review_time",
    )


def merge_gate(assessment: DataFrame) -> DataFrame:
    """``change_id, safe, reason``; the reason is null for safe change sets."""
    reason = (
        "CASE WHEN size(critical_issues) > 0"
        " THEN concat('Critical issues must be resolved: ', get(critical_issues, 0))"
        " WHEN overall_score >= 90 THEN 'Risk score too high - requires significant changes'"
        f" WHEN overall_risk = 'HIGH' THEN {quote('High risk - thorough review and testing required before merge')} END"
    )
    return assessment.selectExpr("change_id", f"{reason} AS reason").selectExpr(
        "change_id", "reason IS NULL AS safe", "reason"
    )


def issues(assessment: DataFrame) -> DataFrame:
    """Critical issues as rows: ``change_id, issue_idx, issue``."""
    return each_with_position(assessment, ["change_id"], "critical_issues", "issue_idx", "issue")


def timestamped(assessment: DataFrame) -> DataFrame:
    """Adds the time of the assessment."""
    return assessment.selectExpr("*", "current_timestamp() AS assessed_at")
