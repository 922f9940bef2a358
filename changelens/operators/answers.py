"""Generated answers to titles, descriptions and test suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import fixed, paths
from changelens.functions.regex import java
from changelens.functions.rows import each_with_position
from changelens.functions.sql import either, quote
from changelens.functions.text import all_matches, first_match, non_empty, texts, trim, when

_ANSWER = (
    "model_id string, results array<struct<generated_text string, generated_token_count bigint, "
    "input_token_count bigint, stop_reason string>>, created_at string"
)


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``status, text, model, tokens_input, tokens_output, tokens_total``.

    The first result counts.  ``status`` is ``ok``, ``no results`` or ``no
    text``; only ok rows have a text.
    """
    kept = [c for c in responses.columns if c != raw]
    status = (
        "CASE WHEN _first IS NULL THEN 'no results'"
        f" WHEN NOT ({non_empty('_first.generated_text')}) THEN 'no text' ELSE 'ok' END"
    )
    sent = "coalesce(_first.input_token_count, 0L)"
    made = "coalesce(_first.generated_token_count, 0L)"
    return (
        responses.selectExpr(*kept, f"from_json({raw}, {quote(_ANSWER)}) AS _a")
        .selectExpr(*kept, "_a.model_id AS _model", "get(_a.results, 0) AS _first")
        .selectExpr(
            *kept,
            f"{status} AS status",
            f"if(status = 'ok', {trim('_first.generated_text')}, null) AS text",
            "if(status = 'ok', _model, null) AS model",
            f"if(status = 'ok', {sent}, null) AS tokens_input",
            f"if(status = 'ok', {made}, null) AS tokens_output",
            f"if(status = 'ok', {sent} + {made}, null) AS tokens_total",
        )
    )


def call_stats(parsed: DataFrame, *keys: str) -> DataFrame:
    """Calls in total, good, bad, and the rate of good ones (zero without calls)."""
    return parsed.groupBy(*keys).agg(
        F.expr("count(*) AS total_requests"),
        F.expr("count_if(status = 'ok') AS successful_requests"),
        F.expr("count_if(status <> 'ok') AS failed_requests"),
        F.expr("coalesce(try_divide(count_if(status = 'ok'), count(*)), 0D) AS success_rate"),
    )


def utf16_length(text: str) -> str:
    return f"octet_length(encode({text}, 'UTF-16BE')) div 2"


# --- titles ---------------------------------------------------------------------------------

_CONVENTIONAL = java(rf"^({fixed.TITLE_TYPES})(\(.+\))?: .+")
_TITLE_PARTS = java(rf"^({fixed.TITLE_TYPES})(?:\(([^)]+)\))?: (.+)$")


def clean_title(text: str) -> str:
    """White space, one quote at each end and closing punctuation taken off."""
    ends = r"""^["']|["']\z"""
    unquoted = f"regexp_replace({trim(text)}, {quote(ends)}, '')"
    return f"regexp_replace({unquoted}, {quote('[.!?]+' + chr(92) + 'z')}, '')"


def title_errors(title: str) -> str:
    """What is wrong with a title, as an array."""
    length = utf16_length(title)
    return texts(
        when(f"{length} > {fixed.TITLE_MAX}", quote(fixed.TITLE_ERRORS["long"])),
        when(f"{length} < {fixed.TITLE_MIN}", quote(fixed.TITLE_ERRORS["short"])),
        when(f"NOT {title} rlike {quote(_CONVENTIONAL)}", quote(fixed.TITLE_ERRORS["format"])),
    )


def titles(parsed: DataFrame) -> DataFrame:
    """One row per usable title answer: ``change_id, title, type, scope, description,
    is_conventional, length, errors``.  Titles with errors are kept."""
    rows = parsed.where("kind = 'title' AND status = 'ok'")
    return rows.selectExpr("change_id", f"{clean_title('text')} AS title").selectExpr(
        "change_id",
        "title",
        f"{first_match('title', _TITLE_PARTS, 1)} AS type",
        f"nullif(regexp_extract(title, {quote(_TITLE_PARTS)}, 2), '') AS scope",
        f"{first_match('title', _TITLE_PARTS, 3)} AS description",
        f"title rlike {quote(_TITLE_PARTS)} AS is_conventional",
        f"{utf16_length('title')} AS length",
        f"{title_errors('title')} AS errors",
    )


# --- descriptions ----------------------------------------------------------------------------


def _section(heading: str) -> str:
    pattern = java(rf"##\s*{heading}\s*\n([\s\S]*?)(?=##|$)", ignore_case=True)
    return trim(f"regexp_extract(text, {quote(pattern)}, 1)")


def descriptions(parsed: DataFrame) -> DataFrame:
    """One row per usable description answer: ``change_id, what_changed,
    why_changed, impact, breaking_changes``; without sections all text is what changed."""
    rows = parsed.where("kind = 'description' AND status = 'ok'")
    prefix = quote(r"\A" + java(fixed.BREAKING_CHANGE, ignore_case=True))
    found = all_matches("text", java(fixed.BREAKING_CHANGE + "(.+)", ignore_case=True))
    plain = trim(f"regexp_replace(m, {prefix}, '')")
    return rows.selectExpr(
        "change_id",
        "text",
        f"{_section('What Changed')} AS _what",
        f"{_section('Why')} AS why_changed",
        f"{_section('Impact')} AS impact",
        f"transform({found}, m -> {plain}) AS breaking_changes",
    ).selectExpr(
        "change_id",
        "if(_what = '' AND why_changed = '' AND impact = '', text, _what) AS what_changed",
        "why_changed",
        "impact",
        "breaking_changes",
    )


def pr_content(parsed: DataFrame) -> DataFrame:
    """Title and description of change sets that have both, with ``pr_text``."""
    both = titles(parsed).withColumnRenamed("description", "title_description").join(descriptions(parsed), "change_id")

    def section(heading: str, column: str) -> str:
        return when(non_empty(column), rf"concat('## {heading}\n\n', {column})")

    listed = r"array_join(transform(breaking_changes, c -> concat('- ', c)), '\n')"
    parts = [
        "concat('# ', title)",
        section("What Changed", "what_changed"),
        section("Why", "why_changed"),
        section("Impact", "impact"),
        when("size(breaking_changes) > 0", rf"concat('## Breaking Changes\n\n', {listed})"),
    ]
    return both.selectExpr("*", rf"concat_ws('\n\n', {', '.join(parts)}) AS pr_text")


# --- test suggestions -------------------------------------------------------------------------


def test_blocks(text: str) -> str:
    """Fenced blocks, else ``describe(`` blocks, else paragraphs, as an array."""
    fenced = all_matches(text, r"```[\s\S]*?```")
    described = all_matches(text, java(r"describe\([^)]+\)[\s\S]*?(?=describe\(|$)"))
    paragraphs = rf"filter(split({text}, '\n\n', -1), b -> {non_empty(trim('b'))})"
    return (
        f"CASE WHEN size({fenced}) > 0 THEN {fenced} WHEN size({described}) > 0 THEN {described}"
        f" ELSE {paragraphs} END"
    )


def test_type(block: str) -> str:
    def has(words: list[str]) -> str:
        return either(f"contains(lower({block}), '{word}')" for word in words)

    return (
        f"CASE WHEN {has(fixed.INTEGRATION_WORDS)} THEN 'integration' WHEN {has(fixed.E2E_WORDS)} THEN 'e2e'"
        " ELSE 'unit' END"
    )


def scenario(block: str) -> str:
    said = first_match(block, r"(?i:should|when|given)[\s\S]{0,100}", 0)
    line = rf"nullif(substring(substring_index({block}, '\n', 1), 1, 100), '')"
    return f"coalesce({trim(said)}, {line}, 'Test scenario')"


def suggestions(chosen: DataFrame, parsed: DataFrame, include_snippets: bool = True) -> DataFrame:
    """Test suggestions from the answers for the chosen files: ``change_id,
    file_idx, file_rank, block_idx, type, description, scenario, code_snippet,
    framework, priority``.

    A change set with a failed or missing answer has none.  An answer without
    any block gives two general suggestions.  The files are read once.
    """
    answers = parsed.where("kind = 'tests'").selectExpr(
        "change_id", "file_idx", "if(status = 'ok', text, null) AS _answer"
    )
    files = chosen.select("change_id", "file_idx", "file_rank", "path", "language")
    keep = ["change_id", "file_idx", "file_rank"]
    # The window covers the few chosen files of a change set.
    answered = (
        files.join(answers, ["change_id", "file_idx"], "left")
        .selectExpr("*", "min(_answer IS NOT NULL) OVER (PARTITION BY change_id) AS _complete")
        .where("_complete")
        .selectExpr(*keep, "path", f"{paths.test_framework()} AS framework", f"{test_blocks('_answer')} AS _blocks")
    )
    body = "regexp_extract(_b, " + quote(r"```(?:[0-9A-Za-z_]+)?\n([\s\S]*?)```") + ", 1)"
    snippet = f"if({body} <> '', {trim(body)}, {trim('_b')})" if include_snippets else "cast(null as string)"
    said = first_match("_b", r"""it\(['"]([^'"]+)['"]""", 1)
    # an answer without blocks has two empty ones, which stand for the general suggestions
    blocks = answered.selectExpr(
        *keep, "path", "framework", "size(_blocks) = 0 AS _general",
        "if(size(_blocks) = 0, array('', ''), _blocks) AS _some",
    )
    rows = each_with_position(blocks, [*keep, "path", "framework", "_general"], "_some", "block_idx", "_b")

    def general(values: list[str]) -> str:
        return f"element_at(array({', '.join(values)}), cast(block_idx as int) + 1)"

    told = [f"concat('Test ', path, ' {what}')" for what, _, _ in fixed.GENERAL_SUGGESTIONS]
    how = [f"'{text}'" for _, text, _ in fixed.GENERAL_SUGGESTIONS]
    rank = [f"{priority}L" for _, _, priority in fixed.GENERAL_SUGGESTIONS]
    priorities = " ".join(f"WHEN '{k}' THEN {v}L" for k, v in fixed.PRIORITY_BY_TEST_TYPE.items())
    return rows.selectExpr(
        *keep,
        "block_idx",
        f"if(_general, 'unit', {test_type('_b')}) AS type",
        f"if(_general, {general(told)}, coalesce({said}, 'Test case')) AS description",
        f"if(_general, {general(how)}, {scenario('_b')}) AS scenario",
        f"if(_general, null, {snippet}) AS code_snippet",
        "framework",
        f"if(_general, {general(rank)}, CASE type {priorities} END) AS priority",
    )


def combine(suggested: DataFrame) -> DataFrame:
    """Numbers the suggestions of a change set by type, highest priority first.

    A group is bounded: it comes from the answers for a few files of one change set.
    """
    order = "PARTITION BY change_id, type ORDER BY priority DESC, file_rank, block_idx"
    return suggested.selectExpr("*", f"cast(row_number() OVER ({order}) as bigint) AS number")


def suggestion_totals(suggested: DataFrame, untestable: DataFrame | None = None) -> DataFrame:
    """``change_id, total_suggestions, n_unit, n_integration, n_e2e,
    coverage_improvement``; change sets of ``untestable`` (``change_id``), those
    without a file to suggest tests for, have zeros."""
    kinds = fixed.COVERAGE_BY_TEST_TYPE
    types = suggested.select("change_id", "type")
    if untestable is not None:
        none = untestable.selectExpr("change_id", "cast(null as string) AS type").distinct()
        types = types.unionByName(none)
    counted = types.groupBy("change_id").agg(
        F.expr("count(type) AS total_suggestions"), *[F.expr(f"count_if(type = '{k}') AS n_{k}") for k in kinds]
    )
    points = " + ".join(f"n_{k} * {p}" for k, p in kinds.items())
    return counted.selectExpr("*", f"cast(least({fixed.COVERAGE_CAP}, {points}) as bigint) AS coverage_improvement")


def suggestion_text(combined: DataFrame) -> DataFrame:
    """Adds ``suggestion_text``, the printed form of a numbered suggestion."""
    parts = [
        "concat('### ', number, '. ', description)",
        "concat('**Scenario:** ', scenario)",
        when("type <> 'e2e'", "concat('**Framework:** ', framework)"),
        when("type = 'unit'", "concat('**Priority:** ', priority)"),
        when(non_empty("code_snippet"), r"concat('```typescript\n', code_snippet, '\n```')"),
    ]
    return combined.selectExpr("*", rf"concat_ws('\n\n', {', '.join(parts)}) AS suggestion_text")
