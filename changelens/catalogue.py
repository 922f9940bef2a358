"""The catalogue of queries: name -> function of (session, folder of parquet tables).

Every query runs over whole tables.  Lists come as joined text or as rows, and
numbers as BIGINT or rounded DOUBLE, so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import fixed, paths
from changelens.functions.rows import each
from changelens.functions.text import texts
from changelens.operators import answers, filters, hunk_parts, long_texts, parse, pattern_sets, prompts, report, risk, scan, summary
from changelens.params import RiskParams, ScanOptions, SecretPattern
from changelens.plans import analysis
from changelens.sources import diffs, fixtures, sinks, tables
from changelens.sources.tables import cut, read_table

Query = Callable[[SparkSession, str], DataFrame]

JOIN = " | "

# A user's own pattern, a severity floor and a type to leave out.
CUSTOM = ScanOptions(
    min_severity="MEDIUM",
    exclude_types=("DATABASE_URL",),
    custom_patterns=(
        SecretPattern("INTERNAL_HOST", r"(?:corp|db)\.(?:io|internal)\b", "MEDIUM", 0.6, "Internal host", "Use a name"),
    ),
)
TERM = ScanOptions(custom_patterns=(SecretPattern("TERM", r"\bque\b", "LOW", 0.3),))
MAX_TWO = ScanOptions(max_findings=2)
MAX_TEN = ScanOptions(max_findings=10)
CONTEXT = ScanOptions(include_context=True)
STRICT = RiskParams({"security": 0.5, "complexity": 0.2, "changeSize": 0.2, "criticalFiles": 0.1}, high=60, medium=30)

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def text(values: str | Column) -> Column:
    return F.array_join(values, JOIN)


def rounded(name: str) -> Column:
    """Ten decimals: past every exact decimal that occurs, short of floating-point noise."""
    return F.round(F.col(name), 10).alias(name)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return parse.parse_files(fixtures.parts(spark, folder))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return parse.parse_files(parse.number_parts(fixtures.parts(spark, folder)))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return summary.file_facts(_files(spark, folder))


def _scored(spark: SparkSession, folder: str, params: RiskParams = RiskParams()) -> DataFrame:
    return risk.scores(summary.profile(_facts(spark, folder)), params)


def _assessed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Facts and assessment, for queries in which several branches use them."""
    facts = cut(_facts(spark, folder))
    return facts, cut(risk.assess(facts))


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.test_contexts(_files(spark, folder))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return answers.parse_responses(fixtures.responses(spark, folder))


# --- content scan ---------------------------------------------------------------------------


@query
def scan_documents_findings(spark, folder):
    return scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"])


@query
def scan_severity_by_source(spark, folder):
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["source", "doc_id"])
    return scan.severity_counts(found, ["source"])


@query
def scan_types_by_source(spark, folder):
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["source", "doc_id"])
    return scan.type_counts(found, ["source"]).drop("first_seen")


@query
def scan_custom_pattern(spark, folder):
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"], CUSTOM)
    return found.select("doc_id", "line", "column", "type", "severity", "content")


@query
def scan_high_confidence(spark, folder):
    found = scan.high_confidence(scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"]))
    return found.select("doc_id", "line", "column", "type", "confidence")


@query
def scan_min_severity(spark, folder):
    found = scan.at_least(scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"]), "HIGH")
    return found.select("doc_id", "line", "column", "type", "severity")


@query
def scan_max_findings(spark, folder):
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"], MAX_TWO)
    return found.select("doc_id", "line", "column", "type")


@query
def scan_result_filters(spark, folder):
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"])
    kept = scan.apply_filters(found, ["doc_id"], ScanOptions(min_severity="HIGH", max_findings=1))
    return kept.select("doc_id", "line", "column", "type", "severity")


@query
def scan_context(spark, folder):
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"], CONTEXT)
    return found.select(
        "doc_id", "line", "pattern_idx", "match_idx",
        text("context_before").alias("context_before"), text("context_after").alias("context_after"),
    )


@query
def scan_pattern_sets(spark, folder):
    """Two repositories, each with its own patterns, in one scan."""
    files = fixtures.scan_files(spark, folder).selectExpr("*", "if(doc_id % 2 = 0, 'usual', 'custom') AS repository")
    sets = pattern_sets.pattern_sets(spark, {"usual": ScanOptions(), "custom": CUSTOM})
    found = pattern_sets.scan_with_sets(files, ["doc_id"], sets, "repository")
    return found.select("doc_id", "line", "column", "type", "severity", "content")


@query
def scan_findings_written(spark, folder):
    """Findings as they are read back from the sink, which is written twice."""
    path = tables.new_path(spark, "findings")
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"])
    for _ in range(2):
        sinks.write_rows(found, path, ["severity"], ["doc_id", "line_ord"])
    return spark.read.parquet(path).select("doc_id", "line", "column", "type", "severity")


@query
def scan_context_in_blocks(spark, folder):
    found = long_texts.scan_blocks(fixtures.scan_files(spark, folder), ["doc_id"], CONTEXT, block_lines=16)
    return found.select(
        "doc_id", "line", "pattern_idx", "match_idx",
        text("context_before").alias("context_before"), text("context_after").alias("context_after"),
    )


@query
def scan_finding_text(spark, folder):
    found = scan.finding_text(scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"]))
    return found.select("doc_id", "line", "pattern_idx", "match_idx", "finding_text")


@query
def scan_conversations(spark, folder):
    turns = read_table(spark, folder, "conversations").withColumn(
        "path", F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    )
    found = scan.scan_content(turns, ["conv_id", "turn"], TERM)
    return found.select("conv_id", "turn", "line", "column", "match_idx", "type", "content")


@query
def scan_pages(spark, folder):
    pages = read_table(spark, folder, "pages")
    return scan.scan_content(pages, ["page_id"], path="url", text="html").select(
        "page_id", "line", "column", "type", "content"
    )


@query
def active_patterns(spark, folder):
    return scan.active_patterns(fixtures.scan_files(spark, folder), ["doc_id"])


def _pattern_hits(spark, folder, choose) -> DataFrame:
    found = scan.scan_content(fixtures.scan_files(spark, folder), ["doc_id"])
    counts = found.groupBy("pattern_idx").agg(F.count("*").alias("n"))
    # The pattern table has one row per pattern.
    chosen = F.broadcast(choose(scan.pattern_table(spark)).select("pattern_idx", "type", "severity", "confidence"))
    return chosen.join(counts, "pattern_idx", "left").select(
        "pattern_idx", "type", "severity", "confidence", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def pattern_hits_by_severity(spark, folder):
    return _pattern_hits(spark, folder, lambda p: scan.by_severity(p, "HIGH"))


@query
def pattern_hits_by_type(spark, folder):
    return _pattern_hits(spark, folder, lambda p: scan.by_type(p, "API_KEY"))


@query
def pattern_hits_high_confidence(spark, folder):
    return _pattern_hits(spark, folder, scan.high_confidence)


@query
def pattern_hits_critical(spark, folder):
    return _pattern_hits(spark, folder, scan.critical_patterns)


# --- diffs ------------------------------------------------------------------------------------


@query
def diff_source_choice(spark, folder):
    chosen = diffs.choose_source(fixtures.diffs(spark, folder))
    return chosen.select("change_id", "part_idx", "source_kind", "base_branch", F.md5("diff_text").alias("digest"))


@query
def diff_source_staged_only(spark, folder):
    chosen = diffs.choose_source(fixtures.diffs(spark, folder), staged_only=True)
    return chosen.select("change_id", "part_idx", "source_kind", F.md5("diff_text").alias("digest"))


@query
def diff_files(spark, folder):
    return _numbered(spark, folder).select(
        "change_id", "file_idx", "path", "old_path", "status", "language", "binary", "additions", "deletions",
        "n_hunks", "parse_warning",
    )


@query
def diff_hunks(spark, folder):
    return parse.hunks(_numbered(spark, folder))


@query
def diff_changes(spark, folder):
    return parse.changes(_numbered(spark, folder))


@query
def diff_nested(spark, folder):
    """The nested view: a file's hunks with their lines, and its added lines, each as a digest."""
    line = "concat_ws(':', c.change_idx, c.line_number, coalesce(cast(c.old_line_number as string), ''), c.type, c.content)"
    head = "concat_ws(',', h.hunk_idx, h.old_start, h.old_lines, h.new_start, h.new_lines)"
    lines = f"array_join(transform(h.changes, c -> {line}), chr(10))"
    return _files(spark, folder).selectExpr(
        "change_id",
        "file_idx",
        "cast(size(hunks) as bigint) AS n_hunks",
        "aggregate(hunks, 0L, (n, h) -> n + size(h.changes)) AS n_changes",
        "cast(size(added) as bigint) AS n_added",
        f"md5(array_join(transform(hunks, h -> concat({head}, chr(10), {lines})), chr(10))) AS hunks_md5",
        "md5(array_join(transform(added, a -> concat_ws(':', a.line_number, a.content)), chr(10))) AS added_md5",
    )


@query
def diff_part_files(spark, folder):
    return hunk_parts.parse_hunk_parts(fixtures.hunk_parts(spark, folder)).files


@query
def diff_part_changes(spark, folder):
    return hunk_parts.parse_hunk_parts(fixtures.hunk_parts(spark, folder)).changes()


@query
def diff_stat(spark, folder):
    return summary.diff_stat(_files(spark, folder))


@query
def changed_files(spark, folder):
    return summary.changed_files(_files(spark, folder))


INCLUDE, EXCLUDE, CAP = ("src/*", "*.md", "*_1?.js", "app/*"), ("*handler*", "docs/*5.md"), 6


@query
def glob_include(spark, folder):
    return filters.include(_files(spark, folder), INCLUDE).select("change_id", "file_idx", "path")


@query
def glob_exclude(spark, folder):
    return filters.exclude(_files(spark, folder), EXCLUDE).select("change_id", "file_idx", "path")


@query
def line_cap(spark, folder):
    return parse.changes(filters.cap_lines(_files(spark, folder), CAP))


@query
def file_filters(spark, folder):
    kept = filters.apply_filters(_files(spark, folder), INCLUDE, EXCLUDE, CAP)
    return summary.file_facts(kept).select(
        "change_id", "file_idx", "path", "additions", "deletions", "n_hunks", rounded("complexity")
    )


@query
def added_lines(spark, folder):
    return parse.added_lines(_files(spark, folder)).drop("line_number")


@query
def deleted_lines(spark, folder):
    return parse.deleted_lines(_files(spark, folder)).drop("line_number")


def _wanted(spark, folder) -> DataFrame:
    """Paths of the documents that are labelled toxic."""
    toxic = read_table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id")
    return fixtures.scan_files(spark, folder).join(toxic, "doc_id", "left_semi").select("change_id", "path")


@query
def wanted_files(spark, folder):
    return filters.wanted_files(_files(spark, folder), _wanted(spark, folder)).select(
        "change_id", "file_idx", "path", "status"
    )


@query
def contains_file(spark, folder):
    wanted = _wanted(spark, folder)
    absent = wanted.withColumn("path", F.concat(F.col("path"), F.lit(".bak")))
    return filters.contains_file(_files(spark, folder), wanted.unionByName(absent))


@query
def file_by_path(spark, folder):
    return filters.file_by_path(_files(spark, folder), "docs/doc_9.md").select("change_id", "file_idx", "path", "status")


@query
def path_metadata(spark, folder):
    return summary.with_metadata(_files(spark, folder).select("change_id", "file_idx", "path"))


@query
def path_categories(spark, folder):
    critical = _files(spark, folder).where(paths.is_critical())
    names = texts(*[f"if({paths.in_category(c)}, '{c}', null)" for c in fixed.CRITICAL_CATEGORIES])
    return each(critical, ["change_id", "file_idx", "path"], names, "category")


# --- change sets ----------------------------------------------------------------------------


@query
def change_totals(spark, folder):
    return summary.change_totals(_files(spark, folder))


@query
def change_summary(spark, folder):
    return summary.profile(_facts(spark, folder)).select(
        "change_id", "base_branch", "total_files", "n_added", "n_modified", "n_deleted", "n_renamed",
        "n_critical_files", "n_test_files", "n_config_files",
    )


@query
def change_path_lists(spark, folder):
    return summary.path_lists(_facts(spark, folder)).select("change_id", "list", "file_idx", "path")


@query
def change_path_texts(spark, folder):
    return summary.path_list_texts(cut(_facts(spark, folder).select("change_id", "file_idx", "path", "old_path", "status",
                                                                    "is_critical", "is_test", "is_config")))


@query
def change_list_heads(spark, folder):
    return summary.list_heads(cut(_facts(spark, folder).select("change_id", "file_idx", "path", "old_path", "status",
                                                               "is_critical", "is_test", "is_config"))).select("change_id", "list", "size", text("head").alias("head"))


@query
def languages(spark, folder):
    return summary.languages(_files(spark, folder)).select("change_id", text("languages").alias("languages"))


@query
def files_per_directory(spark, folder):
    return summary.group_counts(_files(spark, folder), "directory")


@query
def files_per_extension(spark, folder):
    return summary.group_counts(_files(spark, folder), "extension")


@query
def split_suggestions(spark, folder):
    return summary.split_suggestions(_files(spark, folder))


@query
def diff_findings(spark, folder):
    return scan.scan_diff(_files(spark, folder))


@query
def diff_context(spark, folder):
    return scan.scan_diff(_files(spark, folder), CONTEXT).select(
        "change_id", "file_idx", "line", "pattern_idx", "match_idx",
        text("context_before").alias("context_before"), text("context_after").alias("context_after"),
    )


@query
def diff_max_findings(spark, folder):
    return scan.scan_diff(_files(spark, folder), MAX_TEN).select(
        "change_id", "file_idx", "line", "column", "type", "severity"
    )


@query
def diff_scan_summary(spark, folder):
    facts = cut(_facts(spark, folder).select("change_id", "file_idx", "path", "additions", "deletions", "findings"))
    found = scan.explode_findings(facts, parse.FILE_KEY, limit_keys=["change_id"])
    kinds = F.transform(
        F.array_sort(F.map_entries("by_type")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return scan.scan_summary(summary.change_totals(facts), found).withColumn("by_type", text(kinds))


@query
def diff_top_findings(spark, folder):
    return report.top_findings(scan.scan_diff(_files(spark, folder))).select(
        "change_id", "rank", "file", "line", "column", "type", "severity"
    )


@query
def diff_type_order(spark, folder):
    counts = scan.type_counts(scan.scan_diff(_files(spark, folder)), ["change_id"])
    return counts.select(
        "change_id", "type", "n", F.col("first_seen.p").cast("bigint").alias("seen_priority"),
        F.col("first_seen.file_idx").alias("seen_file"), F.col("first_seen.line_ord").alias("seen_line"),
    )


# --- risk ---------------------------------------------------------------------------------------


@query
def file_complexity(spark, folder):
    return _facts(spark, folder).select("change_id", "file_idx", rounded("complexity"))


@query
def risk_security(spark, folder):
    return _scored(spark, folder).select(
        "change_id", "n_critical", "n_high", "n_medium", "n_low", "n_findings", rounded("security_score"),
        "has_blocking_issues",
    )


@query
def risk_complexity(spark, folder):
    return _scored(spark, folder).select(
        "change_id", rounded("avg_complexity"), rounded("max_complexity"), "n_complex", rounded("complexity_score")
    )


@query
def risk_size(spark, folder):
    return _scored(spark, folder).select(
        "change_id", "total_files", "total_additions", "total_deletions", "net_lines", rounded("size_score"), "is_too_large"
    )


@query
def risk_critical(spark, folder):
    return _scored(spark, folder).select(
        "change_id", "n_critical_files", F.array_join("categories", ", ").alias("categories"), rounded("critical_score"),
        "affects_core",
    )


@query
def risk_overall(spark, folder):
    scored = _scored(spark, folder)
    return scored.selectExpr(
        "change_id", "round(overall_score, 10) AS overall_score", "overall_risk",
        f"round({risk.weighted_score()}, 10) AS weighted_score",
        f"{risk.percent('overall_score')} AS percent",
        f"{risk.review_time('overall_score', long=True)} AS review_time",
    )


@query
def risk_custom_weights(spark, folder):
    return _scored(spark, folder, STRICT).select("change_id", rounded("overall_score"), "overall_risk")


@query
def risk_factors(spark, folder):
    _, assessed = _assessed(spark, folder)
    return risk.risk_factors(assessed).select(
        "change_id", "factor_idx", "category", rounded("score"), "weight", rounded("weighted_score"), "explanation"
    )


@query
def risk_breakdown(spark, folder):
    facts, assessed = _assessed(spark, folder)
    return risk.breakdown(assessed, facts)


@query
def risk_details(spark, folder):
    facts, assessed = _assessed(spark, folder)
    return risk.risk_details(assessed, facts)


@query
def risk_recommendations(spark, folder):
    facts, assessed = _assessed(spark, folder)
    return risk.recommendations(assessed, facts)


@query
def risk_quick_fixes(spark, folder):
    facts, assessed = _assessed(spark, folder)
    return risk.quick_fixes(assessed, facts)


@query
def risk_issues(spark, folder):
    _, assessed = _assessed(spark, folder)
    return risk.issues(assessed)


@query
def risk_summary(spark, folder):
    _, assessed = _assessed(spark, folder)
    return risk.risk_summary(assessed).withColumn("concerns", text("concerns"))


@query
def merge_gate(spark, folder):
    _, assessed = _assessed(spark, folder)
    return risk.merge_gate(assessed)


# --- prompts ---------------------------------------------------------------------------------------


@query
def main_changes(spark, folder):
    profile = summary.profile(_facts(spark, folder))
    return profile.selectExpr(
        "change_id", f"{prompts.main_changes()} AS main_changes",
        f"array_join({prompts.change_patterns()}, '{JOIN}') AS patterns",
    )


@query
def key_changes(spark, folder):
    return prompts.key_changes(_files(spark, folder))


@query
def security_issue_lines(spark, folder):
    facts = cut(_facts(spark, folder))
    profile = summary.profile(facts).join(prompts.top_types(facts), "change_id", "left")
    return profile.selectExpr("change_id", rf"array_join({prompts.security_issues()}, '\n- ') AS lines")


@query
def title_prompt(spark, folder):
    facts = cut(_facts(spark, folder))
    return prompts.title_prompts(facts, summary.profile(facts))


@query
def description_prompt(spark, folder):
    facts = cut(_facts(spark, folder))
    return prompts.description_prompts(facts, summary.profile(facts))


@query
def testable_files(spark, folder):
    return _contexts(spark, folder).select("change_id", "file_idx", "path", "test_language")


@query
def test_file_choice(spark, folder):
    return prompts.test_files(_contexts(spark, folder)).select("change_id", "file_rank", "file_idx", "path")


@query
def test_file_choice_input_order(spark, folder):
    return prompts.test_files(_contexts(spark, folder), 3, order="input").select(
        "change_id", "file_rank", "file_idx", "path"
    )


@query
def function_names(spark, folder):
    return _contexts(spark, folder).select("change_id", "file_idx", F.posexplode("functions").alias("p", "name")).select(
        "change_id", "file_idx", F.col("p").cast("bigint").alias("name_idx"), "name"
    )


@query
def code_snippets(spark, folder):
    return _contexts(spark, folder).select("change_id", "file_idx", F.posexplode("snippets").alias("p", "snippet")).select(
        "change_id", "file_idx", F.col("p").cast("bigint").alias("snippet_idx"), "snippet"
    )


@query
def test_prompt(spark, folder):
    patterns = "transform(slice(functions, 1, 2), f -> concat('checks ', f)) AS existing_patterns"
    return prompts.test_prompts(prompts.test_files(_contexts(spark, folder)).selectExpr("*", patterns))


# --- answers ------------------------------------------------------------------------------------------


@query
def answers_parsed(spark, folder):
    return _parsed(spark, folder).select(
        "change_id", "kind", "file_idx", "status", "text", "model", "tokens_input", "tokens_output", "tokens_total",
        "duration_ms",
    )


@query
def call_stats(spark, folder):
    stats = answers.call_stats(_parsed(spark, folder), "kind")
    return stats.withColumn("success_rate", F.round("success_rate", 10))


@query
def titles(spark, folder):
    return answers.titles(_parsed(spark, folder)).drop("errors")


@query
def title_errors(spark, folder):
    return answers.titles(_parsed(spark, folder)).select("change_id", "title", text("errors").alias("errors"))


@query
def descriptions(spark, folder):
    return answers.descriptions(_parsed(spark, folder)).withColumn("breaking_changes", text("breaking_changes"))


@query
def pr_texts(spark, folder):
    return answers.pr_content(_parsed(spark, folder)).select("change_id", "pr_text")


def _suggested(spark, folder) -> DataFrame:
    return answers.suggestions(prompts.test_files(_contexts(spark, folder)), _parsed(spark, folder))


@query
def test_suggestions(spark, folder):
    return answers.combine(_suggested(spark, folder)).drop("file_rank")


@query
def suggestion_totals(spark, folder):
    files = cut(_files(spark, folder).selectExpr("change_id", "file_idx", "path", "language", "additions", "deletions",
                                                 f"{paths.is_testable()} AS is_testable"))
    chosen = prompts.test_files(files.where("is_testable"))
    suggested = answers.suggestions(chosen, _parsed(spark, folder))
    every = files.groupBy("change_id").agg(F.expr("max(is_testable) AS some"))
    return answers.suggestion_totals(suggested, every.where("NOT some"))


@query
def suggestion_texts(spark, folder):
    return answers.suggestion_text(answers.combine(_suggested(spark, folder))).select(
        "change_id", "type", "number", "suggestion_text"
    )


# --- reports --------------------------------------------------------------------------------------------


@query
def compact_report(spark, folder):
    return analysis.quick_summary(fixtures.diffs(spark, folder))


@query
def compact_report_with_title(spark, folder):
    return report.compact(_scored(spark, folder), answers.titles(_parsed(spark, folder)))


@query
def report_without_answers(spark, folder):
    facts, assessed = _assessed(spark, folder)
    return report.complete(assessed, facts)


@query
def report_lines(spark, folder):
    return analysis.analyze(fixtures.diffs(spark, folder), fixtures.responses(spark, folder))
