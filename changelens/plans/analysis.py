"""Whole analyses over a table of diffs.

The text is read once: parsing and scanning end in thin facts per file, and
those are cut off from their lineage before several branches use them.  The
model call between prompts and answers is the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from changelens.operators import answers, filters, parse, prompts, report, risk, summary
from changelens.params import FileChoice, RiskParams, ScanOptions
from changelens.sources.diffs import choose_source
from changelens.sources.tables import cut, drop_tables


def facts_of(
    diffs: DataFrame, options: ScanOptions = ScanOptions(), choice: FileChoice = FileChoice()
) -> DataFrame:
    """Diff rows to thin facts per file, in one row-local pass."""
    return summary.file_facts(_files(diffs, choice), options)


def _files(diffs: DataFrame, choice: FileChoice) -> DataFrame:
    return filters.apply_filters(
        parse.parse_files(diffs), choice.include_patterns, choice.exclude_patterns, choice.max_lines_per_file
    )


def quick_summary(
    diffs: DataFrame,
    params: RiskParams = RiskParams(),
    options: ScanOptions = ScanOptions(),
    choice: FileChoice = FileChoice(),
) -> DataFrame:
    """Choose the source, parse, scan, assess: ``change_id, compact_text``.

    Blank diffs and diffs without any file give no row.
    """
    facts = facts_of(choose_source(diffs, choice.staged_only), options, choice)
    scored = risk.scores(summary.profile(facts, options), params)
    return report.compact(scored)


@dataclass(frozen=True)
class Prepared:
    """What the first half of a full analysis leaves for the second.

    ``tables`` are the paths of its intermediate tables; ``drop`` removes them
    when the second half is done.
    """

    facts: DataFrame
    assessment: DataFrame
    chosen: DataFrame
    prompts: DataFrame
    tables: list[str] = field(default_factory=list)

    def drop(self) -> None:
        drop_tables(self.facts.sparkSession, self.tables)


def prepare(
    diffs: DataFrame,
    params: RiskParams = RiskParams(),
    options: ScanOptions = ScanOptions(),
    max_test_files: int = 5,
    choice: FileChoice = FileChoice(),
) -> Prepared:
    """Facts, assessment and prompts; write ``prompts`` out for batch inference.

    ``prompts`` has ``change_id, kind, file_idx, piece_no, prompt``: a prompt for
    tests in one piece, those for titles and descriptions in the pieces that
    ``prompts.assemble`` puts together.
    """
    tables: list[str] = []
    files = _files(choose_source(diffs, choice.staged_only), choice)
    facts = cut(summary.file_facts(files, options, more=prompts.test_context()), "facts", tables)
    assessment = cut(risk.assess(facts, params, options), "assessment", tables)
    chosen = prompts.test_files(facts.where("is_testable"), max_test_files, order="churn")
    by_change = prompts.title_prompts(facts, assessment).unionByName(
        prompts.description_prompts(facts, assessment, options)
    )
    by_file = prompts.test_prompts(chosen).selectExpr("*", "0L AS piece_no")
    return Prepared(
        facts, assessment, chosen, by_change.unionByName(by_file, allowMissingColumns=True), tables
    )


def complete_report(
    prepared: Prepared,
    responses: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
) -> DataFrame:
    """The report lines; without responses the generated sections are left out."""
    if responses is None:
        return report.complete(prepared.assessment, prepared.facts, options=options)
    parsed = answers.parse_responses(responses)
    suggested = answers.suggestions(prepared.chosen, parsed)
    return report.complete(
        prepared.assessment,
        prepared.facts,
        answers.pr_content(parsed),
        answers.combine(suggested),
        answers.suggestion_totals(suggested),
        options,
    )


def analyze(diffs: DataFrame, responses: DataFrame | None = None, params: RiskParams = RiskParams(),
            options: ScanOptions = ScanOptions(), choice: FileChoice = FileChoice()) -> DataFrame:
    """Both halves in one go, for diffs whose answers are already there."""
    return complete_report(prepare(diffs, params, options, choice=choice), responses, options)
