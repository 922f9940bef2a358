"""Prompt columns for batch inference, built from parsed change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import fixed, paths
from changelens.functions.regex import java
from changelens.functions.rows import first_n
from changelens.functions.sql import quote
from changelens.functions.template import around, fill, number_text
from changelens.functions.text import texts, when
from changelens.operators import scan, summary
from changelens.operators.parse import FILE_KEY
from changelens.params import ScanOptions

# --- change-set contexts: expressions over a profile row -------------------------------------


def _counted(n: str, before: str, after: str) -> str:
    return when(f"{n} > 0", f"concat('{before}', {n}, '{after}')")


def main_changes() -> str:
    """"Added n file(s), Modified …", zero parts left out."""
    return "concat_ws(', ', " + ", ".join(
        [
            _counted("n_added", "Added ", " file(s)"),
            _counted("n_modified", "Modified ", " file(s)"),
            _counted("n_deleted", "Deleted ", " file(s)"),
            _counted("n_critical_files", "", " critical file(s) affected"),
        ]
    ) + ")"


def change_patterns() -> str:
    """What kind of change this is, as an array of texts."""
    found = texts(
        when("n_added > n_deleted", "'New feature implementation'"),
        when("n_modified > n_added AND n_deleted > 0", "'Code refactoring'"),
        _counted("n_test_files", "Test coverage updates (", " test files)"),
        _counted("n_config_files", "Configuration changes (", " config files)"),
        when("n_modified_docs > 0", "'Documentation updates'"),
    )
    return f"if(size({found}) > 0, {found}, array('General code changes'))"


# Most changed lines first, then file order.
CHURN_ORDER = ["additions + deletions DESC", "file_idx"]


def key_changes(files: DataFrame, n: int = 5) -> DataFrame:
    """The most changed files: ``change_id, rank, path, change``."""
    change = (
        "concat(status, ': +', additions, ' -', deletions, ' (', additions + deletions, ' lines changed)') AS change"
    )
    thin = files.select(*FILE_KEY, "path", "status", "additions", "deletions")
    return first_n(thin, n, ["change_id"], CHURN_ORDER).selectExpr("change_id", "rank", "path", change)


def top_types(facts: DataFrame, options: ScanOptions = ScanOptions(), n: int = 3) -> DataFrame:
    """The most frequent issue types as one text: ``change_id, top_types``."""
    findings = scan.explode_findings(facts, FILE_KEY, options, ["change_id"])
    counts = scan.type_counts(findings, ["change_id"])
    label = "concat(type, ': ', n) AS label"
    # At most n entries per group are collected.
    return (
        first_n(counts, n, ["change_id"], ["n DESC", "first_seen"])
        .groupBy("change_id")
        .agg(F.expr(f"array_join(array_sort(collect_list(struct(rank, {label}))).label, ', ') AS top_types"))
    )


def security_issues() -> str:
    """The security lines of a description prompt, as an array; needs ``top_types``."""
    return texts(
        _counted("n_critical", "⚠️ ", " CRITICAL security issue(s) found"),
        _counted("n_high", "⚠️ ", " HIGH severity security issue(s) found"),
        "concat('Issue types: ', top_types)",
    )


# --- prompts ------------------------------------------------------------------------------


#: What stands between two files in a prompt.
SEPARATORS = {"title": ", ", "description": "\n"}
#: Number of the piece after the files.
LAST_PIECE = (1 << 63) - 1


def _in_pieces(
    rows: DataFrame, context: DataFrame, template: str, values: dict[str, str], kind: str, line: str
) -> DataFrame:
    """A prompt whose ``{{files}}`` lists all files, a piece for each:
    ``change_id, kind, piece_no, prompt``.

    Piece 0 is what stands before the files, ``LAST_PIECE`` what stands after
    them.  ``assemble`` puts them together.
    """
    before, after = around(template, "files")
    ends = context.selectExpr(
        "change_id", f"stack(2, 0L, {fill(before, values)}, {LAST_PIECE}L, {fill(after, values)}) AS (piece_no, prompt)"
    )
    files = rows.selectExpr("change_id", "file_idx + 1 AS piece_no", f"{line} AS prompt")
    return ends.unionByName(files).selectExpr("change_id", f"'{kind}' AS kind", "piece_no", "prompt")


def assemble(pieces: DataFrame) -> DataFrame:
    """Whole prompts of the pieces: ``change_id, kind, prompt``.

    One value holds all of a prompt, so this is for change sets whose file lists
    a model could take in; choose them first where others occur.
    """
    kinds = " ".join(f"WHEN '{k}' THEN {quote(s)}" for k, s in SEPARATORS.items())
    ordered = "array_sort(collect_list(struct(piece_no, prompt)))"
    joined = (
        f"concat(element_at(p, 1).prompt, array_join(transform(slice(p, 2, greatest(size(p) - 2, 0)), x -> x.prompt),"
        f" CASE kind {kinds} END), element_at(p, -1).prompt)"
    )
    rows = pieces.groupBy("change_id", "kind").agg(F.expr(f"{ordered} AS p"))
    return rows.selectExpr("change_id", "kind", f"{joined} AS prompt")


def title_prompts(facts: DataFrame, profile: DataFrame) -> DataFrame:
    """``change_id, kind, piece_no, prompt`` for titles."""
    context = profile.join(summary.languages(facts), "change_id", "left").selectExpr(
        "change_id",
        f"{number_text('total_additions')} AS _additions",
        f"{number_text('total_deletions')} AS _deletions",
        "array_join(languages, ', ') AS _languages",
        f"{main_changes()} AS _main",
    )
    values = {"additions": "_additions", "deletions": "_deletions", "languages": "_languages", "mainChanges": "_main"}
    return _in_pieces(facts, context, fixed.TITLE_PROMPT, values, "title", "path")


def description_prompts(facts: DataFrame, profile: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``change_id, kind, piece_no, prompt`` for descriptions."""
    change = r"concat('File: ', path, '\n', change) AS text"
    # At most five entries per group are collected.
    keys = (
        key_changes(facts)
        .groupBy("change_id")
        .agg(F.expr(rf"array_join(array_sort(collect_list(struct(rank, {change}))).text, '\n\n') AS _keys"))
    )
    context = (
        profile.join(top_types(facts, options), "change_id", "left")
        .join(keys, "change_id", "left")
        .selectExpr(
            "change_id",
            "_keys",
            rf"array_join({change_patterns()}, '\n- ') AS _patterns",
            rf"array_join({security_issues()}, '\n- ') AS _security",
        )
    )
    values = {"keyChanges": "_keys", "patterns": "_patterns", "securityIssues": "_security"}
    line = "concat('- ', path, ' (', status, '): +', additions, ' -', deletions)"
    return _in_pieces(facts, context, fixed.DESCRIPTION_PROMPT, values, "description", line)


# --- test prompts: row-local, one file each ---------------------------------------------------


def function_names() -> str:
    """Names of functions in a file's added lines, distinct, in order of line and pattern."""
    names = ", ".join(f"regexp_extract_all(c.content, {quote(java(p))}, 1)" for p in fixed.FUNCTION_PATTERNS)
    return f"array_distinct(flatten(transform(added, c -> flatten(array({names})))))"


def code_snippets() -> str:
    """The first runs of added lines, each at most five lines long.

    A context or deleted line ends a run; a hunk boundary does not.
    """
    marked = "transform(h.changes, c -> if(c.type = 'addition', concat('+', c.content, '\\n'), '\\n'))"
    text = f"array_join(flatten(transform(hunks, h -> {marked})), '')"
    run = quote(rf"(?md)(?:^\+[^\n]*\n){{1,{fixed.SNIPPET_LINES}}}")
    plain = f"regexp_replace(r, {quote(r'(?md)^\+|\n\z')}, '')"
    return f"transform(slice(regexp_extract_all({text}, {run}, 0), 1, {fixed.SNIPPETS_PER_FILE}), r -> {plain})"


def test_context() -> dict[str, str]:
    """What a test prompt says about a file, null for files not worth one."""

    def if_testable(value: str) -> str:
        return f"if(is_testable, {value}, null)"

    return {
        "is_testable": paths.is_testable(),
        "test_language": if_testable(paths.suggestion_language()),
        "functions": if_testable(function_names()),
        "snippets": if_testable(code_snippets()),
    }


def test_contexts(files: DataFrame) -> DataFrame:
    """Testable files with ``test_language, functions, snippets``; nothing of the text is kept."""
    columns = [f"{expression} AS {name}" for name, expression in test_context().items()]
    return files.selectExpr(*FILE_KEY, "path", "language", "additions", "deletions", *columns).where("is_testable")


def test_files(testable: DataFrame, max_files: int = 5, order: str = "churn") -> DataFrame:
    """The files to suggest tests for, ranked; zero means five.

    ``order="churn"`` takes the most changed files, ``"input"`` the first ones.
    """
    if order not in ("churn", "input"):
        raise ValueError("order is churn or input")
    by = CHURN_ORDER if order == "churn" else ["file_idx"]
    return first_n(testable, max_files or 5, ["change_id"], by, rank="file_rank")


def test_prompts(chosen: DataFrame) -> DataFrame:
    """``change_id, kind, file_idx, prompt`` for the chosen files.

    Patterns of tests that are already there come in an array column
    ``existing_patterns``, if the files have one.
    """
    values = {
        "file": "path",
        "language": "test_language",
        "functions": r"array_join(functions, '\n- ')",
        "codeSnippets": r"array_join(snippets, '\n\n')",
    }
    if "existing_patterns" in chosen.columns:
        values["existingTestPatterns"] = r"array_join(existing_patterns, '\n- ')"
    return chosen.selectExpr("change_id", "'tests' AS kind", "file_idx", f"{fill(fixed.TEST_PROMPT, values)} AS prompt")
