"""Facts per file and summaries per change set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import fixed, paths
from changelens.functions.regex import SPACE_CHARS
from changelens.functions.rows import each, first_n
from changelens.functions.sql import quote
from changelens.functions.text import trim
from changelens.operators import scan
from changelens.operators.parse import FILE_KEY
from changelens.operators.scan import file_findings, severity_count
from changelens.params import ScanOptions
from changelens.sources.tables import cut, lookup


def with_metadata(files: DataFrame) -> DataFrame:
    """Adds ``extension, language, is_critical, is_test, is_config`` of the path."""
    new = {
        "extension": paths.extension(),
        "language": paths.language(),
        "is_critical": paths.is_critical(),
        "is_test": paths.is_test(),
        "is_config": paths.is_config(),
    }
    kept = [c for c in files.columns if c not in new]
    return files.selectExpr(*kept, *[f"{expression} AS {name}" for name, expression in new.items()])


def file_complexity() -> str:
    """Hunks, size and the indentation of added lines, each capped; 30 at most."""
    spaces = quote(SPACE_CHARS)
    indent = f"char_length(c.content) - char_length(ltrim({spaces}, c.content))"
    indented = f"filter(added, c -> contains({spaces}, left(c.content, 1)))"
    start = "least(10D, cast(n_hunks as double)) + least(10D, (additions + deletions) / 50D)"
    return f"least(30D, aggregate({indented}, {start}, (acc, c) -> acc + least(5D, ({indent}) / 4D)))"


def file_facts(
    files: DataFrame, options: ScanOptions = ScanOptions(), more: dict[str, str] | None = None
) -> DataFrame:
    """One thin row per file with all a change set's analysis needs.

    Parsing, path rules, complexity and the secret scan are one row-local pass;
    everything after it works on these rows and never on the text again.
    ``more`` adds named expressions over the file rows.
    """
    base = "base_branch" if "base_branch" in files.columns else "cast(null as string) AS base_branch"
    return files.selectExpr(
        *FILE_KEY, "path", "old_path", "status", "language", "binary", "additions", "deletions", "n_hunks", base,
        f"{paths.is_critical()} AS is_critical",
        f"{paths.is_test()} AS is_test",
        f"{paths.is_config()} AS is_config",
        f"{file_complexity()} AS complexity",
        f"{file_findings(options)} AS findings",
        *[f"{expression} AS {name}" for name, expression in (more or {}).items()],
    )


_MODIFIED = "status NOT IN ('added', 'deleted', 'renamed')"


def profile(facts: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per change set: totals, counts by status and flag, complexity,
    findings by severity, and where each critical category is first seen.

    Aggregated by hash with map-side partials; no lists are collected.  With a
    limit on findings only the first ones of a change set are counted.
    """
    counts = {
        "n_added": "status = 'added'",
        "n_modified": _MODIFIED,
        "n_deleted": "status = 'deleted'",
        "n_renamed": "status = 'renamed'",
        "n_critical_files": "is_critical",
        "n_test_files": "is_test",
        "n_config_files": "is_config",
        "n_modified_docs": f"{_MODIFIED} AND {paths.is_doc()}",
        "n_complex": f"complexity >= {fixed.COMPLEXITY_THRESHOLDS['high']}",
    }
    columns = {
        "total_files": ("sum", "1L"),
        "total_additions": ("sum", "additions"),
        "total_deletions": ("sum", "deletions"),
        **{name: ("sum", f"if({condition}, 1L, 0L)") for name, condition in counts.items()},
        # Complexities are whole hundredths; integers make the sum independent of its order.
        "total_complexity": ("sum", "cast(round(complexity * 100) as bigint)"),
        "max_complexity": ("max", "complexity"),
        **{f"n_{s.lower()}": ("sum", severity_count(s, options)) for s in fixed.SEVERITY_PRIORITY},
        "n_findings": ("sum", "coalesce(size(findings), 0)"),
        **{
            f"first_{c}": ("min", f"if(is_critical AND {paths.in_category(c)}, file_idx, null)")
            for c in fixed.CRITICAL_CATEGORIES
        },
    }
    # A text cannot be aggregated by hash, but it can be a key: the branch is one
    # per change set, so the second aggregation only sees a row or so for each.
    by_branch = facts.groupBy("change_id", "base_branch").agg(
        *[F.expr(f"{how}({value}) AS {name}") for name, (how, value) in columns.items()]
    )
    whole = by_branch.groupBy("change_id").agg(
        F.expr("max(base_branch) AS base_branch"),
        *[F.expr(f"{how}({name}) AS {name}") for name, (how, _) in columns.items()],
    )
    whole = whole.withColumn("total_complexity", F.col("total_complexity") / 100)
    if options.max_findings <= 0:
        return whole
    kept = scan.explode_findings(facts, FILE_KEY, options, ["change_id"])
    names = ["n_findings", *[f"n_{s.lower()}" for s in fixed.SEVERITY_PRIORITY]]
    counts = scan.severity_counts(kept, ["change_id"])
    limited = whole.drop(*names).join(counts, "change_id", "left")
    return limited.selectExpr(*[f"coalesce({c}, 0L) AS {c}" if c in names else c for c in limited.columns])


def change_totals(files: DataFrame) -> DataFrame:
    """Files, additions and deletions per change set."""
    return files.groupBy("change_id").agg(
        F.expr("count(*) AS total_files"),
        F.expr("sum(additions) AS total_additions"),
        F.expr("sum(deletions) AS total_deletions"),
    )


def diff_stat(files: DataFrame) -> DataFrame:
    """Counts per change set and path, with a total row (null path) each."""
    return files.groupingSets([["change_id", "path"], ["change_id"]], "change_id", "path").agg(
        F.expr("sum(additions) AS additions"), F.expr("sum(deletions) AS deletions"), F.expr("count(*) AS n_files")
    )


def changed_files(files: DataFrame) -> DataFrame:
    """Distinct paths per change set, without white space around them."""
    return files.selectExpr("change_id", f"{trim('path')} AS path").where("path <> ''").distinct()


# The lists of a change summary, by name.
LISTS = ["added", "modified", "deleted", "renamed", "critical", "test", "config"]


def path_lists(facts: DataFrame) -> DataFrame:
    """The change summary's lists as rows: ``change_id, list, file_idx, path, old_path``.

    A file stands in one list by status and in any number by kind; ``file_idx``
    orders a list.
    """
    lists = (
        f"array_compact(array(if({_MODIFIED}, 'modified', status), if(is_critical, 'critical', null),"
        " if(is_test, 'test', null), if(is_config, 'config', null)))"
    )
    rows = each(facts, [*FILE_KEY, "path", "old_path"], lists, "list")
    return rows.select("change_id", "list", "file_idx", "path", "old_path")


def list_heads(facts: DataFrame, n: int = 3) -> DataFrame:
    """Size and first ``n`` paths of every list: ``change_id, list, size, head``."""
    rows = path_lists(facts)
    sizes = rows.groupBy("change_id", "list").agg(F.expr("count(*) AS size"))
    # At most n entries per group are collected.
    heads = (
        first_n(rows, n, ["change_id", "list"], ["file_idx"])
        .groupBy("change_id", "list")
        .agg(F.expr("array_sort(collect_list(struct(rank, path))).path AS head"))
    )
    return sizes.join(heads, ["change_id", "list"])


def path_list_texts(facts: DataFrame) -> DataFrame:
    """Every list as the entries of a text: ``change_id, list, file_idx, text``.

    The text of a list are its entries in the order of ``file_idx``, put together;
    each but the first brings its separator.
    """
    rows = path_lists(facts)
    first = rows.groupBy("change_id", "list").agg(F.min("file_idx").alias("_first"))
    return lookup(rows, first, ["change_id", "list"], spread="file_idx").selectExpr(
        "change_id", "list", "file_idx", "if(file_idx = _first, path, concat(', ', path)) AS text"
    )


def languages(files: DataFrame) -> DataFrame:
    """Languages of a change set in first-seen order: ``change_id, languages``."""
    seen = (
        files.where("language IS NOT NULL")
        .groupBy("change_id", "language")
        .agg(F.expr("min(file_idx) AS first"))
    )
    # At most one entry per known language is collected.
    return seen.groupBy("change_id").agg(
        F.expr("array_sort(collect_list(struct(first, language))).language AS languages")
    )


def group_counts(files: DataFrame, by: str) -> DataFrame:
    """Files per ``directory`` or ``extension``: ``change_id, name, n_files, first``."""
    name = paths.directory() if by == "directory" else paths.extension()
    return (
        files.selectExpr("change_id", "file_idx", f"{name} AS name")
        .groupBy("change_id", "name")
        .agg(F.expr("count(*) AS n_files"), F.expr("min(file_idx) AS first"))
    )


def name_counts(files: DataFrame) -> DataFrame:
    """Files per directory and per extension: ``change_id, by, name, n_files, first``."""
    names = (
        f"array(named_struct('by', 'directory', 'name', {paths.directory()}),"
        f" named_struct('by', 'extension', 'name', {paths.extension()}))"
    )
    return (
        each(files, ["change_id", "file_idx"], names, "_n")
        .groupBy("change_id", F.expr("_n.by AS by"), F.expr("_n.name AS name"))
        .agg(F.expr("count(*) AS n_files"), F.expr("min(file_idx) AS first"))
    )


_LABEL = "concat(name, ' (', n_files, ' files)')"


def directory_split(counts: DataFrame) -> DataFrame:
    """The split by the three largest directories, for change sets with several:
    ``change_id, split_directory``.  ``counts`` are those of ``name_counts``."""
    labels = f"array_sort(collect_list(struct(rank, {_LABEL} AS label))).label"
    # At most three entries per group are collected; two or more mean several directories.
    return (
        first_n(counts.where("by = 'directory'"), 3, ["change_id"], ["n_files DESC", "first"])
        .groupBy("change_id")
        .agg(F.expr("count(*) AS _n"), F.expr(f"concat('Split by directory: ', array_join({labels}, ', ')) AS split_directory"))
        .where("_n > 1")
        .drop("_n")
    )


def type_split_marks(counts: DataFrame) -> DataFrame:
    """Change sets that can be split by type: ``change_id, split_type_fix`` (does
    the text name a quick fix)."""
    return (
        counts.where("by = 'extension'")
        .groupBy("change_id")
        .agg(F.expr("count(*) AS _n"), F.expr("max(name rlike 'Fix|Remove|Add') AS split_type_fix"))
        .where("_n > 1")
        .drop("_n")
    )


TYPE_SPLIT = "Split by type: "


def type_split(counts: DataFrame) -> DataFrame:
    """The split by file type: ``change_id, entry_no, text``.

    Entry 0 is the heading; the types follow in first-seen order, a row each,
    numbered by their first file.
    """
    types = counts.where("by = 'extension'")
    several = types.groupBy("change_id").agg(F.expr("count(*) AS _n")).where("_n > 1").select("change_id")
    entries = lookup(types, several, ["change_id"], "left_semi", spread="name").selectExpr(
        "change_id", "first + 1 AS entry_no", f"{_LABEL} AS text"
    )
    return several.selectExpr("change_id", "0L AS entry_no", f"{quote(TYPE_SPLIT)} AS text").unionByName(entries)


def split_suggestions(files: DataFrame) -> DataFrame:
    """Ways to split each change set: ``change_id, kind, entry_no, suggestion``.

    The text is read once: its counts go to a table of the shared folder.
    """
    counts = cut(name_counts(files), "name-counts")
    by_directory = directory_split(counts).selectExpr(
        "change_id", "'directory' AS kind", "0L AS entry_no", "split_directory AS suggestion"
    )
    by_type = type_split(counts).selectExpr("change_id", "'type' AS kind", "entry_no", "text AS suggestion")
    return by_directory.unionByName(by_type)
