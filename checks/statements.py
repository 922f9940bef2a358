"""One statement per catalogue query."""

from __future__ import annotations

from changelens.functions import fixed
from changelens.functions.regex import RE2_SPACE, re2
from changelens.functions.template import _PART, around
from changelens.operators.prompts import LAST_PIECE
from changelens.operators.report import _NEXT_STEPS
from checks.oracle import (
    PATTERNS,
    TABLES,
    extension,
    findings,
    half_up,
    hits,
    language_case,
    lit,
    matches,
    statement,
    tenths,
    trimmed,
)

STATEMENTS: dict[str, str] = {}
JOIN = "' | '"


def add(name: str, select: str, *tables: str) -> None:
    STATEMENTS[name] = statement(select, *tables)


_FINDING = (
    'file, line, "column", type, severity, content, pattern, description, recommendation, confidence, line_ord,'
    " pattern_idx, match_idx"
)
_SEVERITY_COUNTS = ", ".join(
    f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in fixed.SEVERITY_PRIORITY
) + ", count(*) AS n_findings"


def template(text: str, values: dict[str, str]) -> str:
    """A filled template as a SQL expression."""
    out, at = [], 0
    for m in _PART.finditer(text):
        out.append(lit(text[at : m.start()]))
        condition, block, name = m.groups()
        if condition:
            v = values.get(condition, "''")
            out.append(f"CASE WHEN coalesce({v}, '') <> '' THEN {template(block, values)} ELSE '' END")
        else:
            out.append(f"coalesce({values.get(name, 'NULL')}, '')")
        at = m.end()
    out.append(lit(text[at:]))
    return "(" + " || ".join(out) + ")"


# --- content scan -------------------------------------------------------------------------

add("scan_documents_findings", f"SELECT doc_id, {_FINDING} FROM doc_findings", "doc_findings")
add("scan_severity_by_source", f"SELECT source, {_SEVERITY_COUNTS} FROM doc_findings GROUP BY source", "doc_findings")
add("scan_types_by_source", "SELECT source, type, count(*) AS n FROM doc_findings GROUP BY ALL", "doc_findings")

TABLES["custom_hits"] = (
    ("doc_lines",),
    hits("doc_lines", "doc_id, source", [(len(fixed.SECRET_PATTERNS), r"(?:corp|db)\.(?:io|internal)\b")]),
)
add(
    "scan_custom_pattern",
    'SELECT doc_id, cast(line AS bigint) AS line, cast(col AS bigint) AS "column",'
    " coalesce(type, 'INTERNAL_HOST') AS type, coalesce(severity, 'MEDIUM') AS severity, m AS content"
    f" FROM custom_hits LEFT JOIN {PATTERNS} USING (pattern_idx)"
    " WHERE coalesce(type, '') <> 'DATABASE_URL' AND coalesce(priority, 2) >= 2",
    "custom_hits",
)
add(
    "scan_high_confidence",
    'SELECT doc_id, line, "column", type, confidence FROM doc_findings WHERE confidence >= 0.8',
    "doc_findings",
)
add(
    "scan_min_severity",
    'SELECT doc_id, line, "column", type, severity FROM doc_findings WHERE priority >= 3',
    "doc_findings",
)
add(
    "scan_max_findings",
    'SELECT doc_id, line, "column", type FROM doc_findings QUALIFY row_number() OVER'
    " (PARTITION BY doc_id ORDER BY line_ord, pattern_idx, match_idx) <= 2",
    "doc_findings",
)
add(
    "scan_result_filters",
    'SELECT doc_id, line, "column", type, severity FROM (SELECT * FROM doc_findings WHERE priority >= 3)'
    " QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_ord, pattern_idx, match_idx) <= 1",
    "doc_findings",
)


def context(lines: str, keys: str, offset: str) -> tuple[str, str]:
    def near(condition: str) -> str:
        return (
            f"(SELECT coalesce(string_agg(l.txt, {JOIN} ORDER BY l.line_ord), '') FROM {lines} l WHERE "
            + " AND ".join(f"l.{k} = f.{k}" for k in keys.split(", "))
            + f" AND {condition})"
        )

    return (
        near("l.line_ord BETWEEN f.line_ord - 2 AND f.line_ord - 1"),
        near("l.line_ord BETWEEN f.line_ord + 1 AND f.line_ord + 2"),
    )


_before, _after = context("doc_lines", "doc_id", "")
add(
    "scan_context",
    f"SELECT doc_id, line, pattern_idx, match_idx, {_before} AS context_before, {_after} AS context_after"
    " FROM doc_findings f",
    "doc_findings",
    "doc_lines",
)
add(
    "scan_pattern_sets",
    'SELECT doc_id, line, "column", type, severity, content FROM doc_findings WHERE doc_id % 2 = 0 UNION ALL'
    ' SELECT doc_id, cast(line AS bigint), cast(col AS bigint), coalesce(type, \'INTERNAL_HOST\'),'
    f" coalesce(severity, 'MEDIUM'), m FROM custom_hits LEFT JOIN {PATTERNS} USING (pattern_idx)"
    " WHERE coalesce(type, '') <> 'DATABASE_URL' AND coalesce(priority, 2) >= 2 AND doc_id % 2 = 1",
    "doc_findings",
    "custom_hits",
)
add("scan_findings_written", 'SELECT doc_id, line, "column", type, severity FROM doc_findings', "doc_findings")
STATEMENTS["scan_context_in_blocks"] = STATEMENTS["scan_context"]
add(
    "scan_finding_text",
    "SELECT doc_id, line, pattern_idx, match_idx, severity || ' - ' || type || chr(10) || '   File: ' || file || ':'"
    " || line || chr(10) || '   Issue: ' || description || chr(10) || '   Fix: ' || recommendation || chr(10) ||"
    f" '   Confidence: ' || {half_up('confidence * 100')} || '%' AS finding_text FROM doc_findings",
    "doc_findings",
)
TABLES["chat_lines"] = (
    (),
    "SELECT conv_id, turn, 'chat/' || conv_id || '.txt' AS path, unnest(a) AS txt, unnest(range(1, len(a) + 1)) AS line,"
    " unnest(range(len(a))) AS line_ord FROM (SELECT *, string_split(text, chr(10)) AS a FROM conversations)",
)
TABLES["chat_hits"] = (
    ("chat_lines",),
    hits("chat_lines", "conv_id, turn", [(len(fixed.SECRET_PATTERNS), r"\bque\b")]),
)
add(
    "scan_conversations",
    'SELECT conv_id, turn, cast(line AS bigint) AS line, cast(col AS bigint) AS "column",'
    " cast(match_idx AS bigint) AS match_idx, coalesce(type, 'TERM') AS type, m AS content"
    f" FROM chat_hits LEFT JOIN {PATTERNS} USING (pattern_idx)",
    "chat_hits",
)
TABLES["page_lines"] = (
    (),
    "SELECT page_id, url AS path, unnest(a) AS txt, unnest(range(1, len(a) + 1)) AS line,"
    " unnest(range(len(a))) AS line_ord FROM (SELECT *, string_split(html, chr(10)) AS a FROM pages)",
)
TABLES["page_hits"] = (("page_lines",), hits("page_lines", "page_id"))
add(
    "scan_pages",
    f'SELECT page_id, line, "column", type, content FROM ({findings("page_hits", "page_id")})',
    "page_hits",
)
add(
    "active_patterns",
    "SELECT doc_id, path, cast(pattern_idx AS bigint) AS pattern_idx, type FROM scan_files, "
    + PATTERNS
    + f" WHERE NOT {matches('path', fixed.EXCLUDED_PATHS)}"
    + "".join(
        f" AND NOT (pattern_idx = {n} AND {matches('path', exclude)})"
        for n, (_, _, _, _, exclude) in enumerate(fixed.SECRET_PATTERNS)
        if exclude
    ),
    "scan_files",
)
for _name, _where in {
    "pattern_hits_by_severity": "p.severity = 'HIGH'",
    "pattern_hits_by_type": "p.type = 'API_KEY'",
    "pattern_hits_high_confidence": "p.confidence >= 0.8",
    "pattern_hits_critical": "p.severity IN ('CRITICAL', 'HIGH')",
}.items():
    add(
        _name,
        "SELECT cast(p.pattern_idx AS bigint) AS pattern_idx, p.type, p.severity, p.confidence, coalesce(n, 0) AS n"
        f" FROM {PATTERNS} LEFT JOIN (SELECT pattern_idx, count(*) AS n FROM doc_findings GROUP BY ALL) c"
        f" USING (pattern_idx) WHERE {_where}",
        "doc_findings",
    )

# --- diffs ---------------------------------------------------------------------------------

add(
    "diff_source_choice",
    "SELECT change_id, part_idx, source_kind, 'main' AS base_branch, md5(diff_text) AS digest FROM chosen_sources",
    "chosen_sources",
)
add(
    "diff_source_staged_only",
    "SELECT change_id, part_idx, source_kind, md5(diff_text) AS digest FROM sources"
    f" WHERE source_kind = 'staged' AND {trimmed('diff_text')} <> ''",
    "sources",
)
# file numbers without a gap
_DENSE = (
    " JOIN (SELECT change_id, file_idx, row_number() OVER (PARTITION BY change_id ORDER BY file_idx) - 1 AS dense FROM files)"
    " USING (change_id, file_idx)"
)
_FILE_ROWS = (
    'SELECT change_id, dense AS file_idx, path, old_path, status, language, "binary", additions, deletions, n_hunks,'
    f" parse_warning FROM files{_DENSE}"
)
_CHANGE_ROWS = f"SELECT * EXCLUDE (dense) REPLACE (dense AS file_idx) FROM changes{_DENSE}"
add("diff_files", _FILE_ROWS, "files")
add(
    "diff_hunks",
    "SELECT change_id, dense AS file_idx, path, hunk_idx, old_start, old_lines, new_start, new_lines, header"
    f" FROM hunks{_DENSE}",
    "hunks",
    "files",
)
add("diff_changes", _CHANGE_ROWS, "changes", "files")
TABLES["hunk_texts"] = (
    ("hunks", "changes"),
    "SELECT h.change_id, h.file_idx, h.hunk_idx, count(c.type) AS n_changes, any_value(h.hunk_idx || ',' || old_start || ','"
    " || old_lines || ',' || new_start || ',' || new_lines) || chr(10) || coalesce(string_agg(change_idx || ':' ||"
    " line_number || ':' || coalesce(cast(old_line_number AS varchar), '') || ':' || c.type || ':' || content,"
    " chr(10) ORDER BY change_idx), '') AS told FROM hunks h LEFT JOIN changes c ON h.change_id = c.change_id"
    " AND h.file_idx = c.file_idx AND h.hunk_idx = c.hunk_idx GROUP BY h.change_id, h.file_idx, h.hunk_idx",
)
add(
    "diff_nested",
    "SELECT change_id, file_idx, count(*) AS n_hunks, cast(sum(n_changes) AS bigint) AS n_changes,"
    " coalesce(any_value(n), 0) AS n_added, md5(string_agg(told, chr(10) ORDER BY hunk_idx)) AS hunks_md5,"
    " md5(coalesce(any_value(said), '')) AS added_md5 FROM hunk_texts LEFT JOIN (SELECT change_id, file_idx, count(*) AS n,"
    " string_agg(line || ':' || txt, chr(10) ORDER BY line_ord) AS said FROM added GROUP BY change_id, file_idx)"
    " USING (change_id, file_idx) GROUP BY change_id, file_idx",
    "hunk_texts",
    "added",
)
add("diff_part_files", _FILE_ROWS, "files")
add("diff_part_changes", _CHANGE_ROWS, "changes", "files")
add(
    "diff_stat",
    "SELECT change_id, path, sum(additions) AS additions, sum(deletions) AS deletions, count(*) AS n_files"
    " FROM files GROUP BY GROUPING SETS ((change_id, path), (change_id))",
    "files",
)
add("changed_files", "SELECT DISTINCT change_id, path FROM files WHERE trim(path) <> ''", "files")


def glob(pattern: str) -> str:
    """LIKE with a literal underscore."""
    like = pattern.replace("_", "\\_").replace("*", "%").replace("?", "_")
    return f"path LIKE {lit(like)} ESCAPE '\\'"


_INCLUDE, _EXCLUDE = ("src/*", "*.md", "*_1?.js", "app/*"), ("*handler*", "docs/*5.md")
_IN = "(" + " OR ".join(map(glob, _INCLUDE)) + ")"
_OUT = "(" + " OR ".join(map(glob, _EXCLUDE)) + ")"
add("glob_include", f"SELECT change_id, file_idx, path FROM files WHERE {_IN}", "files")
add("glob_exclude", f"SELECT change_id, file_idx, path FROM files WHERE NOT {_OUT}", "files")
TABLES["capped"] = (
    ("changes", "files"),
    "SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY change_id, file_idx ORDER BY hunk_idx, change_idx)"
    " AS rn FROM changes) c JOIN files f USING (change_id, file_idx) WHERE f.additions + f.deletions <= 6 OR rn <= 6",
)
add(
    "line_cap",
    "SELECT change_id, file_idx, path, hunk_idx, change_idx, line_number, old_line_number, type, content FROM capped",
    "capped",
)
add(
    "file_filters",
    "SELECT f.change_id, f.file_idx, f.path, any_value(f.additions) AS additions, any_value(f.deletions) AS deletions,"
    " count(DISTINCT c.hunk_idx) AS n_hunks, round(least(30.0, least(10.0, count(DISTINCT c.hunk_idx))"
    " + least(10.0, any_value(f.additions + f.deletions) / 50.0)"
    f" + coalesce(sum(least(5.0, len(regexp_extract(c.content, {lit(f'^[{RE2_SPACE}]+')})) / 4.0))"
    " FILTER (type = 'addition'), 0)), 10) AS complexity FROM files f JOIN capped c USING (change_id, file_idx)"
    f" WHERE {_IN.replace('path', 'f.path')} AND NOT {_OUT.replace('path', 'f.path')} GROUP BY ALL",
    "files",
    "capped",
)
for _name, _kind in {"added_lines": "addition", "deleted_lines": "deletion"}.items():
    add(
        _name,
        f"SELECT change_id, file_idx, path, hunk_idx, change_idx, content FROM changes WHERE type = '{_kind}'",
        "changes",
    )
TABLES["wanted"] = (
    ("scan_files",),
    "SELECT change_id, path FROM scan_files SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)",
)
add(
    "wanted_files",
    "SELECT change_id, file_idx, path, status FROM files SEMI JOIN wanted USING (change_id, path)",
    "files",
    "wanted",
)
add(
    "contains_file",
    "SELECT change_id, path, EXISTS (SELECT 1 FROM files f WHERE f.change_id = w.change_id AND f.path = w.path)"
    " AS contained FROM (SELECT * FROM wanted UNION ALL SELECT change_id, path || '.bak' FROM wanted) w",
    "files",
    "wanted",
)
add(
    "file_by_path",
    "SELECT change_id, file_idx, path, status FROM files WHERE path = 'docs/doc_9.md'"
    " QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY file_idx) = 1",
    "files",
)
add(
    "path_metadata",
    f"SELECT change_id, file_idx, path, {extension('path')} AS extension,"
    f" {language_case(extension('path'))} AS language, is_critical, is_test, is_config FROM facts",
    "facts",
)
add(
    "path_categories",
    "SELECT change_id, file_idx, path, category FROM ("
    + " UNION ALL ".join(
        f"SELECT change_id, file_idx, path, '{name}' AS category FROM facts WHERE is_critical AND ("
        + " OR ".join(f"regexp_matches(path, {lit(w)})" for w in words) + ")"
        for name, words in fixed.CRITICAL_CATEGORIES.items()
    )
    + ")",
    "facts",
)

# --- change sets ----------------------------------------------------------------------------

add(
    "change_totals",
    "SELECT change_id, total_files, total_additions, total_deletions FROM profile",
    "profile",
)
add(
    "change_summary",
    "SELECT change_id, 'main' AS base_branch, total_files, cast(n_added AS bigint) AS n_added,"
    " cast(n_modified AS bigint) AS n_modified, cast(n_deleted AS bigint) AS n_deleted, cast(0 AS bigint) AS n_renamed,"
    " cast(n_critical_files AS bigint) AS n_critical_files, cast(n_test_files AS bigint) AS n_test_files,"
    " cast(n_config_files AS bigint) AS n_config_files FROM profile",
    "profile",
)
add("change_path_lists", "SELECT * FROM heads", "heads")
add(
    "change_path_texts",
    "SELECT change_id, list, file_idx, CASE WHEN row_number() OVER (PARTITION BY change_id, list ORDER BY file_idx) = 1"
    " THEN '' ELSE ', ' END || path AS text FROM heads",
    "heads",
)
add(
    "change_list_heads",
    f"SELECT change_id, list, any_value(n) AS size, string_agg(path, {JOIN} ORDER BY file_idx) FILTER (rn <= 3) AS head"
    " FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY change_id, list) AS n FROM heads"
    " WINDOW w AS (PARTITION BY change_id, list ORDER BY file_idx)) GROUP BY change_id, list",
    "heads",
)
add("languages", f"SELECT change_id, replace(languages, ', ', {JOIN}) AS languages FROM langs", "langs")
add("files_per_directory", "SELECT * FROM directories", "directories")
add("files_per_extension", "SELECT * FROM extensions", "extensions")
add(
    "split_suggestions",
    "SELECT change_id, kind, cast(0 AS bigint) AS entry_no, suggestion FROM splits WHERE kind = 'directory'"
    " UNION ALL SELECT change_id, 'type', entry_no, text FROM types",
    "splits",
    "types",
)
add("diff_findings", f"SELECT change_id, file_idx, {_FINDING} FROM diff_findings", "diff_findings")
_before, _after = context("added", "change_id, file_idx", "")
add(
    "diff_context",
    "SELECT change_id, file_idx, line, pattern_idx, match_idx,"
    f" {_before} AS context_before, {_after} AS context_after FROM diff_findings f",
    "diff_findings",
    "added",
)
_DISCOVERY = "file_idx, line_ord, pattern_idx, match_idx"
add(
    "diff_max_findings",
    'SELECT change_id, file_idx, line, "column", type, severity FROM diff_findings'
    f" QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY {_DISCOVERY}) <= 10",
    "diff_findings",
)
add(
    "diff_scan_summary",
    "SELECT change_id, total_files AS files_scanned, cast(n_critical AS bigint) AS n_critical,"
    " cast(n_high AS bigint) AS n_high, cast(n_medium AS bigint) AS n_medium, cast(n_low AS bigint) AS n_low,"
    " n_findings, n_critical > 0 AS has_critical_issues, coalesce(kinds, '') AS by_type FROM profile LEFT JOIN"
    f" (SELECT change_id, string_agg(type || '=' || n, {JOIN} ORDER BY type) AS kinds FROM type_totals"
    " GROUP BY change_id) USING (change_id)",
    "profile",
    "type_totals",
)
add(
    "diff_top_findings",
    f"SELECT change_id, row_number() OVER w AS rank, file, line, \"column\", type, severity FROM diff_findings"
    f" WINDOW w AS (PARTITION BY change_id ORDER BY priority DESC, {_DISCOVERY}) QUALIFY rank <= 5",
    "diff_findings",
)
add(
    "diff_type_order",
    "SELECT change_id, type, count(*) AS n, cast(-max(priority) AS bigint) AS seen_priority,"
    f" first(file_idx ORDER BY {_DISCOVERY}) AS seen_file, first(line_ord ORDER BY {_DISCOVERY}) AS seen_line"
    " FROM (SELECT *, max(priority) OVER (PARTITION BY change_id, type) AS top FROM diff_findings)"
    " GROUP BY change_id, type",
    "diff_findings",
)

# --- risk --------------------------------------------------------------------------------------


def rounded(name: str) -> str:
    return f"round(cast({name} AS double), 10) AS {name}"


add("file_complexity", f"SELECT change_id, file_idx, {rounded('complexity')} FROM complexities", "complexities")
add(
    "risk_security",
    "SELECT change_id, cast(n_critical AS bigint) AS n_critical, cast(n_high AS bigint) AS n_high,"
    " cast(n_medium AS bigint) AS n_medium, cast(n_low AS bigint) AS n_low, n_findings,"
    f" {rounded('security_score')}, blocking AS has_blocking_issues FROM scores",
    "scores",
)
add(
    "risk_complexity",
    f"SELECT change_id, {rounded('avg_complexity')}, {rounded('max_complexity')}, cast(n_complex AS bigint) AS n_complex,"
    f" {rounded('complexity_score')} FROM scores",
    "scores",
)
add(
    "risk_size",
    "SELECT change_id, total_files, total_additions, total_deletions, abs(total_additions - total_deletions)"
    f" AS net_lines, {rounded('size_score')}, too_large AS is_too_large FROM scores",
    "scores",
)
add(
    "risk_critical",
    "SELECT change_id, cast(n_critical_files AS bigint) AS n_critical_files, coalesce(categories, '') AS categories,"
    f" {rounded('critical_score')}, core AS affects_core FROM scores",
    "scores",
)
_TIME_LONG = (
    "CASE WHEN overall_score >= 75 THEN '2-4 hours (thorough review required)' WHEN overall_score >= 40"
    " THEN '1-2 hours (careful review recommended)' ELSE '30-60 minutes (standard review)' END"
)
add(
    "risk_overall",
    f"SELECT change_id, {rounded('overall_score')}, overall_risk, round(security_score * 0.4e0 + complexity_score * 0.3e0"
    " + size_score * 0.15e0 + critical_score * 0.15e0, 10) AS weighted_score,"
    f" {half_up('overall_score')} || '%' AS percent, {_TIME_LONG} AS review_time FROM scores",
    "scores",
)
add(
    "risk_custom_weights",
    "SELECT change_id, round(s, 10) AS overall_score, CASE WHEN s >= 60 THEN 'HIGH' WHEN s >= 30 THEN 'MEDIUM'"
    " ELSE 'LOW' END AS overall_risk FROM (SELECT change_id, security_score * 0.5e0 + complexity_score * 0.2e0"
    " + size_score * 0.2e0 + critical_score * 0.1e0 AS s FROM scores)",
    "scores",
)
add(
    "risk_factors",
    f"SELECT change_id, factor_idx, category, {rounded('score')}, weight, {rounded('weighted_score')}, explanation FROM factors",
    "factors",
)
_HEAD = (
    "'### ' || category || ' (Weight: ' || cast(round(weight * 100) AS bigint) || '%)'"
    f" || chr(10) || '- Score: ' || {tenths('cast(score AS double)')} || '/100' || chr(10) || '- Weighted: ' ||"
    f" {tenths('cast(weighted_score AS double)')} || chr(10) || '- ' || explanation"
)
add(
    "risk_breakdown",
    "SELECT change_id, cast(factor_idx AS bigint) AS factor_idx, cast(line_no AS bigint) AS line_no, entry_no, line FROM ("
    f"SELECT change_id, factor_idx, 0 AS line_no, cast(0 AS bigint) AS entry_no, {_HEAD} AS line FROM factors"
    " UNION ALL SELECT change_id, factor_idx, 1, 0, 'Details:' FROM factors"
    " UNION ALL SELECT change_id, factor_idx, detail_idx + 2, entry_no,"
    " CASE WHEN entry_no = 0 THEN '  - ' ELSE '' END || detail FROM detail_entries)",
    "factors",
    "detail_entries",
)
add("risk_details", "SELECT change_id, factor_idx, detail_idx, entry_no, detail FROM detail_entries", "detail_entries")
add(
    "risk_recommendations",
    "SELECT change_id, rec_idx, entry_no, rec AS recommendation FROM rec_entries",
    "rec_entries",
)
add(
    "risk_quick_fixes",
    "SELECT change_id, fix_idx, entry_no, e.rec AS quick_fix FROM (SELECT change_id, rec_idx,"
    " row_number() OVER (PARTITION BY change_id ORDER BY rec_idx) - 1 AS fix_idx FROM rec_rows WHERE contains(rec, 'Fix')"
    " OR contains(rec, 'Remove') OR contains(rec, 'Add') QUALIFY fix_idx < 3)"
    " JOIN rec_entries e USING (change_id, rec_idx)",
    "rec_rows",
    "rec_entries",
)
add("risk_issues", "SELECT change_id, issue_idx, issue FROM issue_rows", "issue_rows")
add(
    "risk_summary",
    f"SELECT s.change_id, overall_risk AS level, {half_up('overall_score')} AS score,"
    " coalesce(concerns, '') AS concerns, CASE WHEN overall_score >= 75 THEN '2-4 hours' WHEN overall_score >= 40"
    " THEN '1-2 hours' ELSE '30-60 minutes' END AS estimated_review_time FROM scores s LEFT JOIN"
    f" (SELECT change_id, string_agg(category || ': ' || explanation, {JOIN} ORDER BY factor_idx) AS concerns FROM"
    " (SELECT * FROM factors WHERE score > 50 QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY factor_idx)"
    " <= 3) GROUP BY change_id) USING (change_id)",
    "scores",
    "factors",
)
add(
    "merge_gate",
    "SELECT change_id, reason IS NULL AS safe, reason FROM (SELECT s.change_id, CASE WHEN issue IS NOT NULL THEN"
    " 'Critical issues must be resolved: ' || issue WHEN overall_score >= 90 THEN"
    " 'Risk score too high - requires significant changes' WHEN overall_risk = 'HIGH' THEN"
    " 'High risk - thorough review and testing required before merge' END AS reason FROM scores s LEFT JOIN"
    " (SELECT * FROM issue_rows WHERE issue_idx = 0) USING (change_id))",
    "scores",
    "issue_rows",
)

# --- prompts --------------------------------------------------------------------------------------

add(
    "main_changes",
    f"SELECT change_id, main AS main_changes, array_to_string(patterns, {JOIN}) AS patterns FROM main_changes",
    "main_changes",
)
add("key_changes", "SELECT change_id, rank, path, change FROM keyed", "keyed")
add("security_issue_lines", "SELECT change_id, lines FROM security_lines", "security_lines")


def pieces(kind: str, text: str, values: dict[str, str], line: str, context: str) -> str:
    """A prompt as the piece before the files, a piece for each, the one after them."""
    before, after = around(text, "files")
    return (
        f"SELECT change_id, '{kind}' AS kind, cast(0 AS bigint) AS piece_no, {template(before, values)} AS prompt"
        f" FROM {context} UNION ALL SELECT change_id, '{kind}', {LAST_PIECE}, {template(after, values)} FROM {context}"
        f" UNION ALL SELECT change_id, '{kind}', file_idx + 1, {line} FROM files"
    )


add(
    "title_prompt",
    pieces(
        "title",
        fixed.TITLE_PROMPT,
        {
            "additions": "CASE WHEN total_additions = 0 THEN '' ELSE cast(total_additions AS varchar) END",
            "deletions": "CASE WHEN total_deletions = 0 THEN '' ELSE cast(total_deletions AS varchar) END",
            "languages": "languages",
            "mainChanges": "main",
        },
        "path",
        "main_changes LEFT JOIN langs USING (change_id)",
    ),
    "main_changes",
    "files",
    "langs",
)
add(
    "description_prompt",
    pieces(
        "description",
        fixed.DESCRIPTION_PROMPT,
        {
            "keyChanges": "keys",
            "patterns": "array_to_string(patterns, chr(10) || '- ')",
            "securityIssues": "lines",
        },
        "'- ' || path || ' (' || status || '): +' || additions || ' -' || deletions",
        "main_changes JOIN security_lines USING (change_id)"
        " JOIN (SELECT change_id, string_agg('File: ' || path || chr(10) || change, chr(10) || chr(10) ORDER BY rank)"
        " AS keys FROM keyed GROUP BY change_id) USING (change_id)",
    ),
    "main_changes",
    "files",
    "security_lines",
    "keyed",
)
_TEST_LANGUAGE = "coalesce(language, CASE " + " ".join(
    f"WHEN ends_with(path, '{e}') THEN '{n}'" for e, n in fixed.SUGGESTION_LANGUAGES.items()
) + " END, 'unknown')"
add(
    "testable_files",
    f"SELECT change_id, file_idx, path, {_TEST_LANGUAGE} AS test_language FROM testable",
    "testable",
)
add("test_file_choice", "SELECT change_id, file_rank, file_idx, path FROM chosen", "chosen")
add(
    "test_file_choice_input_order",
    "SELECT change_id, row_number() OVER (PARTITION BY change_id ORDER BY file_idx) AS file_rank, file_idx, path"
    " FROM testable QUALIFY file_rank <= 3",
    "testable",
)
add("function_names", "SELECT change_id, file_idx, name_idx, name FROM names", "names")
add("code_snippets", "SELECT change_id, file_idx, snippet_idx, snippet FROM snippets", "snippets")
add(
    "test_prompt",
    "SELECT change_id, 'tests' AS kind, file_idx, "
    + template(
        fixed.TEST_PROMPT,
        {"file": "path", "language": _TEST_LANGUAGE, "functions": "functions", "codeSnippets": "codes",
         "existingTestPatterns": "checks"},
    )
    + " AS prompt FROM chosen LEFT JOIN (SELECT change_id, file_idx, string_agg(name, chr(10) || '- '"
    " ORDER BY name_idx) AS functions, string_agg('checks ' || name, chr(10) || '- ' ORDER BY name_idx)"
    " FILTER (name_idx < 2) AS checks FROM names GROUP BY ALL) USING (change_id, file_idx)"
    " LEFT JOIN (SELECT change_id, file_idx, string_agg(snippet, chr(10) || chr(10) ORDER BY snippet_idx) AS codes"
    " FROM snippets GROUP BY ALL) USING (change_id, file_idx)",
    "chosen",
    "names",
    "snippets",
)

# --- answers ----------------------------------------------------------------------------------------

add(
    "answers_parsed",
    "SELECT change_id, kind, file_idx, status, text, CASE WHEN status = 'ok' THEN model_id END AS model,"
    " CASE WHEN status = 'ok' THEN n_in END AS tokens_input, CASE WHEN status = 'ok' THEN n_out END AS tokens_output,"
    " CASE WHEN status = 'ok' THEN n_in + n_out END AS tokens_total, duration_ms FROM parsed",
    "parsed",
)
add(
    "call_stats",
    "SELECT kind, count(*) AS total_requests, count(*) FILTER (status = 'ok') AS successful_requests,"
    " count(*) FILTER (status <> 'ok') AS failed_requests,"
    " round(count(*) FILTER (status = 'ok') / count(*), 10) AS success_rate FROM parsed GROUP BY kind",
    "parsed",
)
_PARTS = f"^({fixed.TITLE_TYPES})(?:\\(([^)]+)\\))?: (.+)$"


def _title_part(group: int) -> str:
    rx = lit(re2(_PARTS))
    return f"CASE WHEN regexp_matches(title, {rx}) THEN nullif(regexp_extract(title, {rx}, {group}), '') END"


add(
    "titles",
    f"SELECT change_id, title, {_title_part(1)} AS type, {_title_part(2)} AS scope, {_title_part(3)} AS description,"
    f" regexp_matches(title, {lit(re2(_PARTS))}) AS is_conventional, len(title) AS length FROM titles",
    "titles",
)
_CONVENTIONAL = lit(re2(f"^({fixed.TITLE_TYPES})(\\(.+\\))?: .+"))
add(
    "title_errors",
    f"SELECT change_id, title, concat_ws({JOIN}, CASE WHEN len(title) > 72 THEN 'Title exceeds 72 characters' END,"
    " CASE WHEN len(title) < 10 THEN 'Title is too short (minimum 10 characters)' END,"
    f" CASE WHEN NOT regexp_matches(title, {_CONVENTIONAL}) THEN"
    " 'Title does not follow conventional commit format' END) AS errors FROM titles",
    "titles",
)


def _section(heading: str) -> str:
    rest = f"regexp_extract(text, {lit(re2(f'##\\s*{heading}\\s*\\n([\\s\\S]*)', True))}, 1)"
    return trimmed(f"string_split({rest}, '##')[1]")


_BREAKING = lit(re2(r"breaking change[s]?:?\s*\n?-?\s*(.+)", True))
TABLES["described"] = (
    ("parsed",),
    "SELECT change_id, CASE WHEN what || why_changed || impact = '' THEN text ELSE what END AS what_changed,"
    " why_changed, impact, breaking FROM (SELECT change_id, text,"
    f" {_section('What Changed')} AS what, {_section('Why')} AS why_changed, {_section('Impact')} AS impact,"
    f" list_transform(regexp_extract_all(text, {_BREAKING}, 1), lambda x: {trimmed('x')}) AS breaking"
    " FROM parsed WHERE kind = 'description' AND status = 'ok')",
)
add(
    "descriptions",
    f"SELECT change_id, what_changed, why_changed, impact, array_to_string(breaking, {JOIN}) AS breaking_changes"
    " FROM described",
    "described",
)
_NN = "chr(10) || chr(10)"
add(
    "pr_texts",
    f"SELECT change_id, concat_ws({_NN}, '# ' || title, CASE WHEN what_changed <> '' THEN '## What Changed' || {_NN} ||"
    f" what_changed END, CASE WHEN why_changed <> '' THEN '## Why' || {_NN} || why_changed END,"
    f" CASE WHEN impact <> '' THEN '## Impact' || {_NN} || impact END, CASE WHEN len(breaking) > 0 THEN"
    f" '## Breaking Changes' || {_NN} || array_to_string(list_transform(breaking, lambda x: '- ' || x), chr(10)) END)"
    " AS pr_text FROM titles JOIN described USING (change_id)",
    "titles",
    "described",
)
_FENCES = lit("```[\\s\\S]*?```")
_FRAMEWORK = "CASE coalesce(language, 'typescript') " + " ".join(
    f"WHEN '{k}' THEN '{v[0]}'" for k, v in fixed.TEST_FRAMEWORKS.items()
) + " ELSE 'jest' END"


def _low_has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(b), '{w}')" for w in words) + ")"


TABLES["blocks"] = (
    ("chosen", "parsed"),
    "SELECT *, CASE WHEN len(regexp_extract_all(text, " + _FENCES + ")) > 0 THEN regexp_extract_all(text, " + _FENCES
    + ") WHEN contains(text, 'describe(') THEN list_transform(string_split(text, 'describe(')[2:],"
    " lambda x: 'describe(' || x) ELSE list_filter(string_split(text, chr(10) || chr(10)), lambda x: "
    + trimmed("x")
    + " <> '') END AS bs FROM (SELECT c.change_id, c.file_idx, c.file_rank, c.path, c.language, p.text,"
    " count(p.text) OVER (PARTITION BY c.change_id) = count(*) OVER (PARTITION BY c.change_id) AS complete"
    " FROM chosen c LEFT JOIN (SELECT * FROM parsed WHERE kind = 'tests') p USING (change_id, file_idx))"
    " WHERE complete",
)
_FENCED_BODY = lit("```(?:[0-9A-Za-z_]+)?\\n([\\s\\S]*?)```")
_SAID = lit("(?i:should|when|given)[\\s\\S]{0,100}")
_IT = lit("""it\\(['"]([^'"]+)['"]""")
TABLES["suggested"] = (
    ("blocks",),
    "SELECT change_id, file_idx, file_rank, block_idx, type, CASE WHEN regexp_matches(b, " + _IT
    + ") THEN regexp_extract(b, " + _IT + ", 1) ELSE 'Test case' END AS description,"
    f" CASE WHEN regexp_matches(b, {_SAID}) THEN {trimmed(f'regexp_extract(b, {_SAID})')}"
    " WHEN string_split(b, chr(10))[1] <> '' THEN left(string_split(b, chr(10))[1], 100) ELSE 'Test scenario' END"
    f" AS scenario, CASE WHEN regexp_extract(b, {_FENCED_BODY}, 1) <> '' THEN"
    f" {trimmed(f'regexp_extract(b, {_FENCED_BODY}, 1)')} ELSE {trimmed('b')} END AS code_snippet, framework,"
    " cast(CASE type WHEN 'unit' THEN 5 WHEN 'integration' THEN 3 ELSE 2 END AS bigint) AS priority FROM ("
    f"SELECT *, CASE WHEN {_low_has(fixed.INTEGRATION_WORDS)} THEN 'integration' WHEN {_low_has(fixed.E2E_WORDS)}"
    f" THEN 'e2e' ELSE 'unit' END AS type, {_FRAMEWORK} AS framework FROM (SELECT *, unnest(bs) AS b,"
    " unnest(range(len(bs))) AS block_idx FROM blocks))"
    " UNION ALL SELECT change_id, file_idx, file_rank, 0, 'unit', 'Test ' || path || ' functionality',"
    f" 'Verify core functionality works as expected', NULL, {_FRAMEWORK}, 4 FROM blocks WHERE len(bs) = 0"
    " UNION ALL SELECT change_id, file_idx, file_rank, 1, 'unit', 'Test ' || path || ' edge cases',"
    f" 'Handle edge cases and error conditions', NULL, {_FRAMEWORK}, 3 FROM blocks WHERE len(bs) = 0",
)
TABLES["numbered"] = (
    ("suggested",),
    "SELECT *, row_number() OVER (PARTITION BY change_id, type ORDER BY priority DESC, file_rank, block_idx) AS number"
    " FROM suggested",
)
TABLES["suggestion_sums"] = (
    ("suggested",),
    "SELECT change_id, count(*) AS total_suggestions, count(*) FILTER (type = 'unit') AS n_unit,"
    " count(*) FILTER (type = 'integration') AS n_integration, count(*) FILTER (type = 'e2e') AS n_e2e,"
    " least(50, count(*) FILTER (type = 'unit') * 5 + count(*) FILTER (type = 'integration') * 3"
    " + count(*) FILTER (type = 'e2e') * 2) AS coverage_improvement FROM suggested GROUP BY change_id",
)
add(
    "test_suggestions",
    "SELECT change_id, file_idx, block_idx, type, description, scenario, code_snippet, framework, priority, number"
    " FROM numbered",
    "numbered",
)
add(
    "suggestion_totals",
    "SELECT * FROM suggestion_sums UNION ALL SELECT DISTINCT change_id, 0, 0, 0, 0, 0 FROM files"
    " ANTI JOIN testable USING (change_id)",
    "suggestion_sums",
    "files",
    "testable",
)
add(
    "suggestion_texts",
    f"SELECT change_id, type, number, concat_ws({_NN}, '### ' || number || '. ' || description, '**Scenario:** ' ||"
    " scenario, CASE WHEN type <> 'e2e' THEN '**Framework:** ' || framework END, CASE WHEN type = 'unit' THEN"
    " '**Priority:** ' || priority END, CASE WHEN coalesce(code_snippet, '') <> '' THEN '```typescript' || chr(10) ||"
    " code_snippet || chr(10) || '```' END) AS suggestion_text FROM numbered",
    "numbered",
)

# --- reports ----------------------------------------------------------------------------------------------

_COMPACT = (
    f"'**Risk:** ' || overall_risk || ' (' || {half_up('overall_score')} || '/100)', '**Changes:** ' || total_files ||"
    " ' files, +' || total_additions || ' -' || total_deletions, CASE WHEN n_findings > 0 THEN '**Security:** ' ||"
    " n_findings || ' issue(s)' || CASE WHEN n_critical > 0 THEN ' (CRITICAL)' ELSE '' END END"
)
add("compact_report", f"SELECT change_id, concat_ws(chr(10), {_COMPACT}) AS compact_text FROM scores", "scores")
add(
    "compact_report_with_title",
    f"SELECT change_id, concat_ws(chr(10), {_COMPACT}, '**Title:** ' || title) AS compact_text"
    " FROM scores LEFT JOIN titles USING (change_id)",
    "scores",
    "titles",
)


def lines(section: int, source: str, start: str, *items: str) -> str:
    """Lines of a row; null ones are left out and the rest counted on."""
    return (
        f"SELECT change_id, {section} AS section_idx, {start} + unnest(range(len(ls))) AS line_idx, unnest(ls) AS line"
        f" FROM (SELECT *, list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS ls FROM {source})"
    )


def steps(level: str) -> list[str]:
    return [
        f"CASE WHEN overall_risk = '{level}' THEN {lit(f'{i}. {s}')} END" for i, s in enumerate(_NEXT_STEPS[level], 1)
    ]


_LIST_NAMES = {"added": "Added", "modified": "Modified", "deleted": "Deleted", "critical": "Critical Files",
               "test": "Test Files"}
_NAME = "CASE list " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LIST_NAMES.items()) + " END"
_ORDER = "CASE list " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_LIST_NAMES, 1)) + " END"
_REPORT = [
    lines(0, "scores", "0", "'# PR Readiness Analysis'",
          "'**Files Changed:** ' || total_files || ' | **Lines:** +' || total_additions || ' -' || total_deletions ||"
          " ' | **Base:** main'"),
    lines(1, "scores", "0", "'## Risk Assessment'",
          f"'**Overall Risk:** ' || overall_risk || ' (' || {half_up('overall_score')} || '/100)'",
          "'### Risk Factors'"),
    lines(1, "factors", "factor_idx * 10 + 10",
          "'- **' || upper(category[1]) || category[2:] || '** (' || cast(round(weight * 100) AS bigint) || '% weight)'",
          f"'  - Score: ' || {tenths('cast(score AS double)')} || '/100'", "'  - ' || explanation"),
    "SELECT change_id, 1, factor_idx * 10 + 13 + detail_idx, '    - ' || detail FROM details"
    " SEMI JOIN (SELECT change_id, factor_idx FROM factors WHERE score > 30) USING (change_id, factor_idx)"
    " WHERE detail_idx IN (0, 1)",
    "SELECT DISTINCT change_id, 1, 60, '### Critical Issues' FROM issue_rows",
    "SELECT change_id, 1, 61 + issue_idx, '- ' || issue FROM issue_rows",
    "SELECT change_id, 1, 80, '### Recommendations' FROM scores",
    "SELECT change_id, 1, 81 + rec_idx, '- ' || rec FROM rec_rows WHERE rec_idx < 5",
    "SELECT change_id, 3, 0, '## Change Summary' FROM scores",
    f"SELECT change_id, 3, {_ORDER}, '**' || {_NAME} || ' (' || any_value(n) || '):** ' ||"
    " string_agg(path, ', ' ORDER BY file_idx) FILTER (rn <= 3) || CASE WHEN any_value(n) > 3 THEN ' and ' ||"
    " any_value(n) - 3 || ' more' ELSE '' END FROM (SELECT *, row_number() OVER (PARTITION BY change_id, list"
    " ORDER BY file_idx) AS rn, count(*) OVER (PARTITION BY change_id, list) AS n FROM heads WHERE list <> 'config')"
    " GROUP BY change_id, list",
    lines(4, "(SELECT * FROM scores WHERE n_findings > 0)", "0", "'## Security Findings'",
          "'**Total Issues:** ' || n_findings", "'- Critical: ' || n_critical", "'- High: ' || n_high",
          "'- Medium: ' || n_medium", "'- Low: ' || n_low",
          "CASE WHEN n_critical > 0 THEN '**Contains critical security issues that must be fixed!**' END"),
    "SELECT change_id, 4, 10, '### Top Findings' FROM scores WHERE n_findings > 0",
    lines(4, f"(SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY priority DESC, {_DISCOVERY}) AS rank"
          " FROM diff_findings QUALIFY rank <= 5)", "rank * 10 + 10",
          "rank || '. **' || type || '** (' || severity || ')'", "'   - File: ' || file || ':' || line",
          "'   - ' || description", "'   - Fix: ' || recommendation"),
    lines(6, "scores", "0", "'---'", "'## Next Steps'", *steps("HIGH"), *steps("MEDIUM"), *steps("LOW"),
          f"'**Estimated Review Time:** ' || {_TIME_LONG}"),
]
_GENERATED = [
    "SELECT change_id, 2 AS section_idx, unnest(range(len(ls))) AS line_idx, unnest(ls) AS line FROM (SELECT change_id,"
    " list_concat(list_filter(['## Suggested PR Content', '### Title', '```', title, '```',"
    f" CASE WHEN regexp_matches(title, {lit(re2(_PARTS))}) THEN '✓ Follows conventional commit format' END,"
    " '### Description', CASE WHEN what_changed <> '' THEN '**What Changed**' END, nullif(what_changed, ''),"
    " CASE WHEN why_changed <> '' THEN '**Why**' END, nullif(why_changed, ''),"
    " CASE WHEN impact <> '' THEN '**Impact**' END, nullif(impact, ''),"
    " CASE WHEN len(breaking) > 0 THEN '**Breaking Changes**' END], lambda x: x IS NOT NULL),"
    " list_transform(breaking, lambda x: '- ' || x)) AS ls FROM titles JOIN described USING (change_id))",
    lines(5, "suggestion_sums", "0", "'## Test Suggestions'", "'**Total Suggestions:** ' || total_suggestions",
          "'- Unit Tests: ' || n_unit", "'- Integration Tests: ' || n_integration", "'- E2E Tests: ' || n_e2e",
          "CASE WHEN coverage_improvement > 0 THEN '**Estimated Coverage Improvement:** +' || coverage_improvement ||"
          " '%' END"),
    "SELECT change_id, 5, 10, '### Unit Tests' FROM suggestion_sums WHERE n_unit > 0",
    lines(5, "(SELECT * FROM numbered WHERE type = 'unit' AND number <= 3)", "number * 10 + 10",
          "number || '. ' || description", "'   - Priority: ' || priority", "'   - ' || scenario",
          "CASE WHEN code_snippet <> '' THEN '```typescript' END",
          "CASE WHEN code_snippet <> '' THEN array_to_string(string_split(code_snippet, chr(10))[1:10], chr(10)) END",
          "CASE WHEN code_snippet <> '' THEN '```' END"),
    "SELECT change_id, 5, 50, '### Integration Tests' FROM suggestion_sums WHERE n_integration > 0",
    lines(5, "(SELECT * FROM numbered WHERE type = 'integration' AND number <= 2)", "number * 10 + 50",
          "number || '. ' || description", "'   - ' || scenario"),
]
_REPORT_TABLES = ("scores", "factors", "details", "issue_rows", "rec_rows", "heads", "diff_findings", "facts",
                  "rec_entries")
_ENTRIES = (
    " UNION ALL SELECT change_id, 1, 24, file_idx + 1, path FROM facts SEMI JOIN (SELECT change_id FROM factors"
    " WHERE factor_idx = 1 AND score > 30) USING (change_id) WHERE complexity >= 15"
    " UNION ALL SELECT change_id, 1, 81 + rec_idx, entry_no, rec FROM rec_entries WHERE rec_idx < 5 AND entry_no > 0"
)


def _report(parts: list[str]) -> str:
    return (
        "SELECT change_id, cast(section_idx AS bigint) AS section_idx, cast(line_idx AS bigint) AS line_idx,"
        f" cast(0 AS bigint) AS entry_no, line FROM ({' UNION ALL '.join(parts)}){_ENTRIES}"
    )


add("report_without_answers", _report(_REPORT), *_REPORT_TABLES)
add("report_lines", _report(_REPORT + _GENERATED), *_REPORT_TABLES, "titles", "described", "numbered",
    "suggestion_sums")
