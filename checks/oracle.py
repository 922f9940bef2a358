"""DuckDB SQL for the catalogue's queries.

The statements work line by line with running sums and windows, while the Spark
side works on nested arrays, so the two share inputs and fixed values but not
the way to the result.
"""

from __future__ import annotations

from changelens.functions import fixed
from changelens.functions.regex import RE2_LINE_CHAR, RE2_SPACE, any_of, re2
from changelens.functions.rows import FILES_PER_PART
from changelens.sources import fixtures

DUCK = fixtures.Dialect(
    int_div="//",
    lines="string_split(text, chr(10))",
    first="l[1]",
    marked="nullif(array_to_string(list_transform(l[{a}:{b}], lambda x: concat('{mark}', x)), chr(10)), '')",
)


def lit(text: str) -> str:
    """A SQL literal; line ends are spelled out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def matches(column: str, patterns, ignore_case: bool = False) -> str:
    return f"regexp_matches({column}, {lit(any_of(patterns, re2, ignore_case))})"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{RE2_SPACE}]+|[{RE2_SPACE}]+$')}, '', 'g')"


def language_case(ext: str) -> str:
    whens = " ".join(
        f"WHEN {ext} IN ({', '.join(lit(e) for e in extensions)}) THEN {lit(name)}"
        for name, extensions in fixed.LANGUAGE_EXTENSIONS.items()
    )
    return f"CASE {whens} END"


def extension(path: str) -> str:
    return f"CASE WHEN contains({path}, '.') THEN '.' || string_split({path}, '.')[-1] ELSE {path} END"


def half_up(x: str) -> str:
    return f"cast(floor({x} + 0.5) AS bigint)"


def tenths(x: str) -> str:
    """One decimal from the exact decimal expansion, half up."""
    digits = f"printf('%.40f', {x})"
    cut = f"cast(string_split({digits}, '.')[1] AS bigint) * 10 + cast(string_split({digits}, '.')[2][1] AS bigint)"
    n = f"({cut} + CASE WHEN string_split({digits}, '.')[2][2] >= '5' THEN 1 ELSE 0 END)"
    return f"({n} // 10 || '.' || {n} % 10)"


def present(*items: str) -> str:
    """A list of the items that are not null."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


PATTERNS = "(VALUES " + ", ".join(
    f"({n}, {lit(kind)}, {lit(severity)}, {fixed.SEVERITY_PRIORITY[severity]}, {lit(regex)}, "
    f"{lit(fixed.ISSUE_DESCRIPTIONS[kind])}, {lit(fixed.ISSUE_RECOMMENDATIONS[kind])}, "
    f"cast({confidence} AS double))"
    for n, (kind, regex, severity, confidence, _) in enumerate(fixed.SECRET_PATTERNS)
) + ") AS p(pattern_idx, type, severity, priority, pattern, description, recommendation, confidence)"

_FALSE = "(" + " OR ".join(
    f"regexp_matches(m, {lit(re2(p, ignore_case))})" for p, ignore_case in fixed.FALSE_POSITIVES
) + ")"


def hits(table: str, keys: str, custom: list[tuple[int, str]] = ()) -> str:
    """Matches in a table of (keys, path, line, line_ord, txt), pattern by pattern."""
    selects = []
    rules = [(n, regex, exclude, True) for n, (_, regex, _, _, exclude) in enumerate(fixed.SECRET_PATTERNS)]
    rules += [(n, regex, (), False) for n, regex in custom]
    for n, regex, exclude, ruled in rules:
        rx = lit(re2(regex, ignore_case=True))
        where = f"regexp_matches(txt, {rx})"
        if ruled:
            where += f" AND NOT {matches('path', fixed.EXCLUDED_PATHS)}"
        if exclude:
            where += f" AND NOT {matches('path', exclude)}"
        start = (
            "list_transform(range(1, len(ms) + 1), lambda j: list_sum(list_transform(ps[1:j], lambda x: len(x)))"
            " + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: len(x))), 0))"
        )
        selects.append(
            f"SELECT {keys}, path AS file, line, line_ord, cast({n} AS bigint) AS pattern_idx, unnest(ms) AS m,"
            f" unnest(range(len(ms))) AS match_idx, unnest({start}) AS col FROM (SELECT {keys}, path, line, line_ord,"
            f" regexp_extract_all(txt, {rx}) AS ms, regexp_split_to_array(txt, {rx}) AS ps FROM {table} WHERE {where})"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(selects)}) WHERE NOT {_FALSE}"


def findings(source: str, keys: str) -> str:
    return (
        f'SELECT {keys}, file, cast(line AS bigint) AS line, cast(col AS bigint) AS "column", type, severity, m AS content,'
        " pattern, description, recommendation, confidence, cast(line_ord AS bigint) AS line_ord,"
        f" pattern_idx, cast(match_idx AS bigint) AS match_idx, priority FROM {source} JOIN {PATTERNS} USING (pattern_idx)"
    )


_HUNK = r"^@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@"
_OLD = f"^--- a/({RE2_LINE_CHAR}+)$"
_NEW = f"^\\+\\+\\+ b/({RE2_LINE_CHAR}+)$"


def _hunk_number(group: int) -> str:
    digits = f"regexp_extract(line, {lit(_HUNK)}, {group})"
    return f"CASE WHEN {digits} = '' THEN 1 ELSE cast({digits} AS bigint) END"


_FILE = "change_id, part_idx, fno"
_SOURCES = " UNION ALL ".join(
    f"SELECT change_id, part_idx, {i} AS rank, '{kind}' AS source_kind, {text} AS diff_text FROM chunks"
    for i, (kind, text) in enumerate(fixtures.SOURCE_TEXTS.items())
)


def _responses() -> str:
    return " UNION ALL ".join(
        f"SELECT {', '.join(columns)} FROM scan_files WHERE {where}" for columns, where in fixtures.responses_sql()
    )


_CATEGORY = " UNION ALL ".join(
    f"SELECT change_id, file_idx, {i} AS cat_idx, '{name}' AS category FROM facts WHERE is_critical AND ("
    + " OR ".join(f"regexp_matches(path, {lit(w)})" for w in words) + ")"
    for i, (name, words) in enumerate(fixed.CRITICAL_CATEGORIES.items())
)


def _band(n: str, large: int, medium: int, most: int, half: int) -> str:
    return f"CASE WHEN {n} >= {large} THEN {most}.0 WHEN {n} >= {medium} THEN {half}.0 ELSE {n} / {medium}.0 * {half} END"


_AT = fixed.SIZE_THRESHOLDS
_SEVERITIES = [s.lower() for s in fixed.SEVERITY_PRIORITY]
_W = fixed.RISK_WEIGHTS

# Common tables: name -> (tables it reads, statement).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "scan_files": ((), f"SELECT {', '.join(fixtures.scan_files_sql(DUCK))} FROM documents"),
    "lns": (("scan_files",), f"SELECT {', '.join(fixtures.lines_sql(DUCK))} FROM scan_files"),
    "chunks": (("lns",), f"SELECT {', '.join(fixtures.chunk_sql(DUCK))} FROM lns"),
    "sources": (("chunks",), _SOURCES),
    "chosen_sources": (
        ("sources",),
        f"SELECT * FROM sources WHERE regexp_matches(diff_text, {lit(f'[^{RE2_SPACE}]')})"
        " QUALIFY rank = min(rank) OVER (PARTITION BY change_id)",
    ),
    "raw_lines": (
        ("chunks",),
        "SELECT change_id, part_idx, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS ln"
        " FROM (SELECT change_id, part_idx, string_split(chunk, chr(10)) AS a FROM chunks)",
    ),
    "segments": (
        ("raw_lines",),
        "SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END)"
        " OVER (PARTITION BY change_id, part_idx ORDER BY ln) AS fno FROM raw_lines WHERE line <> ''",
    ),
    "kinds": (
        ("segments",),
        "SELECT *, sum(CASE WHEN kind = 'hunk' THEN 1 ELSE 0 END)"
        f" OVER (PARTITION BY {_FILE} ORDER BY ln) AS hno FROM (SELECT *, CASE"
        " WHEN starts_with(line, 'diff --git ') THEN 'file' WHEN starts_with(line, '--- ') THEN 'old'"
        " WHEN starts_with(line, '+++ ') THEN 'new' WHEN starts_with(line, 'Binary files ') THEN 'binary'"
        f" WHEN regexp_matches(line, {lit(_HUNK)}) THEN 'hunk' WHEN starts_with(line, '@@') THEN 'bad'"
        " WHEN left(line, 1) IN ('+', '-', ' ') THEN left(line, 1) ELSE 'other' END AS kind"
        " FROM segments WHERE fno > 0)",
    ),
    "file_rows": (
        ("kinds",),
        f"SELECT {_FILE}, count_if(kind = 'hunk') AS n_hunks,"
        " count_if(kind = '+' AND hno > 0) AS additions, count_if(kind = '-' AND hno > 0) AS deletions,"
        f" arg_max(regexp_extract(line, {lit(_OLD)}, 1), ln) FILTER (regexp_matches(line, {lit(_OLD)})) AS old_path,"
        f" arg_max(regexp_extract(line, {lit(_NEW)}, 1), ln) FILTER (regexp_matches(line, {lit(_NEW)})) AS new_path,"
        " arg_max(line, ln) FILTER (line IN ('--- /dev/null', '+++ /dev/null')) AS null_line,"
        " bool_or(kind = 'binary') AS \"binary\", bool_or(kind = 'bad') AS parse_warning"
        f" FROM kinds GROUP BY {_FILE} HAVING count_if(kind = 'hunk') > 0",
    ),
    "files": (
        ("file_rows",),
        "SELECT *, coalesce(CASE WHEN null_line = '+++ /dev/null' THEN old_path ELSE new_path END, '') AS path,"
        " CASE null_line WHEN '--- /dev/null' THEN 'added' WHEN '+++ /dev/null' THEN 'deleted' ELSE 'modified' END"
        f" AS status, {language_case(extension('new_path'))} AS language,"
        f" part_idx * {FILES_PER_PART} + row_number() OVER (PARTITION BY change_id, part_idx ORDER BY fno) - 1"
        " AS file_idx FROM file_rows",
    ),
    "hunks": (
        ("kinds", "files"),
        "SELECT f.change_id, f.part_idx, f.fno, f.file_idx, f.path, hno,"
        " cast(hno - 1 AS bigint) AS hunk_idx,"
        + ", ".join(
            f"{_hunk_number(i)} AS {c}" for i, c in enumerate(("old_start", "old_lines", "new_start", "new_lines"), 1)
        )
        + f", line AS header FROM kinds JOIN files f USING ({_FILE}) WHERE kind = 'hunk'",
    ),
    "changes": (
        ("kinds", "hunks"),
        f"SELECT change_id, file_idx, path, hunk_idx,"
        " row_number() OVER w - 1 AS change_idx,"
        " new_start + coalesce(count_if(kind IN ('+', ' ')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " AS line_number,"
        " CASE WHEN kind <> '+' THEN old_start + coalesce(count_if(kind IN ('-', ' '))"
        " OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS old_line_number,"
        " CASE kind WHEN '+' THEN 'addition' WHEN '-' THEN 'deletion' ELSE 'context' END AS type,"
        f" substr(line, 2) AS content FROM kinds JOIN hunks USING ({_FILE}, hno)"
        f" WHERE kind IN ('+', '-', ' ') WINDOW w AS (PARTITION BY {_FILE}, hno ORDER BY ln)",
    ),
    "added": (
        ("changes",),
        "SELECT change_id, file_idx, path, line_number AS line, content AS txt,"
        " row_number() OVER (PARTITION BY change_id, file_idx ORDER BY hunk_idx, change_idx) - 1 AS line_ord"
        " FROM changes WHERE type = 'addition'",
    ),
    "scanned": (("added", "files"), "SELECT a.* FROM added a JOIN files f USING (change_id, file_idx) WHERE NOT f.\"binary\""),
    "diff_hits": (("scanned",), hits("scanned", "change_id, file_idx")),
    "diff_findings": (("diff_hits",), findings("diff_hits", "change_id, file_idx")),
    "doc_lines": (
        ("scan_files",),
        "SELECT doc_id, source, path, unnest(a) AS txt, unnest(range(1, len(a) + 1)) AS line,"
        " unnest(range(len(a))) AS line_ord"
        " FROM (SELECT *, string_split(text, chr(10)) AS a FROM scan_files)",
    ),
    "doc_hits": (("doc_lines",), hits("doc_lines", "doc_id, source")),
    "doc_findings": (("doc_hits",), findings("doc_hits", "doc_id, source")),
    "complexities": (
        ("files", "added"),
        "SELECT change_id, file_idx, least(30.0, least(10.0, any_value(n_hunks))"
        " + least(10.0, any_value(additions + deletions) / 50.0)"
        " + coalesce(sum(least(5.0, len(regexp_extract(a.txt, "
        + lit(f"^[{RE2_SPACE}]+")
        + ")) / 4.0)) FILTER (a.txt IS NOT NULL), 0)) AS complexity FROM files LEFT JOIN added a USING (change_id, file_idx)"
        " GROUP BY change_id, file_idx",
    ),
    "facts": (
        ("files", "complexities"),
        f"SELECT files.*, complexity, {matches('path', fixed.CRITICAL_PATHS)} AS is_critical,"
        f" {matches('path', fixed.TEST_PATHS)} AS is_test, {matches('path', fixed.CONFIG_PATHS)} AS is_config"
        " FROM files JOIN complexities USING (change_id, file_idx)",
    ),
    "severities": (
        ("diff_findings",),
        "SELECT change_id, count(*) AS n_findings, "
        + ", ".join(f"count_if(severity = '{s.upper()}') AS n_{s}" for s in _SEVERITIES)
        + " FROM diff_findings GROUP BY change_id",
    ),
    "profile": (
        ("facts", "severities"),
        "SELECT *, coalesce(n_findings_, 0) AS n_findings, "
        + ", ".join(f"coalesce(n_{s}_, 0) AS n_{s}" for s in _SEVERITIES)
        + " FROM (SELECT change_id, count(*) AS total_files, cast(sum(additions) AS bigint) AS total_additions,"
        " cast(sum(deletions) AS bigint) AS total_deletions, count_if(status = 'added') AS n_added,"
        " count_if(status = 'modified') AS n_modified, count_if(status = 'deleted') AS n_deleted,"
        " count_if(is_critical) AS n_critical_files, count_if(is_test) AS n_test_files,"
        " count_if(is_config) AS n_config_files,"
        f" count_if(status = 'modified' AND {matches('path', [fixed.DOC_PATHS], True)}) AS n_modified_docs,"
        " count_if(complexity >= 15) AS n_complex, sum(cast(round(complexity * 100) AS bigint)) / 100.0 AS total_complexity,"
        " max(complexity) AS max_complexity FROM facts GROUP BY change_id)"
        " LEFT JOIN (SELECT change_id, n_findings AS n_findings_, "
        + ", ".join(f"n_{s} AS n_{s}_" for s in _SEVERITIES)
        + " FROM severities) USING (change_id)",
    ),
    "categories": (
        ("facts",),
        "SELECT change_id, string_agg(category, ', ' ORDER BY first, cat_idx) AS categories,"
        " bool_or(category IN ('core', 'authentication')) AS bonus,"
        " bool_or(category IN ('core', 'api', 'database')) AS core FROM (SELECT change_id, cat_idx, category,"
        f" min(file_idx) AS first FROM ({_CATEGORY}) GROUP BY ALL) GROUP BY change_id",
    ),
    "directories": (
        ("files",),
        "SELECT change_id, CASE WHEN regexp_extract(path, '^(.*)/', 1) = '' THEN '.' ELSE"
        " regexp_extract(path, '^(.*)/', 1) END AS name, count(*) AS n_files, min(file_idx) AS first"
        " FROM files GROUP BY ALL",
    ),
    "extensions": (
        ("files",),
        f"SELECT change_id, {extension('path')} AS name, count(*) AS n_files, min(file_idx) AS first"
        " FROM files GROUP BY ALL",
    ),
    "splits": (
        ("directories", "extensions"),
        "SELECT change_id, 'directory' AS kind, 'Split by directory: ' ||"
        " string_agg(name || ' (' || n_files || ' files)', ', ' ORDER BY rn) AS suggestion FROM (SELECT *,"
        " row_number() OVER (PARTITION BY change_id ORDER BY n_files DESC, first) AS rn,"
        " count(*) OVER (PARTITION BY change_id) AS n FROM directories) WHERE n > 1 AND rn <= 3 GROUP BY change_id"
        " UNION ALL SELECT change_id, 'type', 'Split by type: ' ||"
        " string_agg(name || ' (' || n_files || ' files)', ', ' ORDER BY first)"
        " FROM extensions GROUP BY change_id HAVING count(*) > 1",
    ),
    "types": (
        ("extensions",),
        "SELECT change_id, cast(0 AS bigint) AS entry_no, 'Split by type: ' AS text FROM extensions GROUP BY change_id"
        " HAVING count(*) > 1 UNION ALL SELECT change_id, first + 1, name || ' (' || n_files || ' files)' FROM extensions"
        " SEMI JOIN (SELECT change_id FROM extensions GROUP BY change_id HAVING count(*) > 1) USING (change_id)",
    ),
    "scores": (
        ("profile", "categories", "splits", "facts"),
        "SELECT *, CASE WHEN overall_score >= 75 THEN 'HIGH' WHEN overall_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
        " AS overall_risk FROM (SELECT *, least(100.0, greatest(0.0,"
        f" security_score * {_W['security']}e0 + complexity_score * {_W['complexity']}e0"
        f" + size_score * {_W['changeSize']}e0 + critical_score * {_W['criticalFiles']}e0)) AS overall_score FROM ("
        "SELECT p.*, least(100.0, n_critical * 25 + n_high * 15 + n_medium * 8 + n_low * 3) AS security_score,"
        " n_critical > 0 OR n_high > 2 AS blocking, total_complexity / total_files AS avg_complexity,"
        " least(100.0, n_complex * 20 + least(50.0, total_complexity / total_files * 3)) AS complexity_score,"
        f" least(100.0, {_band('total_files', _AT['large_files'], _AT['medium_files'], 40, 20)} +"
        f" {_band('(total_additions + total_deletions)', _AT['large_lines'], _AT['medium_lines'], 60, 30)})"
        " AS size_score, total_files >= 20 OR total_additions + total_deletions >= 500 AS too_large,"
        " categories, coalesce(core, false) AS core,"
        " least(100.0, list_sum(list_transform(range(cast(n_critical_files AS bigint)), lambda i: greatest(5, 30 - i * 5)))"
        " + CASE WHEN bonus THEN 20 ELSE 0 END) AS critical_score_, coalesce(critical_score_, 0) AS critical_score,"
        " dir.suggestion AS by_directory, typ.suggestion AS by_type, complex_head"
        " FROM profile p LEFT JOIN categories USING (change_id)"
        " LEFT JOIN (SELECT * FROM splits WHERE kind = 'directory') dir USING (change_id)"
        " LEFT JOIN (SELECT * FROM splits WHERE kind = 'type') typ USING (change_id)"
        " LEFT JOIN (SELECT change_id, string_agg(path, ', ' ORDER BY file_idx) AS complex_head FROM"
        " (SELECT * FROM facts WHERE complexity >= 15"
        " QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY file_idx) <= 3) GROUP BY change_id) h"
        " USING (change_id)))",
    ),
    "explained": (
        ("scores",),
        "SELECT *, CASE WHEN n_critical > 0 THEN n_critical || ' critical security issue(s) found'"
        " WHEN n_high > 0 THEN n_high || ' high severity security issue(s) found'"
        " WHEN n_medium > 0 THEN n_medium || ' medium severity security issue(s) found'"
        " WHEN n_low > 0 THEN n_low || ' low severity security issue(s) found'"
        " ELSE 'No security issues detected' END AS why_security,"
        " CASE WHEN n_complex > 0 THEN n_complex || ' file(s) with high complexity'"
        " WHEN avg_complexity >= 10 THEN 'Moderate code complexity' ELSE 'Low code complexity' END AS why_complexity,"
        " CASE WHEN too_large THEN 'Large change set - consider splitting'"
        " WHEN total_files >= 10 THEN 'Medium-sized change set' ELSE 'Small, focused change set' END AS why_size,"
        " CASE WHEN n_critical_files > 0 THEN n_critical_files || ' critical file(s) affected'"
        " ELSE 'No critical files affected' END AS why_critical FROM scores",
    ),
    "factors": (
        ("explained",),
        "SELECT change_id, factor_idx, category, score, weight, score * weight AS weighted_score, explanation FROM ("
        + " UNION ALL ".join(
            f"SELECT change_id, cast({i} AS bigint) AS factor_idx, '{c}' AS category, {s} AS score,"
            f" cast({_W[c]} AS double) AS weight, {why} AS explanation FROM explained"
            for i, (c, s, why) in enumerate(
                [("security", "security_score", "why_security"), ("complexity", "complexity_score", "why_complexity"),
                 ("changeSize", "size_score", "why_size"), ("criticalFiles", "critical_score", "why_critical")]
            )
        )
        + ")",
    ),
    "details": (
        ("scores", "facts"),
        "SELECT change_id, factor_idx, row_number() OVER (PARTITION BY change_id, factor_idx ORDER BY i) - 1"
        " AS detail_idx, detail FROM ("
        "SELECT change_id, 0 AS factor_idx, 0 AS i, CASE WHEN n_critical > 0 THEN n_critical ||"
        " ' critical severity findings' WHEN n_high > 0 THEN n_high || ' high severity findings'"
        " WHEN n_medium > 0 THEN n_medium || ' medium severity findings' WHEN n_low > 0 THEN n_low ||"
        " ' low severity findings' ELSE 'Clean security scan' END AS detail FROM scores"
        " UNION ALL SELECT change_id, 0, 1, '⚠️ Contains blocking security issues' FROM scores WHERE blocking"
        f" UNION ALL SELECT change_id, 1, 0, 'Average complexity: ' || {tenths('avg_complexity')} FROM scores"
        " UNION ALL SELECT change_id, 1, 1, 'High complexity files: ' FROM facts WHERE complexity >= 15 GROUP BY change_id"
        " UNION ALL SELECT change_id, 2, 0, total_files || ' files changed' FROM scores"
        " UNION ALL SELECT change_id, 2, 1, '+' || total_additions || ' -' || total_deletions || ' lines' FROM scores"
        " UNION ALL SELECT change_id, 2, 2, by_directory FROM scores WHERE too_large"
        " UNION ALL SELECT change_id, 2, 3, 'Split by type: ' FROM scores WHERE too_large AND by_type IS NOT NULL"
        " UNION ALL SELECT change_id, 3, 0, CASE WHEN n_critical_files > 0 THEN 'Categories: ' ||"
        " coalesce(categories, '') ELSE 'Changes are in non-critical areas' END FROM scores"
        " UNION ALL SELECT change_id, 3, 1, '⚠️ Affects core functionality' FROM scores"
        " WHERE n_critical_files > 0 AND core) WHERE detail IS NOT NULL",
    ),
    "detail_entries": (
        ("details", "facts", "types"),
        "SELECT change_id, cast(factor_idx AS bigint) AS factor_idx, detail_idx, cast(0 AS bigint) AS entry_no, detail"
        " FROM details UNION ALL SELECT change_id, 1, 1, file_idx + 1, path FROM facts WHERE complexity >= 15"
        " UNION ALL SELECT t.change_id, 2, d.detail_idx, entry_no, text FROM types t JOIN details d USING (change_id)"
        " WHERE d.detail = 'Split by type: ' AND entry_no > 0",
    ),
    "rec_entries": (
        ("rec_rows", "types"),
        "SELECT change_id, rec_idx, cast(0 AS bigint) AS entry_no, rec FROM rec_rows UNION ALL SELECT r.change_id,"
        " rec_idx, t.entry_no, text FROM rec_rows r JOIN types t USING (change_id)"
        " WHERE rec = 'Suggested splits: Split by type: ' AND t.entry_no > 0",
    ),
    "rec_rows": (
        ("scores",),
        "SELECT change_id, unnest(recs) AS rec, unnest(range(len(recs))) AS rec_idx FROM (SELECT change_id, "
        + present(
            "CASE WHEN security_score > 50 AND n_critical > 0 THEN"
            " '🚨 CRITICAL: Fix all critical security issues before merging' END",
            "CASE WHEN security_score > 50 AND n_critical > 0 THEN"
            " 'Remove hardcoded secrets and use environment variables' END",
            "CASE WHEN security_score > 50 AND n_high > 0 THEN '⚠️ Address high severity security findings' END",
            "CASE WHEN security_score > 50 AND blocking THEN 'Security scan has blocking issues - review required' END",
            "CASE WHEN complexity_score > 50 AND n_complex > 0 THEN 'Consider refactoring high complexity functions' END",
            "CASE WHEN complexity_score > 50 AND n_complex > 0 THEN 'Review these files: ' || complex_head END",
            "CASE WHEN complexity_score > 50 THEN 'Add unit tests for complex logic' END",
            "CASE WHEN too_large THEN '📦 Consider splitting this PR into smaller, focused changes' END",
            "CASE WHEN too_large THEN 'Suggested splits: ' || coalesce(by_directory,"
            " CASE WHEN by_type IS NOT NULL THEN 'Split by type: ' END) END",
            "CASE WHEN core THEN '🔍 Extra review needed - changes affect core functionality' END",
            "CASE WHEN core THEN 'Ensure comprehensive test coverage for critical changes' END",
            "CASE WHEN overall_risk = 'HIGH' THEN '⏰ Schedule thorough code review with senior team members' END",
            "CASE WHEN overall_risk = 'HIGH' THEN 'Consider staging deployment before production' END",
            "CASE WHEN overall_risk = 'MEDIUM' THEN '👀 Standard code review recommended' END",
            "CASE WHEN overall_risk = 'MEDIUM' THEN 'Verify test coverage is adequate' END",
            "CASE WHEN overall_risk = 'LOW' THEN '✅ Low risk - standard review process applies' END",
            "CASE WHEN complexity_score > 30 OR critical_score > 30 THEN"
            " 'Add integration tests for changed components' END",
        )
        + " AS recs FROM scores)",
    ),
    "issue_rows": (
        ("scores",),
        "SELECT change_id, unnest(found) AS issue, unnest(range(len(found))) AS issue_idx FROM (SELECT change_id, "
        + present(
            "CASE WHEN n_critical > 0 THEN n_critical || ' critical security vulnerability(ies) detected' END",
            "CASE WHEN blocking THEN 'Security scan contains blocking issues that prevent merge' END",
            "CASE WHEN n_complex > 3 THEN n_complex || ' files with very high complexity' END",
            "CASE WHEN total_files > 30 THEN 'Large change set (' || total_files || ' files) - difficult to review' END",
            "CASE WHEN core AND n_critical_files > 5 THEN n_critical_files || ' critical system files modified' END",
        )
        + " AS found FROM scores)",
    ),
    "type_totals": (
        ("diff_findings",),
        "SELECT change_id, type, count(*) AS n, min((-priority, file_idx, line_ord, pattern_idx, match_idx)) AS seen"
        " FROM diff_findings GROUP BY ALL",
    ),
    "langs": (
        ("files",),
        "SELECT change_id, string_agg(language, ', ' ORDER BY first) AS languages FROM (SELECT change_id, language,"
        " min(file_idx) AS first FROM files WHERE language IS NOT NULL GROUP BY ALL) GROUP BY change_id",
    ),
    "keyed": (
        ("files",),
        "SELECT change_id, row_number() OVER (PARTITION BY change_id ORDER BY additions + deletions DESC, file_idx)"
        " AS rank, path, status || ': +' || additions || ' -' || deletions || ' (' || additions + deletions ||"
        " ' lines changed)' AS change FROM files QUALIFY rank <= 5",
    ),
    "main_changes": (
        ("profile",),
        "SELECT *, concat_ws(', ', CASE WHEN n_added > 0 THEN 'Added ' || n_added || ' file(s)' END,"
        " CASE WHEN n_modified > 0 THEN 'Modified ' || n_modified || ' file(s)' END,"
        " CASE WHEN n_deleted > 0 THEN 'Deleted ' || n_deleted || ' file(s)' END,"
        " CASE WHEN n_critical_files > 0 THEN n_critical_files || ' critical file(s) affected' END) AS main, "
        + present(
            "CASE WHEN n_added > n_deleted THEN 'New feature implementation' END",
            "CASE WHEN n_modified > n_added AND n_deleted > 0 THEN 'Code refactoring' END",
            "CASE WHEN n_test_files > 0 THEN 'Test coverage updates (' || n_test_files || ' test files)' END",
            "CASE WHEN n_config_files > 0 THEN 'Configuration changes (' || n_config_files || ' config files)' END",
            "CASE WHEN n_modified_docs > 0 THEN 'Documentation updates' END",
        )
        + " AS found, CASE WHEN len(found) = 0 THEN ['General code changes'] ELSE found END AS patterns FROM profile",
    ),
    "security_lines": (
        ("profile", "type_totals"),
        "SELECT change_id, concat_ws(chr(10) || '- ',"
        " CASE WHEN n_critical > 0 THEN '⚠️ ' || n_critical || ' CRITICAL security issue(s) found' END,"
        " CASE WHEN n_high > 0 THEN '⚠️ ' || n_high || ' HIGH severity security issue(s) found' END,"
        " 'Issue types: ' || tops) AS lines FROM profile LEFT JOIN (SELECT change_id,"
        " string_agg(type || ': ' || n, ', ' ORDER BY n DESC, seen) AS tops FROM (SELECT * FROM type_totals"
        " QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY n DESC, seen) <= 3) GROUP BY change_id)"
        " USING (change_id)",
    ),
    "testable": (
        ("files",),
        "SELECT * FROM files WHERE status <> 'deleted' AND NOT \"binary\" AND NOT ("
        + " OR ".join(f"contains(path, {lit(p)})" for p in [*fixed.TEST_PATH_PARTS, ".config."])
        + " OR " + " OR ".join(f"ends_with(path, {lit(e)})" for e in fixed.CONFIG_PATH_ENDINGS)
        + ") AND (" + " OR ".join(f"ends_with(path, {lit(e)})" for e in fixed.TESTABLE_EXTENSIONS) + ")",
    ),
    "chosen": (
        ("testable",),
        "SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY additions + deletions DESC, file_idx)"
        " AS file_rank FROM testable QUALIFY file_rank <= 5",
    ),
    "names": (
        ("testable", "added"),
        "SELECT change_id, file_idx, name, row_number() OVER (PARTITION BY change_id, file_idx ORDER BY seen) - 1"
        " AS name_idx FROM (SELECT change_id, file_idx, name, min((line_ord, rx, i)) AS seen FROM ("
        + " UNION ALL ".join(
            f"SELECT change_id, file_idx, line_ord, {n} AS rx, unnest(ns) AS name, unnest(range(len(ns))) AS i FROM"
            f" (SELECT change_id, file_idx, line_ord, regexp_extract_all(txt, {lit(re2(p))}, 1) AS ns"
            " FROM added SEMI JOIN testable USING (change_id, file_idx))"
            for n, p in enumerate(fixed.FUNCTION_PATTERNS)
        )
        + ") GROUP BY ALL)",
    ),
    "snippets": (
        ("changes", "testable"),
        "SELECT * FROM (SELECT change_id, file_idx, string_agg(content, chr(10) ORDER BY hunk_idx, change_idx)"
        " AS snippet, row_number() OVER (PARTITION BY change_id, file_idx ORDER BY min((hunk_idx, change_idx))) - 1"
        " AS snippet_idx FROM (SELECT *, (row_number() OVER (PARTITION BY change_id, file_idx, island"
        " ORDER BY hunk_idx, change_idx) - 1) // 5 AS chunk FROM (SELECT *, sum(CASE WHEN type <> 'addition'"
        " THEN 1 ELSE 0 END) OVER (PARTITION BY change_id, file_idx ORDER BY hunk_idx, change_idx) AS island"
        " FROM changes SEMI JOIN testable USING (change_id, file_idx)) WHERE type = 'addition')"
        " GROUP BY change_id, file_idx, island, chunk) WHERE snippet_idx < 3",
    ),
    "responses": (("scan_files",), _responses()),
    "parsed": (
        ("responses",),
        "SELECT *, CASE WHEN status = 'ok' THEN "
        + trimmed("said")
        + " END AS text FROM (SELECT change_id, kind, file_idx, duration_ms,"
        " json_extract_string(raw, '$.results[0].generated_text') AS said,"
        " CASE WHEN json_extract(raw, '$.results[0]') IS NULL THEN 'no results'"
        " WHEN coalesce(json_extract_string(raw, '$.results[0].generated_text'), '') = '' THEN 'no text'"
        " ELSE 'ok' END AS status, json_extract_string(raw, '$.model_id') AS model_id,"
        " coalesce(cast(json_extract_string(raw, '$.results[0].input_token_count') AS bigint), 0) AS n_in,"
        " coalesce(cast(json_extract_string(raw, '$.results[0].generated_token_count') AS bigint), 0) AS n_out"
        " FROM responses)",
    ),
    "titles": (
        ("parsed",),
        "SELECT change_id, title FROM (SELECT change_id, regexp_replace(regexp_replace(text, '^[\"'']|[\"'']$', '',"
        " 'g'), '[.!?]+$', '') AS title FROM parsed WHERE kind = 'title' AND status = 'ok')",
    ),
    "heads": (
        ("facts",),
        "SELECT change_id, list, file_idx, path FROM (SELECT *, CASE status WHEN 'added' THEN 'added'"
        " WHEN 'deleted' THEN 'deleted' ELSE 'modified' END AS list FROM facts"
        " UNION ALL SELECT *, 'critical' FROM facts WHERE is_critical UNION ALL SELECT *, 'test' FROM facts"
        " WHERE is_test UNION ALL SELECT *, 'config' FROM facts WHERE is_config)",
    ),
}


def statement(select: str, *tables: str) -> str:
    """A statement with the common tables it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in TABLES[name][0]:
                add(needed)
            ordered.append(name)

    for table in tables:
        add(table)
    ctes = ", ".join(f"{name} AS MATERIALIZED ({TABLES[name][1]})" for name in ordered)
    return f"WITH {ctes} {select}" if ctes else select
