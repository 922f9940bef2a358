"""Diffs, source files and generated answers derived from the ``documents`` table.

All steps are row-local, so the fixtures grow with the table.  A change set is
1 to 27 consecutive documents; each document is one part of its diff.  The SQL
is kept as text so that a checking engine can derive the same inputs; the few
spellings that differ are in ``Dialect``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from changelens.functions.rows import FILES_PER_PART
from changelens.sources.tables import read_table


@dataclass(frozen=True)
class Dialect:
    int_div: str
    lines: str
    first: str
    marked: str  # lines {a} to {b} with a mark in front, joined; null when there are none


SPARK = Dialect(
    int_div="div",
    lines="split(text, '\\n', -1)",
    first="l[0]",
    marked=(
        "nullif(array_join(transform(slice(l, cast({a} as int), cast({b} - {a} + 1 as int)),"
        " x -> concat('{mark}', x)), chr(10)), '')"
    ),
)

_PATHS = [
    "concat('src/auth/doc_', doc_id, '.ts')",
    "concat('docs/doc_', doc_id, '.md')",
    "concat(CASE WHEN doc_id % 400 = 202 THEN 'app/tests' ELSE 'test' END, '/doc_', doc_id, '.py')",
    "concat('pkg_', doc_id, '/package.json')",
    "concat('dist/doc_', doc_id, '.js')",
    "CASE WHEN doc_id % 16 = 5 THEN concat('deploy_', doc_id, '/.env') ELSE concat('config/app_', doc_id, '.yml') END",
    "concat('lib/doc_', doc_id, '.test.js')",
    "concat('Makefile_', doc_id)",
]

# One planted line per secret pattern; prefixes are put together from two pieces
# so that nothing in this file looks like a key.
_PLANTED = [
    "concat('key AK', 'IA', substr(H, 1, 16))",
    "concat('aws_secret_access_key = \"', h, substr(h, 1, 8), '\"')",
    "concat('gh', 'p_', h, substr(h, 1, 4))",
    "concat('gh', 'o_', h, substr(h, 1, 4))",
    "concat('github_token: \"', h, substr(h, 1, 8), '\"')",
    "concat('AI', 'za', h, substr(h, 1, 3))",
    "concat('xo', 'xb-', substr(h, 1, 24))",
    "concat('api_key = \"', substr(h, 1, 24), '\"')",
    "concat('apikey: \"', substr(h, 1, 24), '\"')",
    "concat('secret_token = \"', substr(h, 1, 24), '\"')",
    "concat('access_token = \"', substr(h, 1, 24), '\"')",
    "concat('jwt_secret = \"', substr(h, 1, 24), '\"')",
    "concat('postgres://u:', substr(h, 1, 12), '@db.internal/x')",
    "concat('database_url = \"jdbc:', substr(h, 1, 10), '\"')",
    "concat('password = \"', substr(h, 1, 12), '\"')",
    "concat('passwd: \"', substr(h, 1, 12), '\"')",
    "concat('-----BEGIN RSA ', 'PRIVATE KEY-----')",
    "concat('private_key = \"', h, '\"')",
    "concat('encryption_key = \"', substr(h, 1, 24), '\"')",
    "concat('-----BEGIN ', 'CERTIFICATE-----')",
    "concat('mail a', substr(h, 1, 5), '@corp.io')",
    "concat('host 52.', doc_id % 200, '.7.9')",
    "concat('credential: \"', substr(h, 1, 20), '\"')",
]


def pick(cases: list[str], selector: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    return f"CASE {selector} {whens} END"


def scan_files_sql(d: Dialect) -> list[str]:
    """Columns over ``documents``: doc_id, source, change_id, part_idx, path, text."""
    block = "cast(floor(sqrt(doc_id % 200)) as bigint)"
    notes = "CASE WHEN doc_id % 13 = 0 THEN concat(chr(10), '-- sql note', chr(10), '++ plus note') ELSE '' END"
    # whole change sets of deep code, and some whose documents plant nothing
    deep = "CASE WHEN doc_id % 200 >= 169 THEN concat(" + ", ".join(
        f"chr(10), repeat(' ', 24), 'deep{i}()'" for i in range(4)
    ) + ") ELSE '' END"
    quiet = "doc_id % 200 BETWEEN 4 AND 8 OR doc_id % 600 BETWEEN 396 AND 399 OR doc_id % 600 BETWEEN 596 AND 599"
    # small change sets of high risk that have no critical issue; of two, one is large and deep too
    certificates = f"repeat(concat(chr(10), {_PLANTED[19]}), 30)"
    steps = "repeat(concat(chr(10), repeat(' ', 24), 'step()'), 20)"
    long = f"concat(repeat(concat(chr(10), 'row'), 600), {certificates})"
    warned = f"CASE doc_id % 600 WHEN 399 THEN {certificates} WHEN 597 THEN {steps} WHEN 598 THEN {steps} WHEN 599 THEN {long} ELSE '' END"
    planted = f"CASE WHEN {quiet} THEN 'nothing' ELSE {pick(_PLANTED, 'doc_id % 23')} END"
    planted = planted.replace("H,", "upper(md5(cast(doc_id as string))),")
    planted = planted.replace("h,", "md5(cast(doc_id as string)),")
    return [
        "doc_id",
        "source",
        f"(doc_id {d.int_div} 200) * 15 + {block} AS change_id",
        f"doc_id % 200 - {block} * {block} AS part_idx",
        f"{pick(_PATHS, 'doc_id % 8')} AS path",
        f"concat(text, chr(10), repeat(' ', cast(doc_id % 9 as int)), {planted}, {warned}, {deep}, {notes}) AS text",
    ]


# A second file for every fourth document: code, so that names and snippets occur.
_CODE_PATH = pick(
    [
        "concat('src/api/handler_', doc_id, '.ts')",
        "concat('app/model_', doc_id, '.py')",
        "concat('cmd/main_', doc_id, '.go')",
    ],
    "doc_id % 3",
)
_CODE_FILE = [
    f"concat('diff --git a/', {_CODE_PATH}, ' b/', {_CODE_PATH})",
    "'index 11..22 100644'",
    f"concat('--- a/', {_CODE_PATH})",
    f"concat('+++ b/', {_CODE_PATH})",
    "'@@ -5,3 +5,11 @@ class Base'",
    "concat(' import base', doc_id)",
    "'-old line'",
    "concat('+function load', doc_id, '(a, b) {')",
    "concat('+  const run', doc_id, ' = async (x) => {')",
    "'+    return x;'",
    "'+  };'",
    "'+}'",
    "concat('+def parse_', doc_id, '(s): public int size', doc_id, '(')",
    "concat('+func Serve', doc_id, '(w) {}')",
    "' tail'",
    "concat('+fn finish_', doc_id, '() {}')",
    "concat('+', chr(9), 'function load', doc_id, '(again) {}')",
]
_BINARY_FILE = [
    "concat('diff --git a/img_', doc_id, '.png b/img_', doc_id, '.png')",
    "concat('Binary files a/img_', doc_id, '.png and b/img_', doc_id, '.png differ')",
]

# A binary file that has a hunk all the same, and a file with a malformed hunk line.
_BINARY_HUNK = [
    "concat('diff --git a/blob_', doc_id, '.ts b/blob_', doc_id, '.ts')",
    "concat('--- a/blob_', doc_id, '.ts')",
    "concat('+++ b/blob_', doc_id, '.ts')",
    "concat('Binary files a/blob_', doc_id, '.ts and b/blob_', doc_id, '.ts differ')",
    "'@@ -1,1 +1,2 @@'",
    "'-old'",
    "concat('+password = \"', md5(cast(doc_id as string)), '\"')",
]
_MALFORMED = [
    "concat('diff --git a/odd_', doc_id, '.py b/odd_', doc_id, '.py')",
    "concat('--- a/odd_', doc_id, '.py')",
    "concat('+++ b/odd_', doc_id, '.py')",
    "'@@ -1,1 +1,2 @@'",
    "'-old'",
    "'@@ malformed @@'",
    "concat('+after', doc_id)",
]


def lines_sql(d: Dialect) -> list[str]:
    """Columns over scan files: their keys, ``l`` (lines), ``n`` and ``k``."""
    count = f"len({d.lines})" if d.int_div == "//" else f"size({d.lines})"
    return ["doc_id", "change_id", "part_idx", "path", f"{d.lines} AS l", f"{count} AS n",
            f"1 + ({count} - 1) {d.int_div} 2 AS k"]


def chunk_sql(d: Dialect) -> list[str]:
    """Columns over the lines: change_id, part_idx, doc_id, chunk (a diff of one or more files)."""

    def marked(mark: str, a: str, b: str) -> str:
        return d.marked.format(mark=mark, a=a, b=b)

    def joined(*parts: str) -> str:
        return f"concat_ws(chr(10), {', '.join(parts)})"

    head = "concat('diff --git a/', path, ' b/', path)"
    old, new = "concat('--- a/', path)", "concat('+++ b/', path)"
    added = joined(head, "'new file mode 100644'", "'--- /dev/null'", new, "concat('@@ -0,0 +1,', n, ' @@')",
                   marked("+", "1", "n"))
    deleted = joined(head, old, "'+++ /dev/null'", "concat('@@ -1,', n, ' +0,0 @@')", marked("-", "1", "n"))
    modified = [head, old, new, "concat('@@ -1,', k, ' +1,', 1 + n - k, ' @@')", f"concat(' ', {d.first})",
                marked("-", "2", "k"), marked("+", "(k + 1)", "n")]
    second = ["concat('@@ -', n + 10, ' +', n + 10, ',2 @@ fn')", "' tail'", "'+    more'"]
    chunk = pick([added, deleted, joined(*modified), joined(*modified), joined(*modified, *second)], "doc_id % 5")
    # one document without a code file leaves its change set nothing to test
    code = f"CASE WHEN doc_id % 4 = 1 AND doc_id % 400 <> 201 THEN {joined(*_CODE_FILE)} END"
    binary = f"CASE WHEN doc_id % 11 = 0 THEN {joined(*_BINARY_FILE)} END"
    blob = f"CASE WHEN doc_id % 33 = 5 THEN {joined(*_BINARY_HUNK)} END"
    odd = f"CASE WHEN doc_id % 29 = 6 THEN {joined(*_MALFORMED)} END"
    return ["change_id", "part_idx", "doc_id", f"{joined(chunk, code, binary, blob, odd)} AS chunk"]


# Text per source kind over the chunks; blank ones vary in form.
_BLANK = "CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('  ', chr(10)) END"
SOURCE_TEXTS = {
    "staged": f"CASE WHEN change_id % 3 = 0 THEN chunk ELSE {_BLANK} END",
    "worktree": f"CASE WHEN change_id % 3 = 2 THEN {_BLANK} ELSE chunk END",
    "branch": "chunk",
}


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, change_id, part_idx, path, text``: documents as source files."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    return docs.selectExpr(*scan_files_sql(SPARK))


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one part of a change set's diff, from three sources."""
    lines = scan_files(spark, folder).selectExpr(*lines_sql(SPARK))
    chunks = lines.selectExpr(*chunk_sql(SPARK))
    kinds = ", ".join(f"'{kind}', {text}" for kind, text in SOURCE_TEXTS.items())
    return chunks.selectExpr(
        "change_id",
        "part_idx",
        "'main' AS base_branch",
        f"stack(3, {kinds}) AS (source_kind, diff_text)",
    ).select("change_id", "part_idx", "source_kind", "base_branch", "diff_text")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """The full diffs alone: ``change_id, part_idx, base_branch, diff_text``."""
    lines = scan_files(spark, folder).selectExpr(*lines_sql(SPARK))
    chunks = lines.selectExpr(*chunk_sql(SPARK))
    return chunks.selectExpr("change_id", "part_idx", "'main' AS base_branch", "chunk AS diff_text")


def hunk_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same cut at hunk heads: ``change_id, part_idx, base_branch, diff_text``,
    some thousand numbers to a document."""
    cuts = "posexplode(split(diff_text, '(?m)^(?=@@ )', -1)) AS (cut, piece)"
    pieces = parts(spark, folder).selectExpr("change_id", "part_idx", "base_branch", cuts)
    return pieces.selectExpr("change_id", "part_idx * 1000 + cut AS part_idx", "base_branch", "piece AS diff_text")


# --- generated answers ------------------------------------------------------------------

# Control characters but the line end.
_CONTROLS = f"concat({', '.join(f'chr({i})' for i in range(1, 32) if i != 10)})"


def _json_text(text: str) -> str:
    """A text as it stands in a JSON string; control characters become spaces."""
    escaped = f"translate({text}, {_CONTROLS}, repeat(' ', 30))"
    for plain, written in (("chr(92)", "chr(92)"), ("'\"'", "'\"'"), ("chr(10)", "'n'")):
        escaped = f"replace({escaped}, {plain}, concat(chr(92), {written}))"
    return escaped


# Answer texts by kind; a text is put into JSON as it stands, so line ends are
# written as the two characters of their JSON escape.  The last of each kind is
# made of a document's own text.
_TITLES = [
    "concat('feat(auth): add login flow ', change_id)",
    "concat('fix: handle empty rows in batch ', change_id)",
    "concat(chr(92), '\"chore(ci): rebuild image ', change_id, '...', chr(92), '\"')",
    "concat('feat(reports): ', repeat('very ', 14), 'long title ', change_id)",
    "'fix: x'",
    "concat('  Improve the pipeline a lot ', change_id, '! ')",
    _json_text("split_part(text, chr(10), 1)"),
]
_N = "', chr(92), 'n"
_DESCRIPTIONS = [
    f"concat('## What Changed{_N}- Added table ', change_id, '{_N}{_N}## Why{_N}- Needed rows{_N}{_N}"
    f"## Impact{_N}- None so far')",
    f"concat('Intro{_N}## what changed{_N}- Reworked ', change_id, '{_N}## Impact{_N}{_N}  - Faster  {_N}')",
    f"concat('## What Changed{_N}- Dropped field{_N}## Why{_N}cleanup{_N}## Impact{_N}"
    f"Breaking change: clients of ', change_id, ' must update{_N}Breaking changes:{_N}- second one')",
    f"concat('Plain words only about ', change_id, '{_N}and a second line')",
    f"concat('## What Changed{_N}', {_json_text('text')}, '{_N}## Why{_N}Texts of ', change_id)",
]
_TESTS = [
    f"concat('Here:{_N}```typescript{_N}it(', chr(39), 'should load ', doc_id, chr(39), ', run){_N}```{_N}"
    f"```js{_N}// api integration{_N}call(){_N}```')",
    f"concat('describe(', chr(39), 'a', chr(39), ', () => {{{_N}  it(', chr(39), 'given rows ', doc_id, chr(39),"
    f" ', f){_N}}}){_N}describe(', chr(39), 'b', chr(39), ', () => browser())')",
    f"concat('Check totals for ', doc_id, '{_N}with zero rows{_N}{_N}When the database is down{_N}{_N} {_N}')",
    "'   '",
    _json_text("text"),
]


def _answer_sql(text: str, n: str) -> str:
    """An answer in JSON; some calls give no result, some no token counts."""
    counts = f"CASE WHEN {n} % 7 = 3 THEN '' ELSE concat(',\"generated_token_count\":', {n} % 50 + 1, ',\"input_token_count\":', {n} % 900 + 10) END"
    result = f"concat('{{\"generated_text\":\"', {text}, '\"', {counts}, ',\"stop_reason\":\"eos\"}}')"
    some = f"CASE WHEN {n} % 10 = 9 THEN '' ELSE {result} END"
    return f"concat('{{\"model_id\":\"m-1\",\"results\":[', {some}, '],\"created_at\":\"2024-01-01\"}}')"


def responses_sql() -> list[tuple[list[str], str]]:
    """Columns and filter over the scan files, for each kind of answer.

    Titles and descriptions: one per change set, made from its first document.
    Tests: one per file that a document's part may hold.
    """

    def columns(kind: str, cases: list[str], selector: str, n: str, file_idx: str) -> list[str]:
        return ["change_id", f"'{kind}' AS kind", f"{file_idx} AS file_idx",
                f"{_answer_sql(pick(cases, selector), n)} AS raw", f"{n} % 1000 + 5 AS duration_ms"]

    none, first = "cast(null as bigint)", f"part_idx * {FILES_PER_PART}"
    return [
        (columns("title", _TITLES, "change_id % 13 % 7", "change_id", none), "part_idx = 0"),
        (columns("description", _DESCRIPTIONS, "change_id % 11 % 5", "change_id", none), "part_idx = 0"),
        (columns("tests", _TESTS, "doc_id % 9 % 5", "doc_id", first), "true"),
        (columns("tests", _TESTS, "((doc_id % 16) - (doc_id % 4)) % 7 % 4", "doc_id", f"{first} + 1"), "doc_id % 4 = 1"),
    ]


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """``change_id, kind, file_idx, raw, duration_ms``: answers to the prompts."""
    files = scan_files(spark, folder).select("change_id", "part_idx", "doc_id", "text")
    rows = [files.where(condition).selectExpr(*columns) for columns, condition in responses_sql()]
    return reduce(DataFrame.unionByName, rows)
