import re

from changelens.functions import fixed
from changelens.operators import parse, scan
from changelens.params import ScanOptions, SecretPattern

H = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f0"
PLANTED = [
    "key AK" + "IA" + H[:16].upper(), f'aws_secret_access_key = "{H[:40]}"', "gh" + "p_" + H[:36], "gh" + "o_" + H[:36],
    f'github_token: "{H[:40]}"', "AI" + "za" + H[:35], "xo" + "xb-" + H[:24], f'api_key = "{H[:24]}"',
    f'apikey: "{H[:24]}"', f'secret_token = "{H[:24]}"', f"access_token = '{H[:24]}", f'JWT-Secret: "{H[:24]}"',
    f"redis://u:{H[:12]}@db.internal/x", 'database_url = "jdbc:thing"', 'password = "hunter2hunter2"',
    "passwd: 'hunter2hunter2'", "-----BEGIN EC " + "PRIVATE KEY-----", f'private_key = "{H[:30]}"',
    f'encryption_key = "{H[:24]}"', "-----BEGIN " + "CERTIFICATE-----", "mail bob@corp.io", "host 52.1.7.9",
    f'credential: "{H[:20]}"',
]


def texts(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, path string, text string")


def found(df, *columns):
    rows = df.orderBy("id", "line_ord", "pattern_idx", "match_idx").collect()
    return [tuple(r[c] for c in columns) for r in rows]


def test_every_pattern_is_found(spark):
    df = texts(spark, *[("src/a.ts", line) for line in PLANTED])
    got = found(scan.scan_content(df, ["id"]), "id", "pattern_idx")
    for n in range(len(fixed.SECRET_PATTERNS)):
        assert (n, n) in got


def brute_force(text):
    """Line by line with the standard library's pattern engine."""
    out = []
    for i, line in enumerate(text.split("\n")):
        for n, (_, regex, _, _, _) in enumerate(fixed.SECRET_PATTERNS):
            for j, m in enumerate(re.finditer(regex, line, re.I | re.A)):
                if not any(re.search(p, m[0], re.I if ic else 0) for p, ic in fixed.FALSE_POSITIVES):
                    out.append((i + 1, m.start(), n, j, m[0]))
    return out


def test_same_as_brute_force_with_columns(spark):
    text = "\n".join(
        ["", *PLANTED, "  two a1@x.io, b2@y.io and 8.8.4.4 8.8.8.8", "é1.2.3.4 é bob@corp.io", "token=\t'" + H[:20] + "'",
         "'token = ", f"'{H[:20]}'", *[" ".join(f"u{i}@h{i}.io" for i in range(300))]]
    )
    df = texts(spark, ("src/a.ts", text))
    got = found(scan.scan_content(df, ["id"]), "line", "column", "pattern_idx", "match_idx", "content")
    want = brute_force(text)
    # match_idx counts matches before false positives are dropped, as does the other side.
    assert got == want
    lines = text.split("\n")
    assert all(lines[line - 1][col : col + len(value)] == value for line, col, _, _, value in got)


def test_false_positives_look_at_the_whole_match(spark):
    df = texts(
        spark, ("a.ts", 'password = "mytestvalue"'), ("a.ts", 'test password = "hunter2hunter2"'),
        ("a.ts", "u@example.com"), ("a.ts", "10.1.2.3 127.0.0.1 8.8.4.4"), ("a.ts", 'password = "${HOME}x12"'),
    )
    assert found(scan.scan_content(df, ["id"]), "id", "content") == [(1, 'password = "hunter2hunter2"'), (3, "8.8.4.4")]


def test_path_rules_and_custom_patterns(spark):
    line = f'a@corp.io 8.8.4.4 api_key = "{H[:24]}"'
    df = texts(spark, *[(p, line) for p in ("x.ts", "x.md", "spec/x.ts", "dist/x.ts", "LICENSE")])
    assert found(scan.scan_content(df, ["id"]), "id", "type") == [
        (0, "API_KEY"), (0, "EMAIL_IN_CODE"), (0, "IP_ADDRESS"), (1, "API_KEY"),
        (2, "API_KEY"), (2, "EMAIL_IN_CODE"), (4, "API_KEY"), (4, "IP_ADDRESS"),
    ]
    own = SecretPattern("HOST", r"corp\.IO", "HIGH", 0.5, exclude_files=("x",))
    options = ScanOptions(custom_patterns=(own,), min_severity="HIGH", exclude_types=("API_KEY",))
    assert found(scan.scan_content(df, ["id"], options), "id", "type") == [(i, "HOST") for i in range(5)]


def test_empty_selection_finds_nothing(spark):
    kinds = tuple({p[0] for p in fixed.SECRET_PATTERNS})
    df = texts(spark, ("a.ts", PLANTED[0]))
    assert scan.scan_content(df, ["id"], ScanOptions(exclude_types=kinds)).count() == 0


def test_limit_comes_before_the_severity_sort(spark):
    df = texts(spark, ("a.ts", "a@corp.io\nb@corp.io\n" + PLANTED[14]))
    assert found(scan.scan_content(df, ["id"], ScanOptions(max_findings=2)), "type") == [("EMAIL_IN_CODE",)] * 2
    assert len(found(scan.scan_content(df, ["id"], ScanOptions(max_findings=0)), "type")) == 3


def test_content_context_keeps_empty_lines(spark):
    df = texts(spark, ("a.ts", "one\n\na@corp.io\n\nlast"))
    options = ScanOptions(include_context=True)
    assert found(scan.scan_content(df, ["id"], options), "context_before", "context_after") == [
        (["one", ""], ["", "last"])]
    narrow = ScanOptions(include_context=True, context_lines=1)
    assert found(scan.scan_content(df, ["id"], narrow), "context_before", "context_after") == [([""], [""])]


def test_diff_context_jumps_over_hunks_and_binary_files_are_skipped(parse_text):
    text = (
        "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -1 +1,3 @@\n+one\n c\n+two\n@@ -9 +9,2 @@\n-a@corp.io\n"
        "+b@corp.io\n+end\ndiff --git a/y.ts b/y.ts\n+++ b/y.ts\n@@ -1 +1 @@\n+c@corp.io\nBinary files a and b differ"
    )
    [row] = scan.scan_diff(parse_text(text), ScanOptions(include_context=True)).collect()
    assert (row.line, row.line_ord, row.content) == (9, 2, "b@corp.io")
    assert (row.context_before, row.context_after) == (["one", "two"], ["end"])


def test_summary_has_zero_rows_and_first_seen_order(spark, parse_text):
    one = "diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +1,9 @@\n"
    some = one.format(p="x.ts") + "+a@corp.io\n+8.8.4.4\n+" + PLANTED[14] + "\n+" + PLANTED[6]
    files = parse_text(some, one.format(p="y.ts") + "+clean")
    totals = spark.createDataFrame([(0, 1), (1, 1)], "change_id bigint, total_files bigint")
    summary = scan.scan_summary(totals, scan.scan_diff(files)).selectExpr("*", "map_keys(by_type) AS kinds")
    rows = summary.orderBy("change_id").collect()
    assert rows[0].by_type == {"PASSWORD": 1, "SLACK_TOKEN": 1, "EMAIL_IN_CODE": 1, "IP_ADDRESS": 1}
    assert rows[0].kinds == ["PASSWORD", "SLACK_TOKEN", "EMAIL_IN_CODE", "IP_ADDRESS"]
    assert (rows[0].n_critical, rows[0].n_findings, rows[0].has_critical_issues) == (1, 4, True)
    assert (rows[1].n_findings, rows[1].has_critical_issues, rows[1].by_type) == (0, False, {})


def test_pattern_table_filters(spark):
    table = scan.pattern_table(spark)
    assert table.count() == 23
    assert scan.by_severity(table, "MEDIUM").count() == 2
    assert scan.by_type(table, "GITHUB_TOKEN").count() == 3
    assert scan.critical_patterns(table).count() == 19
    assert scan.high_confidence(table).where("confidence < 0.8").count() == 0


def test_required_literals_are_required():
    """No line may match a pattern without one of its literals."""
    for p in scan.BUILT_IN:
        for line in PLANTED:
            if p.any_literal and re.search(p.regex, line, re.I):
                assert any(lit in line.lower() for lit in p.any_literal)


def test_added_lines_only(parse_text):
    text = "diff --git a/x.ts b/x.ts\n+++ b/x.ts\n@@ -1 +1 @@\n a@corp.io\n-b@corp.io\n+c@corp.io"
    assert [r.content for r in scan.scan_diff(parse_text(text)).collect()] == ["c@corp.io"]
    assert [r.content for r in parse.added_lines(parse_text(text)).collect()] == ["c@corp.io"]
    assert [r.content for r in parse.deleted_lines(parse_text(text)).collect()] == ["b@corp.io"]


def test_patterns_for_files(spark):
    own = (SecretPattern("A", "x", "LOW", 0.1, include_files=(r"\.py$",)),
           SecretPattern("B", "x", "LOW", 0.1, exclude_files=(r"^a",)))
    df = texts(spark, ("a.py", ""), ("b.ts", ""), ("dist/c.py", ""))
    rows = scan.patterns_for_files(df, ["id"], own).orderBy("id", "pattern_idx").collect()
    assert [(r.id, r.type) for r in rows] == [(0, "A"), (1, "B"), (2, "A"), (2, "B")]
    assert scan.active_patterns(df, ["id"]).select("id").distinct().count() == 2
