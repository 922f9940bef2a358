import pytest

from changelens.operators import report, risk, summary
from changelens.params import RiskParams, ScanOptions

FILE = (
    "change_id bigint, file_idx bigint, path string, old_path string, status string, language string, binary boolean,"
    " additions bigint, deletions bigint, n_hunks bigint,"
    " hunks array<struct<hunk_idx:bigint,old_start:bigint,old_lines:bigint,new_start:bigint,new_lines:bigint,"
    "header:string,changes:array<struct<change_idx:bigint,line_number:bigint,old_line_number:bigint,type:string,"
    "content:string>>>>, added array<struct<line_number:bigint,content:string>>"
)


def file_row(idx, path, status, additions, deletions, added=None, language=None, change_id=0):
    """A file with one hunk of added (line, text) pairs, or none."""
    hunks = []
    if added is not None:
        hunks = [(0, 1, 1, 1, 1, "@@ -1 +1 @@", [(i, n, None, "addition", t) for i, (n, t) in enumerate(added)])]
    return (change_id, idx, path, path, status, language, False, additions, deletions, len(hunks), hunks, added or [])


MOCK = [
    file_row(0, "src/index.ts", "modified", 45, 12,
             [(5, 'import { Tool } from "./tool-of-ours";'), (10, "const tool = new Tool();")], "typescript"),
    file_row(1, "src/config.ts", "added", 30, 0, [(5, 'const API_KEY = "sk-' + '1234567890abcdef";')], "typescript"),
    file_row(2, "package.json", "modified", 3, 1),
]


def assessed(spark, rows, params=RiskParams()):
    facts = summary.file_facts(spark.createDataFrame(rows, FILE))
    return facts, risk.assess(facts, params)


def test_mock_change_set(spark):
    facts, assessment = assessed(spark, MOCK)
    complexities = [round(r.complexity, 2) for r in facts.orderBy("file_idx").collect()]
    assert complexities == [2.14, 1.6, 0.08]
    [a] = assessment.collect()
    assert a.n_findings == 0
    assert (a.n_added, a.n_modified, a.n_critical_files, a.n_config_files) == (1, 2, 3, 1)
    assert a.complexity_score == pytest.approx(3.82)
    assert a.size_score == pytest.approx(19.65)
    assert a.critical_score == 95 and a.categories == ["core", "configuration"]
    assert a.overall_score == pytest.approx(18.3435) and a.overall_risk == "LOW"
    assert [r.text for r in a.recommendations] == [
        "🔍 Extra review needed - changes affect core functionality",
        "Ensure comprehensive test coverage for critical changes",
        "✅ Low risk - standard review process applies",
        "Add integration tests for changed components",
    ]
    assert a.critical_issues == []
    [gate] = risk.merge_gate(assessment).collect()
    assert gate.safe and gate.reason is None
    [s] = risk.risk_summary(assessment).collect()
    assert (s.level, s.score, s.estimated_review_time) == ("LOW", 18, "30-60 minutes")
    assert s.concerns == ["criticalFiles: 3 critical file(s) affected"]
    [c] = report.compact(assessment).collect()
    assert c.compact_text == "**Risk:** LOW (18/100)\n**Changes:** 3 files, +78 -13"
    fixes = [r.quick_fix for r in risk.quick_fixes(assessment, facts).collect()]
    assert fixes == ["Add integration tests for changed components"]


@pytest.mark.parametrize(
    "n_files, lines, score, large",
    [(1, 1, 2.15, False), (9, 199, 47.85, False), (10, 200, 50, False), (19, 499, 50, False), (20, 10, 41.5, True),
     (1, 500, 62, True), (25, 900, 100, True)],
)
def test_size_bands(spark, n_files, lines, score, large):
    rows = [file_row(i, f"a/f{i}", "modified", lines if i == 0 else 0, 0) for i in range(n_files)]
    [a] = assessed(spark, rows)[1].collect()
    assert a.size_score == pytest.approx(score) and a.is_too_large is large


@pytest.mark.parametrize("n", range(1, 12))
def test_critical_points(spark, n):
    rows = [file_row(i, f"lib/f{i}", "modified", 1, 0) for i in range(n)]
    [a] = assessed(spark, rows)[1].collect()
    assert a.critical_score == min(100, sum(max(5, 30 - 5 * i) for i in range(n)))


def test_complex_files_and_split_by_type(spark):
    deep = [(i, " " * 40 + "x") for i in range(9)]
    rows = [file_row(i, f"pkg/Add{i}.e{i}", "modified", 400, 100, deep) for i in range(5)]
    facts, assessment = assessed(spark, rows)
    [a] = assessment.collect()
    assert (a.n_complex, a.max_complexity, a.complexity_score) == (5, 30.0, 100.0)
    recs = joined(risk.recommendations(assessment, facts), "rec_idx", "recommendation")
    split = "Split by type: " + ", ".join(f".e{i} (1 files)" for i in range(5))
    assert list(map(recs.get, sorted(recs)))[:5] == [
        "Consider refactoring high complexity functions",
        "Review these files: pkg/Add0.e0, pkg/Add1.e1, pkg/Add2.e2",
        "Add unit tests for complex logic",
        "📦 Consider splitting this PR into smaller, focused changes",
        "Suggested splits: " + split,
    ]
    details = {
        (f, k): text
        for f in range(4)
        for k, text in joined(risk.risk_details(assessment, facts).where(f"factor_idx = {f}"), "detail_idx", "detail").items()
    }
    assert details[1, 1] == "High complexity files: " + ", ".join(f"pkg/Add{i}.e{i}" for i in range(5))
    assert details[2, 2] == split
    lines = list(joined(report.complete(assessment, facts).where("section_idx = 1"), "line_idx", "line").values())
    assert "    - High complexity files: " + ", ".join(f"pkg/Add{i}.e{i}" for i in range(5)) in lines
    assert "- Suggested splits: " + split in lines


def test_one_group_gives_no_split(spark):
    facts, assessment = assessed(spark, [file_row(0, "a/x.py", "modified", 600, 0)])
    assert summary.split_suggestions(facts).count() == 0
    assert not [r for r in risk.recommendations(assessment, facts).collect() if "split" in r.recommendation.lower()[:9]]


def test_weights_and_thresholds_are_parameters(spark):
    params = RiskParams({"security": 0, "complexity": 0, "changeSize": 0, "criticalFiles": 1}, high=95, medium=10)
    _, assessment = assessed(spark, MOCK, params)
    [a] = assessment.collect()
    assert (a.overall_score, a.overall_risk) == (95, "HIGH")
    assert [f.weight for f in a.factors] == [0, 0, 0, 1]
    [gate] = risk.merge_gate(assessment).collect()
    assert gate.reason == "Risk score too high - requires significant changes"


def test_renamed_files_have_their_own_list(spark):
    row = list(file_row(0, "b", "renamed", 1, 0))
    row[3] = "a"
    [r] = summary.path_lists(summary.file_facts(spark.createDataFrame([tuple(row)], FILE))).collect()
    assert (r.list, r.old_path, r.path) == ("renamed", "a", "b")


def test_time_of_assessment(spark):
    assert risk.timestamped(assessed(spark, MOCK)[1]).collect()[0].assessed_at is not None


def test_a_limit_on_findings_limits_what_counts(spark):
    lines = [(1, "a@corp.io"), (2, "password = 'hunter2hunter2'"), (3, "passwd = 'hunter2hunter2'")]
    facts = summary.file_facts(spark.createDataFrame([file_row(0, "a.py", "modified", 3, 0, lines)], FILE))
    [a] = risk.assess(facts, options=ScanOptions(max_findings=2)).collect()
    assert (a.n_findings, a.n_critical, a.n_low, a.n_high) == (2, 1, 1, 0)
    assert risk.assess(facts).collect()[0].n_critical == 2


def joined(rows, key, text):
    """Texts by key, the entries of a list after its heading."""
    out = {}
    for r in rows.orderBy(key, "entry_no").collect():
        if r.entry_no == 0:
            out[r[key]] = r[text]
        else:
            out[r[key]] += ("" if out[r[key]].endswith(": ") else ", ") + r[text]
    return out


def test_breakdown_has_every_detail(spark):
    facts, assessment = assessed(spark, MOCK)
    rows = risk.breakdown(assessment, facts).orderBy("factor_idx", "line_no", "entry_no").collect()
    by_factor = {f: [r.line for r in rows if r.factor_idx == f] for f in range(4)}
    for f, lines in by_factor.items():
        assert lines[0].startswith("### ") and lines[1] == "Details:" and len(lines) > 2
        assert all(line.startswith("  - ") for line in lines[2:])
    [a] = assessment.collect()
    assert by_factor[2][2:4] == [f"  - {a.total_files} files changed", f"  - +{a.total_additions} -{a.total_deletions} lines"]
