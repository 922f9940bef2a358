import json

from changelens.operators import answers, prompts, summary
from changelens.operators.parse import parse_files

CODE = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,3 +1,9 @@
 c
+function one() {
+const two = async (x) => { function one()
+3
+4
+5
+
@@ -40 +50,2 @@
+def three(): func four() fn five
 d
+8
-e
+9
+10"""


def context(parse_text, text):
    [row] = prompts.test_contexts(parse_text(text)).collect()
    return row


def test_functions_and_snippets(parse_text):
    row = context(parse_text, CODE)
    assert row.functions == ["one", "two", "three", "four", "five"]
    # The second run goes on over the hunk boundary.
    assert row.snippets == [
        "function one() {\nconst two = async (x) => { function one()\n3\n4\n5",
        "\ndef three(): func four() fn five",
        "8",
    ]
    assert row.test_language == "typescript"


def test_snippets_end_exactly(parse_text):
    head = "diff --git a/a.py b/a.py\n+++ b/a.py\n@@ -1 +1 @@\n"
    assert context(parse_text, head + "+a\n+").snippets == ["a\n"]
    assert context(parse_text, head + "+\n+\n").snippets == ["\n"]
    assert context(parse_text, head + "-a").snippets == []


def test_testable_files(parse_text):
    one = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n+x\n"
    names = ["test/x.py", "a/test/x.py", "x.test.js", "a.config.ts", "p.json", "x.md", "b.go", "__tests__x.ts", "q.tsx"]
    gone = "diff --git a/g.py b/g.py\n--- a/g.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    rows = prompts.test_contexts(parse_text("".join(map(one.format, names)) + gone)).orderBy("file_idx").collect()
    assert [r.path for r in rows] == ["test/x.py", "b.go", "q.tsx"]


def test_file_choice_orders(parse_text):
    one = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n"
    text = "".join(one.format(f"f{i}.py") + "+x\n" * (i % 4 + 1) for i in range(8))
    contexts = prompts.test_contexts(parse_text(text))

    def paths(*args, **kwargs):
        return [r.path for r in prompts.test_files(contexts, *args, **kwargs).orderBy("file_rank").collect()]

    assert paths() == ["f3.py", "f7.py", "f2.py", "f6.py", "f1.py"]
    assert paths(0, order="input") == [f"f{i}.py" for i in range(5)]
    assert paths(2, order="input") == ["f0.py", "f1.py"]


def test_zero_prints_as_nothing(parse_text):
    facts = summary.file_facts(parse_text("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n c"))
    profile = summary.profile(facts)
    [title] = prompts.assemble(prompts.title_prompts(facts, profile)).collect()
    assert "\n\nFiles changed: x\nTotal additions: \nTotal deletions: \nLanguages: \nMain changes: Modified 1 file(s)\n\n" in (
        title.prompt)
    [description] = prompts.assemble(prompts.description_prompts(facts, profile)).collect()
    assert "## Detected Patterns:\nGeneral code changes\n\n\n\nRequirements:" in description.prompt
    assert "Security Issues" not in description.prompt


def test_description_prompt(parse_text):
    text = (
        "diff --git a/a.md b/a.md\n--- a/a.md\n+++ b/a.md\n@@ -1 +1 @@\n+password = 'hunter2hunter2'\n"
        "diff --git a/b.md b/b.md\n--- a/b.md\n+++ b/b.md\n@@ -1 +1 @@\n+x\n-y"
    )
    facts = summary.file_facts(parse_text(text))
    [row] = prompts.assemble(prompts.description_prompts(facts, summary.profile(facts))).collect()
    assert row.prompt.startswith(
        "Generate a pull request description for the following changes:\n\n## Changed Files:\n"
        "- a.md (modified): +1 -0\n- b.md (modified): +1 -1\n\n## Key Changes:\n"
        "File: b.md\nmodified: +1 -1 (2 lines changed)\n\nFile: a.md\nmodified: +1 -0 (1 lines changed)\n\n"
        "## Detected Patterns:\nDocumentation updates\n\n\n## Security Issues Found:\n"
        "⚠️ 1 CRITICAL security issue(s) found\n- Issue types: PASSWORD: 1\n\n\nRequirements:"
    )


def responses(spark, *answers_, kind="title"):
    rows = [(i, kind, 0, a if a is None or a.startswith("{") else json.dumps(
        {"model_id": "m", "results": [{"generated_text": a, "generated_token_count": 2}]})) for i, a in enumerate(answers_)]
    return answers.parse_responses(
        spark.createDataFrame(rows, "change_id bigint, kind string, file_idx bigint, raw string")
    )


def test_invalid_answers(spark):
    parsed = responses(spark, "x", "", '{"results": []}', "{broken", None, "  \n")
    rows = parsed.orderBy("change_id").collect()
    assert [r.status for r in rows] == ["ok", "no text", "no results", "no results", "no results", "ok"]
    assert (rows[0].text, rows[0].tokens_input, rows[0].tokens_total, rows[5].text) == ("x", 0, 2, "")
    [stats] = answers.call_stats(parsed).collect()
    assert (stats.total_requests, stats.successful_requests, stats.failed_requests) == (6, 2, 4)
    assert answers.call_stats(parsed.where("false")).collect()[0].success_rate == 0


def test_titles(spark):
    said = ["\"feat(a): do it now.\"", "fix: x!?", "Some words without form", "feat(a)(b): nested scope",
            "docs: " + "é" * 70, "feat: 😀😀", "'docs: only one quote", "revert: not in the list"]
    rows = answers.titles(responses(spark, *said)).orderBy("change_id").collect()
    assert [(r.title, r.type, r.scope, r.is_conventional) for r in rows[:4]] == [
        ("feat(a): do it now", "feat", "a", True), ("fix: x", "fix", None, True),
        ("Some words without form", None, None, False), ("feat(a)(b): nested scope", None, None, False)]
    assert [len(r.errors) for r in rows] == [0, 1, 1, 0, 1, 0, 0, 1]
    assert rows[5].length == 10 and rows[6].title == "docs: only one quote"


def test_descriptions(spark):
    said = [
        "intro\n## What Changed\n- a\n\n##  why \n\nb\n### Impact\nc ## more\n",
        "## WHAT CHANGED\nBreaking changes:\n- one thing\nbreaking change: two things\n",
        "nothing special",
    ]
    rows = answers.descriptions(responses(spark, *said, kind="description")).orderBy("change_id").collect()
    assert (rows[0].what_changed, rows[0].why_changed, rows[0].impact) == ("- a", "b", "c")
    assert rows[1].breaking_changes == ["one thing", "two things"]
    assert rows[2].what_changed == "nothing special" and rows[2].breaking_changes == []


def test_suggestions(spark):
    said = [
        "```ts\nit('should add', f)\n```\n\ntext\n```\ncall the API\n```",
        "describe('a', () => { it(\"x y\") })\ndescribe('b', () => page.browser())",
        "First paragraph when empty\n\n \n\nSecond with database",
        "   ",
        '{"results": []}',
    ]
    parsed = responses(spark, *said, kind="tests")
    chosen = spark.createDataFrame(
        [(i, 0, 1, f"f{i}.go", "go" if i else None) for i in range(6)],
        "change_id bigint, file_idx bigint, file_rank bigint, path string, language string",
    )
    rows = answers.combine(answers.suggestions(chosen, parsed)).orderBy("change_id", "type", "number").collect()
    got = [(r.change_id, r.type, r.description, r.scenario, r.code_snippet, r.framework, r.priority) for r in rows]
    assert got == [
        (0, "integration", "Test case", "```", "call the API", "jest", 3),
        (0, "unit", "should add", "should add', f)\n```", "it('should add', f)", "jest", 5),
        (1, "e2e", "Test case", "describe('b', () => page.browser())", "describe('b', () => page.browser())", "testing", 2),
        (1, "unit", "x y", "describe('a', () => { it(\"x y\") })", "describe('a', () => { it(\"x y\") })", "testing", 5),
        (2, "integration", "Test case", "Second with database", "Second with database", "testing", 3),
        (2, "unit", "Test case", "when empty", "First paragraph when empty", "testing", 5),
        (3, "unit", "Test f3.go functionality", "Verify core functionality works as expected", None, "testing", 4),
        (3, "unit", "Test f3.go edge cases", "Handle edge cases and error conditions", None, "testing", 3),
    ]
    totals = {r.change_id: r.coverage_improvement for r in answers.suggestion_totals(
        answers.suggestions(chosen, parsed)).collect()}
    assert totals == {0: 8, 1: 7, 2: 8, 3: 10}
    plain = answers.suggestions(chosen, parsed, include_snippets=False)
    assert plain.where("code_snippet IS NOT NULL").count() == 0


def test_one_bad_answer_leaves_a_change_set_without_suggestions(spark):
    chosen = spark.createDataFrame(
        [(0, 0, 1, "a.py", "python"), (0, 1, 2, "b.py", "python")],
        "change_id bigint, file_idx bigint, file_rank bigint, path string, language string",
    )
    assert answers.suggestions(chosen, responses(spark, "some text", kind="tests")).count() == 0


def test_prompt_pieces_join_to_the_whole_prompt(spark):
    """One rule for a change set of one file and of many."""
    text = "diff --git a/f{0} b/f{0}\n--- a/f{0}\n+++ b/f{0}\n@@ -1 +1 @@\n+x"
    parts = [(0, i, text.format(i)) for i in range(3000)] + [(i, 0, text.format(i)) for i in range(1, 6)]
    diffs = spark.createDataFrame(parts, "change_id bigint, part_idx bigint, diff_text string").repartition(8)
    facts = summary.file_facts(parse_files(diffs))
    pieces = prompts.title_prompts(facts, summary.profile(facts))
    assert pieces.count() == 3005 + 2 * 6
    whole = {r.change_id: r.prompt for r in prompts.assemble(pieces).collect()}
    assert "Files changed: " + ", ".join(f"f{i}" for i in range(3000)) + "\nTotal additions: 3000\n" in whole[0]
    assert "Files changed: f3\nTotal additions: 1\n" in whole[3] and len(whole) == 6
    described = prompts.assemble(prompts.description_prompts(facts, summary.profile(facts)))
    assert "- f3 (modified): +1 -0\n" in described.where("change_id = 3").first().prompt + "\n"


def test_existing_patterns_come_into_the_test_prompt(spark):
    chosen = spark.createDataFrame(
        [(1, 0, "a.py", "python", ["f"], ["s"], ["uses pytest", "has fixtures"]), (2, 0, "b.py", "python", ["f"], ["s"], [])],
        "change_id bigint, file_idx bigint, path string, test_language string, functions array<string>,"
        " snippets array<string>, existing_patterns array<string>",
    )
    said = {r.change_id: r.prompt for r in prompts.test_prompts(chosen).collect()}
    assert "uses pytest\n- has fixtures" in said[1]
    without = {r.change_id: r.prompt for r in prompts.test_prompts(chosen.drop("existing_patterns")).collect()}
    assert without[1] == without[2].replace("b.py", "a.py") and said[2] == without[2]


def test_change_sets_without_testable_files_have_zero_totals(spark):
    chosen = spark.createDataFrame(
        [(0, 0, 1, "a.py", "python")],
        "change_id bigint, file_idx bigint, file_rank bigint, path string, language string",
    )
    suggested = answers.suggestions(chosen, responses(spark, "some text", kind="tests"))
    none = spark.createDataFrame([(7,), (7,)], "change_id bigint")
    rows = {r.change_id: tuple(r)[1:] for r in answers.suggestion_totals(suggested, none).collect()}
    assert rows == {0: (1, 1, 0, 0, 5), 7: (0, 0, 0, 0, 0)}
