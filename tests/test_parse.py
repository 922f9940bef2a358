import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from changelens.operators import filters, parse

DIFF = """preamble
diff --git a/x.py b/x.py
index 1..2
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@ def f
 ctx
-old
--- sql
+new
+++ plus

+  more
\\ No newline at end of file
@@ -10 +12,0 @@
 c
+z
@@@ bad
+tail
diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ
diff --git a/r1 b/r2
rename from r1
rename to r2
diff --git a/gone.md b/gone.md
--- a/gone.md
+++ /dev/null
@@ -1,2 +0,0 @@
-a
--- a/fake
-b
diff --git a/n.h b/n.h
new file mode 100644
--- /dev/null
+++ b/n.h
@@ -0,0 +1 @@
+only"""


def files_of(df):
    columns = ["path", "old_path", "status", "language", "binary", "additions", "deletions", "n_hunks", "parse_warning"]
    return [tuple(r) for r in df.orderBy("change_id", "file_idx").select(*columns).collect()]


def changes_of(df):
    rows = parse.changes(df).orderBy("change_id", "file_idx", "hunk_idx", "change_idx").collect()
    return [(r.path, r.hunk_idx, r.line_number, r.old_line_number, r.type, r.content) for r in rows]


def test_files(parse_text):
    assert files_of(parse_text(DIFF)) == [
        ("x.py", "x.py", "modified", "python", False, 4, 1, 2, True),
        ("gone.md", "fake", "deleted", None, False, 0, 2, 1, False),
        ("n.h", None, "added", "cpp", False, 1, 0, 1, False),
    ]


def test_file_numbers_are_dense_over_emitted_files(parse_text):
    assert [r.file_idx for r in parse_text(DIFF).orderBy("file_idx").collect()] == [0, 1, 2]


def test_hunk_headers(parse_text):
    rows = parse.hunks(parse_text(DIFF)).orderBy("file_idx", "hunk_idx").collect()
    assert [(r.old_start, r.old_lines, r.new_start, r.new_lines) for r in rows] == [
        (1, 3, 1, 4), (10, 1, 12, 0), (1, 2, 0, 0), (0, 0, 1, 1)]
    assert rows[0].header == "@@ -1,3 +1,4 @@ def f"


def test_lines_that_look_like_paths_are_lost(parse_text):
    assert changes_of(parse_text(DIFF))[:4] == [
        ("x.py", 0, 1, 1, "context", "ctx"),
        ("x.py", 0, 2, 2, "deletion", "old"),
        ("x.py", 0, 2, None, "addition", "new"),
        ("x.py", 0, 3, None, "addition", "  more"),
    ]


def test_no_files(parse_text):
    assert parse_text("", "  \n", "no diff here\n+x", "diff --git a/x b/x\nold mode 1\nnew mode 2").count() == 0


def test_carriage_returns_stay_in_lines_but_spoil_paths(parse_text):
    text = "diff --git a/x b/x\n--- a/x\r\n+++ b/x\r\n@@ -1 +1 @@\r\n+a\r"
    assert files_of(parse_text(text))[0][:3] == ("", None, "modified")
    assert changes_of(parse_text(text))[0][-1] == "a\r"


def plain(text):
    """A line by line reading of a diff, for comparison."""
    out, at = [], None
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            at = {"path": "", "old": None, "status": "modified", "hunks": [], "n": None}
            out.append(at)
        elif not line or at is None:
            continue
        elif line.startswith("--- "):
            if m := re.match(r"^--- a/([^\r\n]+)$", line):
                at["old"] = m[1]
            elif line == "--- /dev/null":
                at["status"] = "added"
        elif line.startswith("+++ "):
            if m := re.match(r"^\+\+\+ b/([^\r\n]+)$", line):
                at["path"] = m[1]
            elif line == "+++ /dev/null":
                at["status"], at["path"] = "deleted", at["old"] or ""
        elif line.startswith("@@"):
            if m := re.match(r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@", line):
                at["n"] = [int(m[1]), int(m[3])]
                at["hunks"].append([])
        elif at["hunks"] and line[0] in "+- ":
            old, new = at["n"]
            kind = {"+": "addition", "-": "deletion", " ": "context"}[line[0]]
            at["hunks"][-1].append((new, None if kind == "addition" else old, kind, line[1:]))
            at["n"] = [old + (kind != "addition"), new + (kind != "deletion")]
    return [f for f in out if f["hunks"]]


LINE = st.sampled_from(
    ["+a", "+  b", "-c", " d", "--- x", "+++ y", "--- a/p.py", "+++ b/q.ts", "--- /dev/null", "+++ /dev/null",
     "@@ -3,2 +4 @@", "@@ -1 +1,9 @@ f", "@@ broken", "", "\\ No newline", "Binary files a and b differ",
     "diff --git a/f b/f", "-- x", "+", "-", " ", "text"]
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(LINE, max_size=40), min_size=20, max_size=40))
def test_any_text_parses_like_a_line_by_line_reading(parse_text, diffs):
    texts = ["\n".join(["diff --git a/s b/s", *lines]) for lines in diffs]
    df = parse_text(*texts)
    rows = df.orderBy("change_id", "file_idx").collect()
    got = [
        (r.change_id, r.path, r.old_path, r.status, r.additions, r.deletions, r.n_hunks,
         [[(c.line_number, c.old_line_number, c.type, c.content) for c in h.changes] for h in r.hunks])
        for r in rows
    ]
    want = []
    for i, text in enumerate(texts):
        for f in plain(text):
            kinds = [c[2] for h in f["hunks"] for c in h]
            want.append((i, f["path"], f["old"], f["status"], kinds.count("addition"), kinds.count("deletion"),
                         len(f["hunks"]), f["hunks"]))
    assert got == want


def test_long_hunks(parse_text):
    lines = [["+a", "-b", " c"][i % 3] + str(i) for i in range(2000)]
    text = "diff --git a/b b/b\n--- a/b\n+++ b/b\n@@ -1,5 +1,5 @@\n" + "\n".join(lines)
    [row] = parse_text(text).collect()
    assert [[(c.line_number, c.old_line_number, c.type, c.content) for c in h.changes] for h in row.hunks] == plain(
        text)[0]["hunks"]


def test_line_cap_cuts_inside_a_hunk(parse_text):
    text = (
        "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n c\n+a\n+b\n@@ -9,2 +9,3 @@\n d\n+e\n+  f\n-g\n"
        "@@ -20 +20 @@\n+h"
    )
    capped = filters.cap_lines(parse_text(text), 4)
    [row] = capped.collect()
    assert [[c.content for c in h.changes] for h in row.hunks] == [["c", "a", "b"], ["d"]]
    assert (row.additions, row.deletions, row.n_hunks) == (5, 1, 2)
    assert [(a.line_number, a.content) for a in row.added] == [(2, "a"), (3, "b")]
    assert filters.cap_lines(parse_text(text), 6).collect()[0].n_hunks == 3
    assert filters.cap_lines(parse_text(text), 3).collect()[0].n_hunks == 1


def test_first_file_of_a_path(parse_text):
    one = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+{}\n"
    [row] = filters.file_by_path(parse_text(one.format(1) + one.format(2)), "x").collect()
    assert row.file_idx == 0 and row.hunks[0].changes[0].content == "1"
