"""What holds for keys, texts and tables of any size: running totals, lookups,
source choice, diffs in parts, long texts, sinks, streams and pattern tables."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.functions.running import running
from changelens.operators import hunk_parts, long_texts, parse, pattern_sets, scan, summary
from changelens.params import ScanOptions, SecretPattern
from changelens.sources import diffs, fixtures, sinks, tables
from changelens.streaming import content

from .conftest import SMALL
from .test_parse import DIFF

SECRET = "password = 'hunter2hunter2'"


@pytest.fixture
def plain_joins(spark):
    """No broadcast and no adaptive execution but what the code asks for."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def task_sizes(df):
    rows = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return sorted(r["count"] for r in rows)


# --- running totals ---------------------------------------------------------------------


@pytest.mark.parametrize("chunk_rows", [1, 7, 4096])
def test_running_totals(spark, chunk_rows):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.randrange(9), rng.choice([None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, n long, v string").repartition(5)
    got = running(df, ["k"], ["o"], {"total": "n", "above": "1L"}, {"seen": ("v", "v IS NOT NULL")}, chunk_rows=chunk_rows)
    found = {(r.k, r.o): (r.total, r.above, r.seen and r.seen.value) for r in got.collect()}
    for k, o, *_ in rows:
        before = [r for r in rows if r[0] == k and r[1] < o]
        values = [r[3] for r in before if r[3]]
        assert found[k, o] == (sum(r[2] for r in before), len(before), values[-1] if values else None)
    assert running(df.where("false"), ["k"], ["o"], {"total": "n"}).count() == 0


# --- lookups ----------------------------------------------------------------------------


def test_lookup_deals_a_hot_key_to_several_tasks(spark, plain_joins):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 0L, id % 1000) AS k", "id AS o")
    table = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    sent, dealt = tables.lookup(rows, table, ["k"]), tables.lookup(rows, table, ["k"], spread="o", limit=0)
    assert "BroadcastHashJoin" in plan(sent) and "SortMergeJoin" in plan(dealt)
    assert sent.exceptAll(dealt).count() == 0 and dealt.count() == 60_000
    sizes = task_sizes(dealt)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    kept = tables.lookup(rows, table.where("k < 5").select("k"), ["k"], "left_semi", spread="o", limit=0)
    assert kept.count() == rows.where("k < 5").count()


def test_path_lists_of_a_hot_change_set(spark, plain_joins, monkeypatch):
    rows = [(0 if i % 3 == 0 else i, i, f"src/f{i}.ts", "modified") for i in range(9000)]
    facts = spark.createDataFrame(rows, "change_id long, file_idx long, path string, status string").selectExpr(
        "*", "cast(null as string) AS old_path", "false AS is_critical", "false AS is_test", "false AS is_config"
    )
    facts = tables.cut(facts.repartition(8))
    whole = summary.path_list_texts(facts)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tables.lookup, "__defaults__", ("inner", None, 0))
    dealt = summary.path_list_texts(facts)
    assert "SortMergeJoin" in plan(dealt) and whole.exceptAll(dealt).count() == 0
    sizes = task_sizes(dealt)
    assert sum(sizes) == 9000 and sizes[-1] < 2 * sizes[len(sizes) // 2]


# --- source choice ----------------------------------------------------------------------

KINDS = "change_id bigint, part_idx bigint, source_kind string, diff_text string"


def kinds(n):
    rows = []
    for i in range(n):
        change = 0 if i % 3 == 0 else i
        rows += [(change, i, "staged", "" if change % 2 else f"s{i}"), (change, i, "worktree", " \n"), (change, i, "branch", f"b{i}")]
    return rows


def test_chosen_sources_move_no_text(spark, plain_joins):
    df = spark.createDataFrame(kinds(300), KINDS).repartition(4)
    chosen = diffs.choose_source(df)
    assert "BroadcastHashJoin" in plan(chosen) and "SortMergeJoin" not in plan(chosen)
    by_part = diffs.choose_source(df, limit=0)
    assert "SortMergeJoin" in plan(by_part)
    assert chosen.count() == 300 and chosen.exceptAll(by_part).count() == 0


def test_bucketed_texts_stay_where_they_are(spark, plain_joins):
    spark.sql("DROP TABLE IF EXISTS bucketed_diffs")
    diffs.write_diffs(spark.createDataFrame(kinds(300), KINDS), "bucketed_diffs", 4)
    chosen = diffs.choose_source(spark.table("bucketed_diffs"), limit=0)
    text = plan(chosen)
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    moved = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    above_scan = text.split("Bucketed: true")[0].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in above_scan and moved
    assert text.count("FileScan") <= 3  # the texts and the thin keys, which the choice reads twice
    assert text.count("diff_text") and sum("bucketed_diffs" in line for line in text.split("\n") if "FileScan" in line) == 1
    assert {(r.change_id % 2, r.diff_text[0]) for r in chosen.collect()} == {(0, "s"), (1, "b")}


def test_source_of_rows_without_a_change_id(spark):
    rows = [(None, 0, "staged", " "), (None, 0, "branch", "b"), (None, 1, "branch", "c"), (5, 0, "staged", "s"), (5, 0, "branch", "t")]
    got = diffs.choose_source(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted((r.change_id or -1, r.diff_text) for r in got) == [(-1, "b"), (-1, "c"), (5, "s")]


# --- files numbered, diffs in parts -------------------------------------------------------


def parts_of(spark, texts, cuts, seed=0):
    """Each text cut at random lines into about as many parts."""
    rng, rows = random.Random(seed), []
    for change, whole in enumerate(texts):
        lines = whole.splitlines(keepends=True)
        at = sorted(rng.sample(range(1, len(lines)), min(cuts, len(lines) - 1)))
        for n, (a, b) in enumerate(zip([0, *at], [*at, len(lines)])):
            rows.append((change, n * 3, "".join(lines[a:b])))
    return spark.createDataFrame(rows, "change_id bigint, part_idx bigint, diff_text string").repartition(6)


FILE_COLUMNS = ["change_id", "file_idx", "path", "old_path", "status", "language", "binary", "additions", "deletions", "n_hunks", "parse_warning"]


def whole_files(spark, texts):
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "change_id bigint, part_idx bigint, diff_text string")
    return parse.parse_files(parse.number_parts(df))


@pytest.mark.parametrize("seed", range(4))
def test_cuts_at_any_line_change_nothing(spark, seed):
    second = DIFF.replace("x.py", "y.ts").replace("+new", "+new\n--- a/odd\n+++ b/other\n+++ /dev/null")
    texts = [DIFF, DIFF + "\n" + second, second + "\n" + DIFF, "no diff\nat all", DIFF.split("diff --git a/img")[0]]
    whole = whole_files(spark, texts)
    cut = hunk_parts.parse_hunk_parts(parts_of(spark, texts, (3, 9, 40, 400)[seed], seed), limit=0 if seed % 2 else 1 << 20, chunk_rows=4)
    assert sorted(map(tuple, cut.files.select(FILE_COLUMNS).collect())) == sorted(map(tuple, whole.select(FILE_COLUMNS).collect()))
    key = lambda r: repr(tuple(r))
    assert sorted(cut.changes().collect(), key=key) == sorted(parse.changes(whole).collect(), key=key)
    assert sorted(cut.hunks().collect(), key=key) == sorted(parse.hunks(whole).collect(), key=key)


def test_one_huge_file_is_read_by_several_tasks(spark, tmp_path):
    hunks = "\n".join(f"@@ -{i * 9 + 1},2 +{i * 9 + 1},3 @@ f{i}\n a\n-b{i}\n+c{i}\n+d" for i in range(6000))
    text = f"diff --git a/big.py b/big.py\n--- a/big.py\n+++ b/big.py\n{hunks}\ndiff --git a/z.md b/z.md\n--- a/z.md\n+++ b/z.md\n@@ -1 +1 @@\n+z"
    (tmp_path / "one.diff").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        read = diffs.read_diff_hunks(spark, str(tmp_path / "*.diff"))
        assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        cut = hunk_parts.parse_hunk_parts(read)
        files = cut.files.orderBy("file_idx").select("file_idx", "path", "additions", "deletions", "n_hunks").collect()
        changes = cut.changes().drop("change_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [tuple(f) for f in files] == [(0, "big.py", 12000, 6000, 6000), (1, "z.md", 1, 0, 1)]
    key = lambda r: repr(tuple(r))
    assert sorted(changes, key=key) == sorted(parse.changes(whole_files(spark, [text])).drop("change_id").collect(), key=key)


def test_dense_numbers_of_a_lopsided_table(spark):
    one = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n+x"
    binary = "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ"
    rows = [(0 if i % 2 else i, i, "\n".join([one.format(f"a{i}"), binary, *([one.format(f"b{i}")] if i % 5 == 0 else [])])) for i in range(6000)]
    rows += [(7_000, i, binary) for i in range(3)]
    df = spark.createDataFrame(rows, "change_id bigint, part_idx bigint, diff_text string").repartition(8)
    for limit in (0, 1 << 25):
        files = parse.parse_files(parse.number_parts(df, limit)).select("change_id", "file_idx", "path").collect()
        by_change = {}
        for f in files:
            by_change.setdefault(f.change_id, []).append((f.file_idx, f.path))
        for own in by_change.values():
            assert [n for n, _ in sorted(own)] == list(range(len(own)))
        wanted = [f"{x}{i}" for i in range(6000) if i % 2 or i == 0 for x in ("a", "b")[: 2 if i % 5 == 0 else 1]]
        assert [p for _, p in sorted(by_change[0])] == wanted


# --- long texts ---------------------------------------------------------------------------

CONTEXT = ScanOptions(include_context=True, context_lines=3)


def long_text(n):
    rng = random.Random(n)
    return "\n".join(SECRET if rng.random() < 0.03 else f"line {i}" for i in range(n))


@pytest.mark.parametrize("block_lines", [1, 4, 1000])
def test_blocks_of_a_text_give_its_findings(spark, block_lines):
    texts = [(1, "a.py", long_text(700)), (2, "b.py", SECRET), (3, "c.py", ""), (4, "d.py", None), (5, "dist/e.js", SECRET), (6, None, SECRET)]
    df = spark.createDataFrame(texts, "k long, path string, text string")
    want = scan.scan_content(df, ["k"], CONTEXT)
    got = long_texts.scan_blocks(df, ["k"], CONTEXT, block_lines=block_lines)
    assert got.columns == want.columns and got.count() == want.count() > 10
    assert got.exceptAll(want).count() == 0
    limited = long_texts.scan_blocks(df, ["k"], ScanOptions(max_findings=3), block_lines=block_lines)
    assert limited.exceptAll(scan.scan_content(df, ["k"], ScanOptions(max_findings=3))).count() == 0


@pytest.mark.parametrize("block_lines", [2, 512])
def test_a_file_is_scanned_by_several_tasks(spark, tmp_path, block_lines):
    (tmp_path / "big.py").write_text(long_text(4000))
    (tmp_path / "small.py").write_text(f"x\n{SECRET}")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = long_texts.scan_text_files(spark, str(tmp_path), CONTEXT, block_lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = scan.scan_content(diffs.read_text_files(spark, str(tmp_path)), ["path"], CONTEXT).collect()
    key = lambda r: repr(sorted(r.asDict().items()))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 80


# --- sinks and streams ----------------------------------------------------------------------


def test_writing_twice_gives_the_same_rows(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'x', concat('k', id % 4)) AS k", "id")
    for _ in range(2):
        sinks.write_rows(rows, f"{tmp_path}/t", ["k"], ["id"], rows_per_file=300)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 5000 and back.select("k", "id").exceptAll(rows).count() == 0
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 300
    assert back.where("k = 'x'").select(F.input_file_name()).distinct().count() >= 6
    sinks.write_rows(spark.createDataFrame([("x", 1)], "k string, id long"), f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("k").count().where("k = 'x'").first()["count"] == 1
    assert spark.read.parquet(f"{tmp_path}/t").where("k != 'x'").count() == rows.where("k != 'x'").count()


@pytest.fixture
def growing(spark, tmp_path):
    """Parts of change sets that arrive in three batches, one file a batch."""
    parts = fixtures.parts(spark, SMALL).collect()
    schema = fixtures.parts(spark, SMALL).schema
    third = max(p.part_idx for p in parts) // 3 + 1
    for i in range(3):
        own = [p for p in parts if p.part_idx // third == i]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return stream, spark.createDataFrame(parts, schema)


@pytest.mark.parametrize("n", [1, 3])
def test_limited_findings_of_a_stream(spark, tmp_path, growing, n):
    stream, parts = growing
    options = ScanOptions(max_findings=n)
    content.write_findings(content.scan_diff_stream(stream(), options), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out"), scan.scan_diff(parse.parse_files(parts), options)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_totals_of_a_stream(spark, tmp_path, growing):
    stream, parts = growing
    files = parse.parse_files(parts)
    for name, updates, keys in (
        ("totals", content.totals_stream(stream()), ["change_id"]),
        ("types", content.types_stream(stream()), ["change_id", "severity", "type"]),
    ):
        sinks.write_updates(updates, f"{tmp_path}/{name}", f"{tmp_path}/{name}-check").awaitTermination()
    totals = sinks.read_updates(spark, f"{tmp_path}/totals", ["change_id"])
    assert spark.read.parquet(f"{tmp_path}/totals").select("batch").distinct().count() == 3
    want = summary.change_totals(files)
    assert totals.select(want.columns).exceptAll(want).count() == 0 and totals.count() == want.count()
    types = sinks.read_updates(spark, f"{tmp_path}/types", ["change_id", "severity", "type"])
    flat = lambda df: sorted(repr(r) for r in df.collect())
    assert flat(scan.summary_of_types(totals, types)) == flat(scan.scan_summary(want, scan.scan_diff(files)))


# --- pattern sets ----------------------------------------------------------------------------


def test_pattern_sets_equal_separate_scans(spark):
    own = SecretPattern("HOST", r"\bdb\.[a-z]+", "HIGH", 0.9, include_files=(r"\.py$",), exclude_files=("/skip/",))
    sets = {"a": ScanOptions(), "b": ScanOptions(min_severity="HIGH", custom_patterns=(own,), exclude_types=("PASSWORD",))}
    text = f"{SECRET}\nhost db.internal and db.other\nmail someone@corp.io\nAKIA" + "IOSFODNN7QXZWVTR"
    rows = [(f"{s}{i}", s, p, t) for s in ("a", "b", "c", None) for i, (p, t) in enumerate(
        [("x.py", text), ("skip/x.py", text), ("dist/x.js", text), (".env", text), ("y.md", ""), ("z.md", None), ("w.ts", text * 3)])]
    df = spark.createDataFrame(rows, "k string, repo string, path string, text string")
    table = tables.cut(pattern_sets.pattern_sets(spark, sets))
    for limit in (0, 1 << 25):
        got = pattern_sets.scan_with_sets(df, ["k"], table, "repo", limit=limit)
        want = scan.scan_content(df.where("repo = 'a'"), ["k"], sets["a"])
        want = want.unionByName(scan.scan_content(df.where("repo = 'b'"), ["k"], sets["b"]))
        assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count() > 10
