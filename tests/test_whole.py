"""Whole analyses, streams, large change sets, and every query against its statement."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from changelens.catalogue import QUERIES
from changelens.functions import rows as rows_module
from changelens.operators import parse, prompts, report, risk, scan, summary
from changelens.params import FileChoice, ScanOptions
from changelens.plans import analysis
from changelens.sources import diffs, fixtures
from changelens.sources import tables
from changelens.streaming.content import scan_diff_stream, scan_stream, write_findings
from checks.compare import compare
from checks.statements import STATEMENTS

from .conftest import SMALL



@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_statement(spark, name):
    ok, note = compare(spark, SMALL, name, QUERIES[name], STATEMENTS.get(name))
    assert ok, note


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def one_file(path, lines):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1 +1,9 @@\n" + "\n".join(lines)


def test_source_choice(spark):
    rows = [
        (1, 0, "staged", ""), (1, 0, "worktree", " \n "), (1, 0, "branch", "b"),
        (2, 0, "staged", "s"), (2, 1, "staged", ""), (2, 0, "worktree", "w"), (2, 0, "branch", "b"),
        (3, 0, "branch", None), (4, 0, "other", "o"), (5, 0, "worktree", "w"),
    ]
    df = spark.createDataFrame(rows, "change_id bigint, part_idx bigint, source_kind string, diff_text string")
    got = diffs.choose_source(df).orderBy("change_id").collect()
    assert [(r.change_id, r.diff_text) for r in got] == [(1, "b"), (2, "s"), (5, "w")]
    assert [r.change_id for r in diffs.choose_source(df, staged_only=True).collect()] == [2]


def test_blank_and_fileless_change_sets_give_no_report(spark):
    rows = [(1, 0, "branch", "main", "just text"), (2, 0, "branch", "main", one_file("a.py", ["+x"]))]
    df = spark.createDataFrame(
        rows, "change_id bigint, part_idx bigint, source_kind string, base_branch string, diff_text string"
    )
    assert [r.change_id for r in analysis.quick_summary(df).collect()] == [2]
    lines = analysis.analyze(df)
    assert {r.change_id for r in lines.collect()} == {2}
    first = lines.where("section_idx = 0").orderBy("line_idx").collect()
    assert first[1].line == "**Files Changed:** 1 | **Lines:** +1 -0 | **Base:** main"


def test_filtered_facts(spark):
    text = one_file("a.py", ["+x"] * 9) + "\n" + one_file("b.md", ["+y"])
    df = spark.createDataFrame([(1, 0, text)], "change_id bigint, part_idx bigint, diff_text string")
    rows = analysis.facts_of(df, choice=FileChoice(include_patterns=("*.py",), max_lines_per_file=3)).collect()
    assert [(r.path, r.additions) for r in rows] == [("a.py", 9)]


def test_shared_folder_of_the_session_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = tables.shared_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    paths = []
    table = tables.cut(spark.range(3), "three", paths)
    assert table.count() == 3
    assert all(folder.split(":")[-1] in name for name in table.inputFiles())
    tables.drop_tables(spark, paths)
    assert not os.path.exists(paths[0].removeprefix("file:"))


def test_the_warehouse_is_used_where_no_folder_is_named():
    class Named:
        conf = {"spark.sql.warehouse.dir": "s3://bucket/warehouse/"}
        sparkContext = type("Context", (), {"getCheckpointDir": lambda self: None})()

    assert tables.shared_folder(Named()) == "s3://bucket/warehouse"
    Named.conf = {}
    with pytest.raises(ValueError):
        tables.shared_folder(Named())


PARTS = "change_id bigint, part_idx bigint, source_kind string, diff_text string"


def test_part_numbers_must_be_there_and_unique(spark):
    rows = [(1, 0, "branch", one_file("a.py", ["+x"])), (1, 0, "branch", one_file("b.py", ["+x"])),
            (2, None, "branch", one_file("c.py", ["+x"])), (3, 0, "branch", one_file("d.py", ["+x"]))]
    df = spark.createDataFrame(rows, PARTS)
    faults = [(r.change_id, r.part_idx, r.n_rows) for r in diffs.part_faults(df).orderBy("change_id").collect()]
    assert faults == [(1, 0, 2), (2, None, 1)]
    for change_id in (1, 2):
        with pytest.raises(Exception, match="part_idx"):
            diffs.choose_source(df.where(f"change_id = {change_id}")).collect()
    assert diffs.choose_source(df.where("change_id = 3")).count() == 1
    for bad in (diffs.choose_source, parse.parse_files):
        with pytest.raises(ValueError):
            bad(df.drop("part_idx"))
    with pytest.raises(Exception, match="part_idx"):
        parse.parse_files(df.where("change_id = 2")).collect()


def test_a_large_diff_file_is_read_in_parts(spark, tmp_path):
    text = "\n".join(one_file(f"src/f{i}.py", [f"+line {i}", "+password = 'hunter2hunter2'"]) for i in range(4000))
    (tmp_path / "big.diff").write_text(text + "\n")
    (tmp_path / "small.diff").write_text(one_file("a.py", ["+x"]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = diffs.read_diff_files(spark, str(tmp_path / "*.diff"))
        tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
        files = parse.parse_files(read).select("change_id", "file_idx", "path", "additions").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert tasks > 4
    whole = spark.createDataFrame(
        [(n, 0, "main", (tmp_path / f"{n}.diff").read_text()) for n in ("big", "small")],
        "change_id string, part_idx bigint, base_branch string, diff_text string",
    )
    want = parse.parse_files(whole).select("change_id", "file_idx", "path", "additions").collect()

    def in_order(rows):
        return [(r.path, r.additions) for r in sorted(rows, key=lambda r: ("small" in r.change_id, r.file_idx))]

    assert in_order(files) == in_order(want) and len(files) == 4001
    assert len({(r.change_id, r.file_idx) for r in files}) == 4001


@pytest.fixture
def no_broadcast(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def _exchanges_of_text(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_texts_move_by_part_and_never_by_change_set(spark, no_broadcast):
    """A third of all parts in one change set; no task gets it whole."""
    rows = [(0 if i % 3 == 0 else i, i, "branch", one_file(f"f{i}.py", ["+x"])) for i in range(9000)]
    df = spark.createDataFrame(rows, PARTS).repartition(8)
    chosen = diffs.choose_source(df, limit=0)
    with_text = [e for e in _exchanges_of_text(chosen) if "part_idx" in e]
    assert len(with_text) >= 2
    held = chosen.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    counts = sorted(r["count"] for r in held)
    assert sum(counts) == 9000 and counts[-1] < 2 * counts[len(counts) // 2]


@pytest.mark.parametrize("name", ["file_by_path", "test_suggestions", "suggestion_texts", "test_prompt"])
def test_a_query_parses_the_text_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") > 0
    assert sum("(?md)^(?=diff --git )" in line for line in plan.split("\n")) == 1


def test_text_and_diff_folders(spark, tmp_path):
    (tmp_path / "x.diff").write_text(one_file("a.py", ["+password = 'hunter2hunter2'"]))
    read = diffs.read_diff_files(spark, str(tmp_path / "*.diff"))
    assert scan.scan_diff(parse.parse_files(read)).count() == 1
    (tmp_path / "src.py").write_text("a\npassword = 'hunter2hunter2'\n")
    sources = diffs.read_text_files(spark, str(tmp_path / "*.py"))
    assert [r.line for r in scan.scan_content(sources, ["path"]).select("line").collect()] == [2]
    read.write.parquet(str(tmp_path / "table"))
    assert diffs.read_diffs(spark, str(tmp_path / "table")).count() == 1


def test_stream_gives_the_batch_findings(spark, tmp_path):
    files = fixtures.scan_files(spark, SMALL)
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    query = write_findings(scan_stream(stream, ["doc_id"]), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scan.scan_content(files, ["doc_id"])
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_diff_stream(spark, tmp_path):
    parts = fixtures.parts(spark, SMALL)
    parts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "in"))
    write_findings(scan_diff_stream(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == scan.scan_diff(parse.parse_files(parts)).count()


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of all parts in one change set."""
    secret = "+password = 'hunter2hunter2'"
    rows = [
        (0, i, one_file(f"src/d{i % 7}/f{i}.py", [secret] * (1 + i % 3) + ["+" + " " * (i % 50) + "x"]))
        for i in range(2500)
    ]
    rows += [(1 + i % 500, i // 500, one_file(f"lib/g{i}.go", ["+y", "-z"])) for i in range(5000)]
    df = spark.createDataFrame(rows, "change_id bigint, part_idx bigint, diff_text string").repartition(16)
    return tables.cut(summary.file_facts(parse.parse_files(df)))


def test_large_change_set_totals(lopsided):
    [row] = summary.profile(lopsided).where("change_id = 0").collect()
    assert (row.total_files, row.n_findings) == (2500, sum(1 + i % 3 for i in range(2500)))
    assert summary.profile(lopsided).count() == 501


def test_large_change_set_lists_are_whole(lopsided):
    entries = summary.path_list_texts(lopsided).where("change_id = 0 AND list = 'modified'").orderBy("file_idx").collect()
    assert len(entries) == 2500
    assert "".join(e.text for e in entries) == ", ".join(f"src/d{i % 7}/f{i}.py" for i in range(2500))


def test_large_change_set_top_lists(lopsided):
    found = scan.explode_findings(lopsided, parse.FILE_KEY, ScanOptions(max_findings=1500), ["change_id"])
    assert found.where("change_id = 0").count() == 1500
    assert report.top_findings(found).where("change_id = 0").orderBy("rank").collect()[0].file == "src/d0/f0.py"
    first = found.agg(F.max("file_idx").alias("m")).collect()[0].m // rows_module.FILES_PER_PART
    total, i = 0, 0
    while total < 1500:
        total, i = total + 1 + i % 3, i + 1
    assert first == i - 1
    keys = prompts.key_changes(lopsided).where("change_id = 0").orderBy("rank").collect()
    assert [k.path for k in keys] == [f"src/d{i % 7}/f{i}.py" for i in (2, 5, 8, 11, 14)]


def test_large_change_set_report(lopsided):
    assessment = tables.cut(risk.assess(lopsided))
    lines = report.complete(assessment, lopsided).where("change_id = 0").orderBy("section_idx", "line_idx", "entry_no")
    text = [r.line for r in lines.collect()]
    assert f"**Total Issues:** {sum(1 + i % 3 for i in range(2500))}" in text
    assert "**Modified (2500):** src/d0/f0.py, src/d1/f1.py, src/d2/f2.py and 2497 more" in text
    suggestion = summary.split_suggestions(lopsided).where("change_id = 0 AND kind = 'directory'").collect()
    assert suggestion[0].suggestion == (
        "Split by directory: src/d0 (358 files), src/d1 (357 files), src/d2 (357 files)")


def test_salted_limit_is_exact(spark):
    df = spark.range(30000).selectExpr("id % 3 AS k", "id AS o")
    got = rows_module.first_n(df, 1200, ["k"], ["o DESC"]).orderBy("k", "rank").collect()
    assert [(r.k, r.o, r.rank) for r in got] == [
        (k, o, n + 1) for k in range(3) for n, o in enumerate(range(29997 + k, 29997 + k - 3600, -3))]
