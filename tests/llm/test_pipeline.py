"""Stages on hard documents and the whole pipeline against brute force."""

import shutil

import corpus_pipeline
import pytest
from changelens.llm import quality
from changelens.llm.ngram_join import JoinParams

from tests.llm import test_decontam, test_ngram_join, test_quality, test_site_lines
from tests.llm.cases import documents, hard_rows, plain

SMALL = "/root/testdata/sf0.001"


def after_rules(rows):
    """No cutoff is certified by the few labels of the small tables."""
    return [r for r in rows if (s := test_quality.brute(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]


def after_lines(rows):
    from changelens.llm.site_lines import SiteParams

    texts = {r[0]: r[1] for r in test_site_lines.brute(rows, SiteParams())}
    return [(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in rows]


def after_copies(rows):
    groups = {d: c for d, _, c in test_ngram_join.brute(rows, JoinParams())}
    return [r for r in rows if groups[r[0]] == r[0]]


def test_pipeline_against_brute_force(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    documents_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    rows = [tuple(r) for r in documents_.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    # enough pages of one source for common lines, and near copies
    rows = [(i, f"shared line {i % 2}\n{t}" if i % 3 else t, g, "s", n) for i, t, g, _, n in rows]
    rows += [(9000 + r[0], r[1] + "\nend", *r[2:]) for r in rows[:30]]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(["doc_id", "text", "lang", "source", "n_chars"])})
    pq.write_table(table, tmp_path / "documents.parquet")
    windows = test_decontam.windows_of(bench)
    want = [r for r in after_copies(after_lines(after_rules(rows))) if not test_decontam.brute(r[1], windows)[1]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in want} and len(want) < len(rows)
    lengths = {r.doc_id: r.doc_tokens for r in got}
    for doc_id, total in lengths.items():
        assert sum(r.length for r in got if r.doc_id == doc_id) == total


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_hard_documents(spark, name, stage):
    docs = documents(spark, clash=True)
    out = stage(spark, docs, SMALL)
    if name != "packing":
        assert out.columns == docs.columns
        assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    out.collect()
    none = stage(spark, documents(spark, [], clash=True), SMALL)
    assert none.columns == out.columns and none.count() == 0


def test_stage_names_and_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_rules_keep_what_brute_force_keeps(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = quality.keep_good(documents(spark), labels)
    assert plain(kept.collect()) == plain(after_rules(hard_rows()))
