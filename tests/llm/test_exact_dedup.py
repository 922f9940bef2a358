"""The tree merge against a brute-force grouping."""

import hashlib
import re
from collections import defaultdict

import pytest

from changelens.llm import exact_dedup
from tests.llm.cases import documents, hard_rows

PARAMS = [exact_dedup.MergeParams(), exact_dedup.MergeParams(run_rows=3, fan_in=2), exact_dedup.MergeParams(run_rows=1, fan_in=3)]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def groups(rows):
    out = defaultdict(list)
    for row in rows:
        out[normal(row[1])].append(row[0])
    return out


def check(found, rows):
    by_text = groups(rows)
    expected = sorted(
        (
            (i, min((x for x in by_text[normal(t)] if x is not None), default=None), len(by_text[normal(t)]),
             hashlib.sha256(normal(t).encode()).hexdigest())
            for i, t, *_ in rows
        ),
        key=repr,
    )
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected
    kept = defaultdict(list)
    for r in found:
        if r.kept:
            assert r.id == r.keep_id
            kept[r.text_sha256].append(r.id)
    assert all(len(ids) == 1 for ids in kept.values()) and len(kept) == len(by_text)


@pytest.mark.parametrize("params", PARAMS)
@pytest.mark.parametrize("parts", [1, 7])
def test_hard_rows(spark, params, parts):
    rows = hard_rows()
    check(exact_dedup.exact_duplicates(documents(spark).repartition(parts), params).collect(), rows)


def test_one_group_of_most_rows_and_a_long_text(spark):
    rows = [(i, "same  text" if i % 3 else "same\ttext", None, None, None) for i in range(900, 300, -1)]
    rows += [(i, f"text {i}", None, None, None) for i in range(50)] + [(1000 + i, "w " * 500_000 + " \n" * i, None, None, None) for i in (1, 2)]
    params = exact_dedup.MergeParams(run_rows=16, fan_in=4)
    check(exact_dedup.exact_duplicates(documents(spark, rows).repartition(5), params).collect(), rows)


def test_empty_table_and_null_ids(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []
    rows = [(None, "a", "x", None, None), (None, "a", "y", None, None), (None, "b", None, None, None), (None, None, None, None, None)]
    check(exact_dedup.exact_duplicates(documents(spark, rows)).collect(), rows)


def test_rows_that_stay_keep_their_columns_whatever_the_layout(spark):
    rows = hard_rows() + [(16, hard_rows()[16][1], "zz", None, 9), (16, hard_rows()[16][1], "aa", None, 9)]
    results = []
    for parts in (1, 6):
        kept = exact_dedup.drop_copies(documents(spark, rows, clash=True).repartition(parts))
        assert kept.columns == documents(spark, [], clash=True).columns
        results.append(sorted(map(repr, kept.collect())))
        assert len(results[-1]) == len(groups(rows))
    assert results[0] == results[1]


def test_largest_task_of_a_hot_group(spark):
    """A third of all rows in one group: above the first runs no run has the key twice."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", None, None, None) for i in range(600)]
    params = exact_dedup.MergeParams(run_rows=10, fan_in=4)
    keyed = exact_dedup.keyed_rows(documents(spark, rows).coalesce(1), "doc_id", "text")
    found = exact_dedup.exact_duplicates(documents(spark, rows).coalesce(1), params)
    assert keyed.select("sha").distinct().count() == 401
    assert found.where("group_size = 200 and keep_id = 0").count() == 200
    assert found.where("kept").count() == 401
