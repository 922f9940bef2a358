import random

import numpy as np
import pytest
from changelens.llm import ngram_join, queries
from changelens.llm.components import components
from changelens.llm.ngram_join import JoinParams
from pyspark.sql import functions as F

from tests.llm.cases import SPACED, documents, hard_rows, lower, plain, prose


def shingle_set(text, k):
    words = SPACED.findall(lower(text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, params):
    """``doc_id, n_shingles, component_id`` by comparing all pairs."""
    sets = [shingle_set(r[1], params.words) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= params.percent * len(x | y):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return plain([(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))])


def families(seed, n_families=12, most=14):
    """Groups of copies with a few words changed, joined by shared passages."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 60, 90000), []
    for _ in range(n_families):
        words = prose(rng, rng.randrange(20, 260), 90000).split()
        for _ in range(rng.randrange(1, most)):
            own = list(words)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
            if rng.random() < 0.3:
                own += passage.split()
            if rng.random() < 0.2:
                own = own[: rng.randrange(len(own) // 2, len(own))]
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(i * 3 % len(rows) if len(rows) % 3 else i, t, "en", "s", None) for i, t in enumerate(rows)]


PARAMS = [
    JoinParams(words=3, percent=90),
    JoinParams(),
    JoinParams(words=2, percent=60, least_count=2, frequent_limit=100000, token_classes=1),
    JoinParams(words=3, percent=80, least_count=2, frequent_limit=40, broadcast_rows=0),
    JoinParams(words=1, percent=50, least_count=2, most_matches=1),
]


@pytest.mark.parametrize("params", PARAMS)
def test_against_all_pairs(spark, params):
    rows = hard_rows() + [(1000 + r[0], *r[1:]) for r in families(params.words)]
    got = ngram_join.near_duplicates(documents(spark, rows, clash=True).repartition(5), params)
    assert plain(got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, params)


def test_one_of_each_group_stays(spark):
    rows = hard_rows() + [(1000 + r[0], *r[1:]) for r in families(21)]
    docs = documents(spark, rows, clash=True)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute(rows, JoinParams())
    with_words = {c for d, n, c in want if n and c is not None}
    empty = [d for d, n, _ in want if not n]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i in with_words) == sorted(with_words)
    assert sorted(i for i in ids if i not in with_words and i is not None) == sorted(e for e in empty if e is not None)
    assert ids.count(None) == 1  # the row whose words are its own; the other is a copy
    assert plain(ngram_join.keep_one(docs, JoinParams(broadcast_rows=0)).collect()) == plain(kept.collect())


def test_one_near_copy_without_an_id_stays(spark):
    rng = random.Random(12)
    text, other = prose(rng, 200, 90000), prose(rng, 200, 90000)
    rows = [(None, f"{text} end{i}", "en", "s", i) for i in range(4)]
    rows += [(None, f"{other} end{i}", "en", "s", i) for i in range(2)] + [(7, other, "en", "s", 9)]
    docs = documents(spark, rows)
    for params in (JoinParams(), JoinParams(broadcast_rows=0)):
        kept = ngram_join.keep_one(docs, params).collect()
        assert [r.doc_id for r in kept if r.text.startswith(other)] == [7]
        assert [r.doc_id for r in kept if r.text.startswith(text)] == [None]


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 200, 90000) for _ in range(3))
    rows = [(5, t, "en", "s", None) for t in (a, a, f"{a} end", b, "", None)]
    rows += [(6, c, "en", "s", None), (6, f"{b} end", "en", "s", None), (6, None, "en", "s", None)]
    docs = documents(spark, rows)
    for params in (JoinParams(), JoinParams(broadcast_rows=0)):
        kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs, params).collect()]
        assert sum(r in ((5, a), (5, f"{a} end")) for r in kept) == 1
        rest = [r for r in kept if r not in ((5, a), (5, f"{a} end"))]
        assert plain(rest) == plain([(5, b), (5, ""), (5, None), (6, c), (6, None)])


def test_empty_table_and_texts_without_words(spark):
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0
    assert ngram_join.keep_one(documents(spark, [])).count() == 0
    rows = [(1, None, "a", "b", 1), (2, "", "a", "b", 1), (2, " ", "a", "b", 1)]
    got = ngram_join.near_duplicates(documents(spark, rows)).collect()
    assert plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert ngram_join.keep_one(documents(spark, rows)).count() == 3


def test_a_prefix_of_l_more_shares_l():
    rng = random.Random(2)
    for _ in range(3000):
        percent, n = rng.choice([50, 80, 90]), rng.randrange(1, 60)
        a = set(rng.sample(range(80), n))
        b = set(a)
        for _ in range(rng.randrange(6)):
            b.discard(rng.randrange(80))
            b.add(rng.randrange(80))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        for level in range(1, 7):
            if level > min(ngram_join.required(len(s), percent) for s in (a, b)):
                continue
            first = [set(sorted(s)[: len(s) - ngram_join.required(len(s), percent) + level]) for s in (a, b)]
            assert len(first[0] & first[1]) >= level


def test_more_matches_are_asked_for_where_shingles_are_frequent():
    rare, often = np.zeros(100, np.int64), np.full(100, 500)
    assert ngram_join.matches_to_ask(rare, 100, 90, 6) == 1
    assert ngram_join.matches_to_ask(often, 100, 90, 6) == 6
    late = np.where(np.arange(100) < 11, 0, 10**6)
    assert ngram_join.matches_to_ask(late, 100, 90, 6) == 1


def test_counts_are_those_of_all_texts(spark):
    rows = families(5) * 3
    params = JoinParams(words=3, least_count=2)
    texts = documents(spark, rows).select("text").repartition(7)
    got = {r.key: r.n for r in ngram_join._counted(texts, params).collect()}
    want = {}
    for r in rows:
        data = np.frombuffer(r[1].encode(), np.uint8)
        _, h, _ = ngram_join.shingles(data, np.array([0, len(data)]), 3)
        assert len(h) == len(shingle_set(r[1], 3))
        for key in (h >> np.uint64(32)).tolist():
            want[key] = want.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_components_of_random_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 540)] + [(7, 7)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    least = {n: n for pair in links for n in pair}
    for _ in range(len(least)):
        moved = False
        for u, v in links:
            low = min(least[u], least[v])
            moved |= least[u] != low or least[v] != low
            least[u] = least[v] = low
        if not moved:
            break
    assert {r.node: r.component for r in rows} == {n: c for n, c in least.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op9_ngram_join(spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert plain(got.collect()) == brute(docs, JoinParams(words=3, percent=90))
    assert F


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_agree_modulo_powers_of_two(spark, n):
    """Words of the Thue-Morse sequence and its complement agree in every
    polynomial modulo 2^64; their documents share nothing."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    one, two = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
    rows = [(1, f"{one} x y", None, None, None), (2, f"{two} x y", None, None, None), (3, f"{one} {two} {one} {two} {two}", None, None, None)]
    found = ngram_join.near_duplicates(documents(spark, rows), JoinParams(words=3, percent=90))
    assert plain(found.select("doc_id", "n_shingles", "component_id").collect()) == [(1, 1, 1), (2, 1, 2), (3, 3, 3)]


def test_largest_task_of_one_component(spark):
    """A component with a third of all nodes, its centre with most links."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    links = spark.range(3, 30_000, 3).selectExpr("id AS u", "0L AS v").unionByName(
        spark.range(1, 30_000, 3).selectExpr("id AS u", "id + 1 AS v"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = {r.node: r.component for r in components(links).collect()}
        from changelens.llm.tables import lookup
        least = links.groupBy("v").agg(F.min("u").alias("m"))
        dealt = lookup(links, least, ["v"], spread="u", limit=0)
        sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {**{i: 0 for i in range(3, 30_000, 3)}, **{i + 1: i for i in range(1, 30_000, 3)}}
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_no_table_but_the_last_ones_stays(spark, tmp_path):
    import os

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ngram_join.near_duplicates(documents(spark, families(1))).collect()
    left = [d.rsplit("-", 1)[0] for folder in os.listdir(tmp_path) for d in os.listdir(tmp_path / folder)]
    assert sorted(set(left)) == ["components", "described", "labelled"] or not left, left


def test_pairs_of_a_frequent_shingle_are_dealt_to_tiles(spark):
    """Each ordered pair meets once, and no tile has a large share of the rows."""
    n, params = 600, JoinParams(token_classes=6)
    entries = spark.range(n).selectExpr("7L AS token", "id AS cls", f"{n}L AS n_classes").unionByName(
        spark.range(3).selectExpr("8L AS token", "id AS cls", "3L AS n_classes"))
    x, y = ngram_join.dealt_pairs(entries, ["cls"], params)
    tile = ["token", "tile_row", "tile_column"]
    met = x.join(y, tile)
    assert met.count() == met.distinct().count() == n * n + 9
    for side in (x, y):
        sizes = [r["count"] for r in side.where("token = 7").groupBy(*tile).count().collect()]
        assert len(sizes) == 100 and max(sizes) < 2 * n / 10
        assert side.where("token = 8").count() == 3


def test_frequent_shingles_of_unlinked_documents(spark):
    """One passage in most documents, which share nothing else."""
    rng = random.Random(3)
    passage = prose(rng, 30, 9000)
    rows = [(i, f"{passage} {prose(rng, 6 + i % 9, 90000)}", "en", "s", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s", 1) for i in range(0, 120, 7)]
    params = JoinParams(words=3, percent=90, least_count=2, token_classes=4)
    found = ngram_join.near_duplicates(documents(spark, rows), params)
    assert plain(found.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows, params)
