import zlib

from changelens.llm import hilbert, queries
from pyspark.sql import functions as F

from tests.llm.cases import documents, hard_rows


def test_the_curve_visits_neighbours(spark):
    for n, bits in ((2, 4), (3, 3), (3, 1)):
        side = 1 << bits
        cells = spark.range(side**n).select(
            *[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"c{i}") for i in range(n)]
        )
        columns = [F.col(f"c{i}") for i in range(n)]
        rows = cells.withColumn("at", hilbert.curve_index(columns, bits)).orderBy("at").collect()
        assert [r["at"] for r in rows] == list(range(side**n))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    last = -1
    for s in sorted(by):
        run = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in run] == list(range(len(run)))
        for r in run:  # shards are runs of the curve
            assert r.curve >= last
            last = r.curve


def test_shards_are_runs_of_even_size(spark):
    for rows, shards, parts in ((hard_rows(), 16, 256), (hard_rows() * 9, 7, 2), (hard_rows()[:3], 16, 4)):
        docs = documents(spark, rows, clash=True).withColumn("slot", F.lit("x"))
        params = hilbert.CurveParams(shards=shards, parts=parts)
        dims = [hilbert.Dimension("source", "category"), hilbert.Dimension("lang", "category"), hilbert.Dimension("n_chars", "log")]
        got = hilbert.shard_rows(docs, dims, params)
        assert {"kept", "rid"} <= set(got.columns)
        check(got.collect(), len(rows), shards)


def test_equal_rows_are_split_evenly(spark):
    docs = documents(spark, [(1, "same", "en", "s", 4)] * 1000)
    got = hilbert.shard_rows(docs, [hilbert.Dimension("lang", "category")])
    check(got.collect(), 1000, 16)


def test_an_empty_table(spark):
    assert hilbert.shard_rows(documents(spark, []), [hilbert.Dimension("lang", "category")]).count() == 0


def test_query_columns(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10_hilbert_shards(spark, folder).collect()
    check(rows, len(texts), 16)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_ranges_and_files(spark, tmp_path):
    docs = documents(spark).where("doc_id is not null").drop("text")
    dims = [hilbert.Dimension("n_chars", "log")]
    sharded = hilbert.shard_rows(docs, dims, hilbert.CurveParams(shards=4))
    hilbert.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    ranges = sorted(hilbert.shard_ranges(sharded, dims).collect())
    assert sum(r.n_rows for r in ranges) == docs.count()


def test_another_layout_gives_the_same_shards(spark):
    rows = [(i, "x" * (i % 40), "en" if i % 3 else "de", f"s{i % 5}", i % 40) for i in range(600)]
    dims = [hilbert.Dimension("source", "category"), hilbert.Dimension("n_chars", "log")]
    results = []
    for docs in (documents(spark, rows).coalesce(1), documents(spark, rows[::-1]).repartition(9)):
        got = hilbert.shard_rows(docs, dims, hilbert.CurveParams(shards=7), ties=["doc_id"])
        results.append(sorted((r.doc_id, r.shard, r.slot) for r in got.collect()))
    assert results[0] == results[1]


def test_index_by_brute_force():
    """The curve of the quantised cells, by turning and flipping quadrants."""
    from pyspark.sql import SparkSession

    spark, bits = SparkSession.getActiveSession(), 3

    def walk(n):  # points of the two-dimensional curve in order
        if n == 0:
            return [(0, 0)]
        half, inner = 1 << (n - 1), walk(n - 1)
        return (
            [(y, x) for x, y in inner]
            + [(x, y + half) for x, y in inner]
            + [(x + half, y + half) for x, y in inner]
            + [(2 * half - 1 - y, half - 1 - x) for x, y in inner]
        )

    points = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x int, y int")
    index = {(r.x, r.y): r.i for r in points.select("x", "y", hilbert.curve_index([F.col("x"), F.col("y")], bits).alias("i")).collect()}
    order = sorted(index, key=index.get)
    turned = [[(y, x) for x, y in walk(bits)], walk(bits)]
    assert order in turned and sorted(index.values()) == list(range(64))
