import hashlib
import random

from changelens.llm import fixity, queries
from pyspark.sql import functions as F

from tests.llm.cases import plain

SCHEMA = "archive long, offset long, digest string"


def replica(rng, archives=3, n=60):
    rows = []
    for a in range(archives):
        offset = 0
        for _ in range(n if a else 1):
            rows.append((a, offset, hashlib.sha256(str(rng.random()).encode()).hexdigest()))
            offset += rng.randrange(1, 3000)
    return rows


def damaged(rows, rng):
    out = []
    for a, o, d in rows:
        x = rng.random()
        if x < 0.03:
            continue
        out.append((a, o, d if x > 0.08 else "damaged" + d[7:]))
    return out + [(1, 77777777, "f" * 64), (9, 0, "e" * 64)]


def brute(a, b):
    left, right = {}, {}
    for side, rows in ((left, a), (right, b)):
        for archive, offset, d in rows:
            side.setdefault((archive, offset), []).append(d)
    out = []
    for key in {*left, *right}:
        x, y = (",".join(sorted(s[key])) if key in s else None for s in (left, right))
        if x != y:
            out.append((*key, "missing" if y is None else "extra" if x is None else "changed", x, y))
    return plain(out)


def test_damage_is_located(spark):
    rng = random.Random(3)
    a = replica(rng)
    b = damaged(a, rng)
    a, b = a + [a[5]], b + [b[7], b[7]]  # repeated rows
    for params in (fixity.TreeParams(), fixity.TreeParams(leaf_bytes=64, fanout=2)):
        found = fixity.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), params).collect()
        assert plain([(r.archive, r.offset, r.kind, r.digest_a, r.digest_b) for r in found]) == brute(a, b)
        for r in found:
            path = [int(x) for x in r.path.split("/")]
            assert path[0] == 0 and path[-1] == r.offset // params.leaf_bytes
            assert all(y // params.fanout == x for x, y in zip(path, path[1:]))


def test_equal_empty_and_null(spark):
    a = spark.createDataFrame(replica(random.Random(4)), SCHEMA)
    none = a.where("false")
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(none, none).count() == 0
    assert fixity.audit(a, none).count() == a.count()
    nulls = spark.createDataFrame([(None, 1, "x"), (1, None, "y")], SCHEMA)
    assert fixity.audit(a, a.unionByName(nulls)).count() == 0


def test_a_root_is_made_of_all_below(spark):
    rng = random.Random(8)
    rows = replica(rng, 2, 30)
    params = fixity.TreeParams(leaf_bytes=512, fanout=3)
    df = spark.createDataFrame(rows, SCHEMA)
    tree = fixity.build(df, fixity.depth_of([df], params), params)
    nodes = {}
    for a, o, d in rows:
        nodes.setdefault((a, o // 512), []).append((o, d))
    hashed = lambda members: hashlib.sha256(",".join(f"{p}:{h}" for p, h in sorted(members)).encode()).hexdigest()
    for level in tree.levels:
        level_hash = {k: hashed(v) for k, v in nodes.items()}
        assert {(r.archive, r.node): r.hash for r in level.collect()} == level_hash
        nodes = {}
        for (a, n), h in level_hash.items():
            nodes.setdefault((a, n // 3), []).append((n, h))
    assert {r.node for r in tree.levels[-1].collect()} == {0}


def test_records_and_layout(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "ü"), (2, None, None), (3, "u", ""), (None, "n", "x"), (3, "u", "")],
        "page_id long, url string, html string",
    )
    record = fixity.warc_record(F.col("url"), F.col("html"))
    rows = pages.withColumn("record", record).withColumn("archive", F.lit(1))
    first = rows.where("page_id = 1").first().record
    assert bytes(first) == b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a/\r\nContent-Length: 2\r\n\r\n\xc3\xbc\r\n\r\n"
    laid = fixity.lay_out(rows, "archive", [F.col("page_id"), F.col("url")], "record").collect()
    at = 0
    for r in sorted(laid, key=lambda r: r.offset):
        assert r.offset == at
        at += r.record_bytes
    a, b = queries.damaged_replicas(pages)
    fixity.audit(a, b).collect()


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    many = pages
    for i in range(1, 12):
        many = many.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000 * i))
    a, b = queries.damaged_replicas(many)
    got = [(r.archive, r.offset, r.kind, r.digest_a, r.digest_b) for r in fixity.audit(a, b).collect()]
    assert plain(got) == brute([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()])
    assert {r[2] for r in got} >= {"missing", "changed"} or len(got) > 2
