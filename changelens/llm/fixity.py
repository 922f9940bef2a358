"""Fixity audit of archive replicas by Merkle trees over offset ranges.

A record's leaf is the SHA-256 of its bytes.  Records are grouped by ordered
offset ranges, ranges by wider ranges, up to one root for each archive; a node
is the hash of what it covers, in order.  Two replicas are compared from the
roots down: only children of nodes that differ are looked at, until the damaged
records are found.  Nodes and records are thin tables in the shared folder, so
the payload is read once for each replica.  Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.llm.tables import cut


@dataclass(frozen=True)
class TreeParams:
    """Lowest ranges of ``leaf_bytes``; ``fanout`` ranges make the next."""

    leaf_bytes: int = 16 << 10
    fanout: int = 8


@dataclass(frozen=True)
class Tree:
    """``records``: archive, offset, digest.  ``levels``: from the lowest up,
    archive, node, hash, n (children) each; the last has one node an archive."""

    records: DataFrame
    levels: Sequence[DataFrame]


def warc_record(uri: Column, payload: Column) -> Column:
    """Bytes of a resource record; null is empty."""
    uri, body = F.coalesce(uri, F.lit("")), F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def lay_out(records: DataFrame, archive_col: str, order: Sequence[Column], record_col: str) -> DataFrame:
    """Adds ``offset``, the bytes of the archive's records before.

    An archive is one file, of bounded size, so its index (not its payload) is
    one task's.  ``order`` should be unique; equal rows are interchangeable.
    """
    before = Window.partitionBy(archive_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    index = records.withColumn("record_bytes", F.octet_length(record_col).cast("long")).drop(record_col)
    return index.withColumn("offset", F.coalesce(F.sum("record_bytes").over(before), F.lit(0).cast("long")))


def digest(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def build(records: DataFrame, depth: int, params: TreeParams = TreeParams()) -> Tree:
    """The tree of a replica's ``archive, offset, digest`` rows.

    Rows of a null archive or offset can't be placed and raise no error: they
    are left out.  Records of equal offset are hashed in the order of their
    digests.  A range holds at most ``leaf_bytes`` records of distinct offsets.
    """
    kept = cut(
        records.where(F.col("archive").isNotNull() & F.col("offset").isNotNull()).select("archive", "offset", "digest"),
        "fixity-records",
    )

    def node(rows: DataFrame, number: Column, place: str, value: str) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct(F.col(place), F.col(value))))
        text = F.array_join(
            F.transform(members, lambda m: F.concat_ws(":", m[place].cast("string"), m[value])), ","
        )
        return rows.groupBy("archive", number.alias("node")).agg(
            F.sha2(text, 256).alias("hash"), F.count("*").alias("n")
        )

    levels = [cut(node(kept, F.call_function("div", F.col("offset"), F.lit(params.leaf_bytes)), "offset", "digest"), "fixity-level")]
    for _ in range(depth - 1):
        up = node(levels[-1], F.call_function("div", F.col("node"), F.lit(params.fanout)), "node", "hash")
        levels.append(cut(up, "fixity-level"))
    return Tree(kept, levels)


def depth_of(replicas: Sequence[DataFrame], params: TreeParams = TreeParams()) -> int:
    """Levels that bring the longest archive of all replicas to one root."""
    last = max([r.agg(F.max("offset")).first()[0] or 0 for r in replicas], default=0)
    nodes, depth = last // params.leaf_bytes + 1, 1
    while nodes > 1:
        nodes, depth = -(-nodes // params.fanout), depth + 1
    return depth


def _differing(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks, with both values."""
    left = a.select(*keys, F.col(value).alias("value_a"))
    right = b.select(*keys, F.col(value).alias("value_b"))
    return left.join(right, list(keys), "full").where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def audit(a: DataFrame, b: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Damaged records of two replicas, ``archive, offset, path, kind,
    digest_a, digest_b``.

    Both have ``archive, offset, digest`` rows, offsets as in the index of the
    archive.  ``path`` are the nodes from the root down; ``kind`` is changed,
    missing (in b) or extra (in b).  Records of equal archive and offset are
    compared by their sorted digests, as one.  Equal replicas, two empty ones
    among them, give no row; an archive of one side alone gives all its records.
    """
    depth = depth_of([a, b], params)
    one, two = build(a, depth, params), build(b, depth, params)
    bad = _differing(one.levels[-1], two.levels[-1], ("archive", "node"), "hash").select(
        "archive", "node", F.col("node").cast("string").alias("path")
    )
    for level in range(depth - 2, -1, -1):
        parents = cut(bad, "fixity-bad").select(
            F.col("archive").alias("bad_archive"), F.col("node").alias("bad_node"), "path"
        )

        def below(rows: DataFrame) -> DataFrame:
            parent = F.call_function("div", F.col("node"), F.lit(params.fanout))
            return rows.join(
                parents.drop("path"), (F.col("archive") == F.col("bad_archive")) & (parent == F.col("bad_node")), "left_semi"
            )

        parent = F.call_function("div", F.col("node"), F.lit(params.fanout))
        differing = _differing(below(one.levels[level]), below(two.levels[level]), ("archive", "node"), "hash")
        bad = differing.join(
            parents, (F.col("archive") == F.col("bad_archive")) & (parent == F.col("bad_node"))
        ).select("archive", "node", F.concat_ws("/", "path", F.col("node").cast("string")).alias("path"))
    leaves = cut(bad, "fixity-bad").select(F.col("archive").alias("bad_archive"), F.col("node").alias("bad_node"), "path")
    number = F.call_function("div", F.col("offset"), F.lit(params.leaf_bytes))
    on = (F.col("archive") == F.col("bad_archive")) & (number == F.col("bad_node"))

    def at_offset(rows: DataFrame) -> DataFrame:
        found = rows.join(leaves.drop("path"), on, "left_semi")
        return found.groupBy("archive", "offset").agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest"))

    records = _differing(at_offset(one.records), at_offset(two.records), ("archive", "offset"), "digest")
    kind = (
        F.when(F.col("value_b").isNull(), "missing").when(F.col("value_a").isNull(), "extra").otherwise("changed")
    )
    return records.join(leaves, on).select(
        "archive",
        "offset",
        "path",
        kind.alias("kind"),
        F.col("value_a").alias("digest_a"),
        F.col("value_b").alias("digest_b"),
    )
