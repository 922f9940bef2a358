"""Near-duplicate documents: a Jaccard self-join of word shingles with adaptive
multi-match prefixes.

Shingles have one global order: by how many documents have them, rare ones
first, then by hash.  Two sets that are similar enough share a shingle among
the first few of each; longer prefixes guarantee more shared ones: with l
shingles more than the least, at least l.  Each document takes the l of lowest
estimated cost, candidates from its prefix times the work on them, so documents
with frequent shingles in their prefix ask for more matches.

1. Counts: hashes of all shingles, sorted and differenced, are summed by hash
   range.  Only the frequent ones are sent back, as many as a fixed limit; all
   others count as rare.  The order steers cost, never the result.
2. Classes: documents of equal sets are one class from here on.
3. Stars: each shared prefix shingle has a pivot, the class that has it
   earliest; each class is compared with the pivot it meets most often.
4. The rest: prefix shingles whose classes are already one component are done.
   For the others, pairs of different components that pass the size and
   position bounds and share enough prefix shingles are compared.

So a large group of near copies costs one comparison for each member, and no
pair that the order, the sizes and the positions allow is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.llm.components import components
from changelens.llm.tables import cut, drop_tables, fresh, lookup
from changelens.llm.words import SPACED, mixed, slices, words_of

_MULTIPLIER = 0xA0761D6478BD642F | 1
_MASK = (1 << 64) - 1

@dataclass(frozen=True)
class JoinParams:
    """Similarity of ``percent`` or more links two documents.

    ``frequent_limit``: most shingles whose counts are sent to the executors.
    ``most_matches``: largest number of shared prefix shingles to ask for.
    ``broadcast_rows``: most ids that are sent to the executors for a lookup;
    beyond, tables are shuffled.  ``token_classes``: classes of a shingle whose
    pairs are one task's; of more, the pairs are dealt to a square of tasks.
    """

    words: int = 5
    percent: int = 80
    frequent_limit: int = 1_000_000
    least_count: int = 8
    most_matches: int = 6
    broadcast_rows: int = 1_000_000
    token_classes: int = 1024


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, hashes, checks)``: each text's distinct shingles, sorted by
    hash; text d has those from ``first[d]`` to ``first[d + 1]``.  ``checks`` are
    a second, independent hash of each.

    A text of fewer words is one shingle of all of them; one without words has
    none.
    """
    words = words_of(data, bounds, SPACED)
    counts, doc = words.counts(), words.doc()
    factors = [pow(_MULTIPLIER, j + 1, 1 << 64) for j in range(k)]

    def combined(of: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(first), n, dtype=np.uint64)
        for j in range(n):
            total += of[first + j] * np.uint64(factors[j])
        return mixed(total)

    starts = np.arange(max(0, len(words.hash) - k + 1))
    starts = starts[doc[starts] == doc[starts + k - 1]] if len(starts) else starts
    groups = [(starts, k), *[(words.first[:-1][np.flatnonzero(counts == n)], n) for n in range(1, k)]]
    owner = [doc[starts], *[np.flatnonzero(counts == n) for n in range(1, k)]]
    all_hashes = np.concatenate([combined(words.hash, first, n) for first, n in groups])
    all_checks = np.concatenate([combined(words.check, first, n) for first, n in groups])
    all_docs = np.concatenate(owner)
    order = np.argsort(all_hashes)
    n_docs = len(bounds) - 1
    small = all_docs[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64)
    order = order[np.argsort(small, kind="stable")]
    h, d = all_hashes[order], all_docs[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.searchsorted(d[new], np.arange(n_docs + 1)), h[new], all_checks[order][new]


def set_digests(first: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> list[bytes]:
    """A digest of each text's set, over both hashes of its shingles."""
    return [
        hashlib.md5(hashes[a:b].tobytes() + checks[a:b].tobytes()).digest() for a, b in zip(first[:-1], first[1:])
    ]


def _counted(texts: DataFrame, params: JoinParams) -> DataFrame:
    """``key, n``: top halves of shingle hashes, and in how many texts they are,
    for those in ``least_count`` texts or more.

    Ranges of keys, some for each shuffle partition, are summed by one task
    each, which holds the distinct keys of its ranges and a buffer.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(6, (8 * partitions - 1).bit_length()))
    shift = 32 - bits

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [
                (shingles(data, bounds, params.words)[1] >> np.uint64(32)).astype(np.uint32)
                for _, _, data, bounds in slices(batch.column(0))
            ]
            keys = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint32)
            edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(shift))
            bucket, narrow, blob = [], [], []
            for b in np.flatnonzero(np.diff(edges)):
                steps = np.diff(keys[edges[b] : edges[b + 1]], prepend=np.uint32(int(b) << shift))
                small = bool(steps.max() < 1 << 16)
                bucket.append(int(b))
                narrow.append(small)
                blob.append(steps.astype("<u2" if small else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(narrow, pa.bool_()), pa.array(blob, pa.binary())],
                ["bucket", "narrow", "steps"],
            )

    def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        return key[first], np.add.reduceat(count, first) if len(first) else count

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, base = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0, 0
        for batch in batches:
            for b, small, steps in zip(*(batch.column(c) for c in range(3))):
                values = np.frombuffer(steps.as_buffer(), "<u2" if small.as_py() else "<u4").astype(np.uint32)
                keys.append(np.cumsum(values, dtype=np.uint32) + np.uint32(b.as_py() << shift))
                counts.append(np.ones(len(values), np.int64))
                held += len(values)
                if held > max(1 << 21, base):  # at most as much again as the distinct keys so far
                    key, count = merged(keys, counts)
                    keys, counts, held, base = [key], [count], 0, len(key)
        key, count = merged(keys, counts)
        often = count >= params.least_count
        key, count = key[often], count[often]
        for i in range(0, len(key), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[part].astype(np.int64)), pa.array(count[part])], ["key", "n"])

    blobs = texts.mapInArrow(keys_of, "bucket int, narrow boolean, steps binary")
    return blobs.repartition("bucket").mapInArrow(total, "key bigint, n bigint")


def frequent(texts: DataFrame, params: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and counts of the most frequent shingles: all above the
    lowest power of two that leaves no more than the limit."""
    used: list[str] = []
    counts = cut(_counted(texts, params), "shingle-counts", used)
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect()
    room, least = params.frequent_limit, 64
    for size, n in sorted(((r["size"], r["count"]) for r in by_size), reverse=True):
        if n > room:
            break
        room, least = room - n, size
    table = counts.where(F.col("n") >= F.lit(1 << least).cast("long")).toArrow() if least < 63 else None
    drop_tables(texts.sparkSession, used)
    if table is None:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    key, n = table["key"].to_numpy().astype(np.uint32), table["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def required(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def matches_to_ask(counts: np.ndarray, n: int, percent: int, most: int) -> int:
    """The l whose prefix has the lowest estimated cost.

    ``counts`` are those of the set's shingles in the global order, 0 for rare
    ones.  Looking up a prefix costs the sum of its counts; at most that sum
    over l candidates share l shingles, and each costs n to compare.
    """
    need = required(n, percent)
    levels = np.arange(1, min(most, need) + 1)
    sums = np.cumsum(counts[: n - need + len(levels)], dtype=np.float64)[n - need :]
    return int(levels[np.argmin(sums + n * sums / levels)])


def described(rows: DataFrame, params: JoinParams) -> DataFrame:
    """``rid, doc_id, text_key, n, digest, ask, prefix``: a document's set size,
    a digest of its set, the matches it asks for and its prefix."""
    keys, counts = frequent(rows.select("text"), params)
    sent = rows.sparkSession.sparkContext.broadcast((keys, counts))
    percent, most = params.percent, params.most_matches

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = sent.value
        for batch in batches:
            for i, j, data, bounds in slices(batch.column(2)):
                n_list, asks, sizes, prefixes = [], [], [], []
                first, h, checks = shingles(data, bounds, params.words)
                digests = set_digests(first, h, checks)
                often = np.zeros(len(h), dtype=np.int64)
                if len(key):
                    short = (h >> np.uint64(32)).astype(np.uint32)
                    place = np.minimum(np.searchsorted(key, short), len(key) - 1)
                    often = np.where(key[place] == short, count[place], 0)
                for a, b in zip(first[:-1], first[1:]):
                    n, own, seen = int(b - a), h[a:b], often[a:b]
                    n_list.append(n)
                    if not n:
                        asks.append(0)
                        sizes.append(0)
                        continue
                    if seen.any():
                        order = np.argsort(seen, kind="stable")
                        own, seen = own[order], seen[order]
                    need = required(n, percent)
                    ask = matches_to_ask(seen, n, percent, most) if seen[: n - need + most].any() else 1
                    asks.append(ask)
                    sizes.append(n - need + ask)
                    prefixes.append(own[: n - need + ask])
                flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        batch.column(3).slice(i, j - i),
                        pa.array(n_list, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(asks, pa.int32()),
                        pa.ListArray.from_arrays(ends, pa.array(flat)),
                    ],
                    ["rid", "doc_id", "text_key", "n", "digest", "ask", "prefix"],
                )

    return rows.mapInArrow(
        describe,
        "rid bigint, doc_id bigint, text_key binary, n bigint, digest binary, ask int, prefix array<bigint>",
    )


def _overlap_needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """Least size of the intersection of two linked sets."""
    return F.ceil(percent * (n_a + n_b) / F.lit(100 + percent))


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, params: JoinParams) -> DataFrame:
    """Those of the pairs ``a, b`` (class numbers) whose sets are linked."""
    used: list[str] = []
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    reps = cut(
        classes.join(wanted, "cls", "left_semi").select(
            "cls", F.col("rid").alias("rep_rid"), F.col("digest").alias("rep_digest")
        ),
        "candidates",
        used,
    )
    small = reps.count() <= params.broadcast_rows
    ids = reps.select("rep_rid").distinct()
    texts = rows.join(F.broadcast(ids) if small else ids, F.col("rid") == F.col("rep_rid"), "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch.column(1)):
                first, h, checks = shingles(data, bounds, params.words)
                ends = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(set_digests(first, h, checks), pa.binary()),
                        # candidates met by one hash; the other one has to agree
                        pa.ListArray.from_arrays(ends, pa.array(checks.view(np.int64))),
                    ],
                    ["rid", "digest", "members"],
                )

    sets = (
        texts.select("rid", "text")
        .mapInArrow(sets_of, "rid bigint, digest binary, members array<bigint>")
        .join(
            F.broadcast(reps) if small else reps,
            (F.col("rid") == F.col("rep_rid")) & (F.col("digest") == F.col("rep_digest")),
        )
        .groupBy("cls")
        .agg(F.first("members").alias("members"))
    )
    sets = cut(sets, "shingle-sets", used)
    both = (
        pairs.select("a", "b")
        .join(sets.select(F.col("cls").alias("a"), F.col("members").alias("set_a")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("members").alias("set_b")), "b")
        .select("a", "b", (F.size("set_a") + F.size("set_b")).alias("both"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    )
    linked = both.where(100 * F.col("common") >= params.percent * (F.col("both") - F.col("common"))).select("a", "b")
    linked = cut(linked, "verified")
    drop_tables(rows.sparkSession, used)
    return linked


def _entries(classes: DataFrame, params: JoinParams) -> DataFrame:
    """Prefix shingles that two classes or more have: ``token, cls, n, ask,
    pos, before``, and the token's pivot with its size and position.

    ``before`` counts such shingles earlier in the prefix: of the others there,
    no class that shares this one has any.
    """
    all_ = classes.select("cls", "n", "ask", F.posexplode("prefix").alias("pos", "token"))
    shared = (
        all_.groupBy(F.col("token").alias("shared"))
        .agg(F.count("*").alias("n_classes"), F.min(F.struct("pos", "cls", "n")).alias("pivot"))
        .where("n_classes > 1")
        .select("shared", "pivot")
    )
    joined = all_.join(shared, F.col("token") == F.col("shared"))
    earlier = Window.partitionBy("cls").orderBy("pos")
    return joined.select(
        "token", "cls", "n", "ask", "pos", (F.row_number().over(earlier) - 1).alias("before"), "pivot"
    )


def dealt_pairs(entries: DataFrame, keys: list[str], params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of a table's classes with each other, by ``keys``.

    The table has ``n_classes``, the classes of its ``token``.  The pairs of a
    token of many are a square that is cut into tiles: a class stands in one row
    of tiles on the left and in one column of them on the right, so each ordered
    pair meets in one tile, and a tile's rows grow with the square root.
    """
    side = F.ceil(F.sqrt(F.col("n_classes") / F.lit(params.token_classes))).cast("int")
    whole = entries.withColumn("tile_side", side)
    own = F.pmod(F.xxhash64("cls"), F.col("tile_side")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("tile_side") - 1))
    x = whole.select("token", own.alias("tile_row"), every.alias("tile_column"), *[F.col(c).alias(f"{c}_a") for c in keys])
    y = whole.select("token", every.alias("tile_row"), own.alias("tile_column"), *[F.col(c).alias(f"{c}_b") for c in keys])
    return x, y


def _rest(entries: DataFrame, labels: DataFrame, params: JoinParams, used: list[str]) -> DataFrame:
    """Pairs ``a, b`` of different components that may still be linked.

    What two sets share is at most what was shared before a common shingle and
    what is left from there on in the shorter one.  Of the matches that are
    asked for, each has at most one fewer than that before it, and no more than
    the shared shingles before it in either prefix.
    """
    tagged = (
        entries.select("token", "cls", "n", "ask", "pos", "before")
        .join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    tagged = cut(tagged, "prefix-entries", used)
    mixed_ = tagged.groupBy(F.col("token").alias("mixed")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_classes")
    ).where("low != high").select("mixed", "n_classes")
    left = tagged.join(mixed_, F.col("token") == F.col("mixed"))
    x, y = dealt_pairs(left, ["cls", "n", "ask", "pos", "before", "component"], params)
    asked = F.least("ask_a", "ask_b")
    needed = _overlap_needed(F.col("n_a"), F.col("n_b"), params.percent)
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))

    def within(side: str) -> Column:
        """The shingle is in the prefix that belongs to the number asked for."""
        n = F.col(f"n_{side}")
        return F.col(f"pos_{side}") < n - F.ceil(params.percent * n / F.lit(100)) + asked

    tile = ["token", "tile_row", "tile_column"]
    y = y.withColumnsRenamed({c: f"{c}_b" for c in tile})
    together = (F.col(c) == F.col(f"{c}_b") for c in tile)
    met = x.join(
        y,
        reduce(and_, together)
        & (F.col("cls_a") < F.col("cls_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (100 * F.least("n_a", "n_b") >= params.percent * F.greatest("n_a", "n_b"))
        & (room + F.least("before_a", "before_b", asked - 1) >= needed)
        & within("a")
        & within("b"),
    )
    return (
        met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        .agg(F.count("*").alias("met"), F.first(asked).alias("asked"), F.max(room - needed).alias("slack"))
        .where("met >= asked and slack >= 0")
        .select("a", "b")
    )


def _rid(id_col: str, text_col: str) -> Column:
    """The id, or a hash of the text if null."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def with_rid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, doc_id, text, text_key``; an id may have several texts, so ``rid``
    and ``text_key`` together tell which rows are alike."""
    return docs.select(
        _rid(id_col, text_col).alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        _text_key(text_col).alias("text_key"),
    )


def near_duplicates(
    docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``rid, doc_id, text_key, n_shingles, component_id, stays`` for each document.

    ``component_id`` is the smallest document id reachable by links.  Null and
    empty texts have no shingles and stay alone; documents of fewer words than
    a shingle link to those of the same words.  Repeated rows are linked and
    give a row each.  A null document id stays null, takes part, and gives its
    id to no component; a component of null ids alone has a null one.  Rows of
    one id with different texts are documents of their own.  ``stays`` marks one
    ``rid, text_key`` of each component, by the smallest id, null ids last, and
    all without shingles.  Other columns are not read; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    rows = with_rid(docs, id_col, text_col)
    members = cut(described(rows, params), "described")
    used: list[str] = []
    early: list[str] = []
    classes = (
        members.where("n > 0")
        .groupBy("digest")
        .agg(
            F.min("rid").alias("rid"),
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "rid", "text_key")).alias("least"),
            F.first("n").alias("n"),
            F.first("ask").alias("ask"),
            F.first("prefix").alias("prefix"),
        )
    )
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes", used)
    entries = cut(_entries(classes, params), "shared-prefixes", early)

    pivot_n, pivot_pos = F.col("pivot.n"), F.col("pivot.pos")
    slack = F.least(F.col("n") - F.col("pos"), pivot_n - pivot_pos) - _overlap_needed(F.col("n"), pivot_n, params.percent)
    stars = (
        entries.where(
            (F.col("cls") != F.col("pivot.cls"))
            & (100 * F.least(F.col("n"), pivot_n) >= params.percent * F.greatest(F.col("n"), pivot_n))
        )
        .groupBy(F.col("cls").alias("a"), F.col("pivot.cls").alias("b"))
        .agg(F.count("*").alias("met"), F.max(slack).alias("slack"))
        .where("slack >= 0")
        .groupBy("a")
        .agg(F.max(F.struct("met", "b")).alias("best"))
        .select("a", F.col("best.b").alias("b"))
    )
    star_links = verified(cut(stars, "stars", early), classes, rows, params)
    labels = components(star_links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rest = cut(_rest(entries, labels, params, early), "rest", used)
    drop_tables(spark, early)
    links = star_links.unionByName(verified(rest, classes, rows, params))
    final = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.select("cls", "digest", "doc_id", "least").join(
        final.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    named = cut(named, "labelled")
    drop_tables(spark, used)
    ids = cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("least").alias("stay")), "components")
    # a component may have most of the classes
    by_digest = lookup(named.select("cls", "digest", "component"), ids, ["component"], spread="cls").select(
        F.col("digest").alias("cls_digest"), "component_id", "stay"
    )
    return members.join(
        by_digest, (F.col("digest") == F.col("cls_digest")) & (F.col("n") > 0), "left"
    ).select(
        "rid",
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | ((F.col("rid") == F.col("stay.rid")) & (F.col("text_key") == F.col("stay.text_key")))).alias("stays"),
    )


def keep_one(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near copies: of each component the document of the
    smallest id stays, of rows with that id and text the first; documents
    without shingles all stay.  In a component of null ids one document stays.
    Rows of one id whose texts are not linked all stay.
    """
    found = cut(near_duplicates(docs, params, id_col, text_col), "near-duplicates")
    rid, text_key, gone_rid, gone_key = fresh(docs, "own_rid", "own_text_key", "gone_rid", "gone_text_key")
    # an id may have several texts, and a null id has none: the text decides with it
    whole = found.where("n_shingles > 0").select(F.col("rid").alias(gone_rid), F.col("text_key").alias(gone_key), "stays")
    gone = cut(whole.where(~F.col("stays")).select(gone_rid, gone_key).distinct(), "gone")
    again = cut(
        whole.where("stays").groupBy(gone_rid, gone_key).count().where("count > 1").drop("count"),
        "again",
    )
    if gone.count() <= params.broadcast_rows:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(rid, _rid(id_col, text_col)).withColumn(text_key, _text_key(text_col))
    same = (F.col(rid) == F.col(gone_rid)) & (F.col(text_key) == F.col(gone_key))
    kept = keyed.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept.drop(rid, text_key)
    # equal rows: one of them
    once = kept.join(again, same, "left_anti")
    several = kept.join(again, same, "left_semi").dropDuplicates([rid, text_key])
    return once.unionByName(several).drop(rid, text_key)
