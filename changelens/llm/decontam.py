"""Benchmark decontamination by a broadcast hash set of word windows.

Windows of benchmark items are hashed; every window of the training texts is
looked up, a hit is verified by comparing the words themselves, and the words
inside it are marked.  A hash set above the size limit is sent in blocks of
that size, one pass over the texts for each, and the marks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changelens.llm.tables import cut, fresh, put_back, set_apart
from changelens.llm.words import LETTERED, Words, buffers, mixed, ranges, slices, words_of

_BASE = 0xC2B2AE3D27D4EB4F | 1
_BITS = 20


@dataclass(frozen=True)
class WindowParams:
    """``window`` words; a shorter item is one window.  ``block_bytes``: most
    bytes of windows that are sent to the executors at once."""

    window: int = 10
    block_bytes: int = 32 << 20


def window_hashes(words: Words, length: int) -> np.ndarray:
    """A hash for each window start; windows may run over a text's end."""
    n = len(words.hash) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    places = np.arange(n)
    return mixed(ranges(words.hash, places, places + length, _BASE))


#: Stands for a null item id until the items are handed out.
NO_ID = "\0"


def item_windows(benchmark: DataFrame, params: WindowParams, id_col: str, text_col: str) -> DataFrame:
    """``item`` (its id as a string), ``n`` words and ``words`` of each window."""
    most = params.window

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, texts = [], [], []
            ids = batch.column(0).to_pylist()
            for i, _, data, bounds in slices(batch.column(1)):
                words = words_of(data, bounds, LETTERED)
                for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                    n = min(most, b - a)
                    for k in range(a, b - n + 1 if n else a):
                        items.append(ids[i + d])
                        sizes.append(int(n))
                        texts.append(words.text(k, k + n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())],
                ["item", "n", "words"],
            )

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit(NO_ID)), F.col(text_col).cast("string"))
    return rows.mapInArrow(extract, "item string, n int, words binary").distinct()


class WindowSet:
    """Windows by length: hashes in a bit table and a dictionary of the words."""

    def __init__(self, rows: Sequence[tuple[str, int, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, list[bytes]] = {}
        for item, n, text in rows:
            text = bytes(text)
            if text not in self.items:
                by_length.setdefault(n, []).append(text)
            self.items.setdefault(text, []).append(item)
        self.tables: dict[int, np.ndarray] = {}
        for n, texts in by_length.items():
            data, bounds = buffers(pa.array([t.decode() for t in texts]))
            words = words_of(data, bounds, LETTERED)
            hashes = window_hashes(words, n)[words.first[:-1]]
            self.tables[n] = np.unique(hashes)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """``(first word, one past the last, items)`` of each window found."""
        doc = words.doc()
        for n, table in self.tables.items():
            hashes = window_hashes(words, n)
            if not len(hashes):
                continue
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[table >> np.uint64(64 - _BITS)] = True
            found = np.flatnonzero(bits[hashes >> np.uint64(64 - _BITS)])
            found = found[doc[found] == doc[found + n - 1]]
            place = np.minimum(np.searchsorted(table, hashes[found]), len(table) - 1)
            for k in found[table[place] == hashes[found]]:
                items = self.items.get(words.text(k, k + n))
                if items:
                    yield int(k), int(k) + n, items


def _runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    params: WindowParams = WindowParams(),
    carry: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``carry`` columns and ``n_words, n_hit`` (long), ``items`` (sorted
    ids, as strings, of the items met), ``spans`` (byte ranges ``[from, to)`` of
    the UTF-8 text, one after the other, that cover the hit words).

    Null and empty texts have no words; an empty benchmark hits nothing; the
    items of a null id are one, apart from those of an empty id, and it stands in
    ``items`` as an empty string; repeated rows are scanned alike.  ``carry``
    columns of the names above are dropped.
    """
    added = ("n_words", "n_hit", "items", "spans")
    carry = [c for c in carry if c not in added]
    windows = cut(item_windows(benchmark, params, item_col, item_text_col), "windows")
    total = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    blocks = max(1, -(-total // params.block_bytes))
    (text,) = fresh(docs.select(*carry), "scanned_text")
    rows = docs.select(
        *carry,
        F.col(text_col).cast("string").alias(text),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<bigint>").alias("spans"),
    )
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == block)
        if block:  # one block's windows at a time are in an executor's memory
            rows = cut(rows, "decontaminated")
        rows = _pass(rows, WindowSet([tuple(r) for r in part.select("item", "n", "words").collect()]), len(carry))
    named = F.transform("items", lambda x: F.when(x == NO_ID, "").otherwise(x))
    return rows.drop(text).withColumn("items", named)


def _pass(rows: DataFrame, windows: WindowSet, n_carry: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(windows)
    names = rows.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            old_items, old_spans = batch.column(n_carry + 3), batch.column(n_carry + 4)
            for i, j, data, bounds in slices(batch.column(n_carry)):
                words = words_of(data, bounds, LETTERED)
                doc = words.doc()
                edges = np.zeros(len(words.hash) + 1, dtype=np.int64)
                met: list[set[str]] = [set(old_items[d].as_py()) for d in range(i, j)]
                for a, b, who in known.hits(words):
                    edges[a] += 1
                    edges[b] -= 1
                    met[doc[a]].update(who)
                cover = np.cumsum(edges[:-1]) > 0
                for d in range(i, j):
                    old = old_spans[d].as_py()
                    lo = bounds[d - i]
                    own = slice(words.first[d - i], words.first[d - i + 1])
                    start, end, hit = words.start[own] - lo, words.end[own] - lo, cover[own]
                    for a, b in zip(old[0::2], old[1::2]):
                        hit |= (start >= a) & (end <= b)
                    first, last = _runs(hit)
                    n_words.append(len(hit))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(met[d - i]))
                    spans.append(np.stack([start[first], end[last - 1]], axis=1).ravel().tolist() if len(first) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: n_carry + 1],
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.int64())),
                ],
                names,
            )

    return rows.mapInArrow(mark, StructType(rows.schema.fields))


def drop_documents(docs: DataFrame, benchmark: DataFrame, params: WindowParams = WindowParams(), text_col: str = "text") -> DataFrame:
    """The rows without a hit, with their own columns."""
    apart, own = set_apart(docs)
    scanned = scan(apart, benchmark, params, own, own[docs.columns.index(text_col)])
    return put_back(scanned.where("n_hit = 0"), own, docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, params: WindowParams = WindowParams(), text_col: str = "text") -> DataFrame:
    """The rows with the hit words, and what stands between them, cut out."""
    apart, own = set_apart(docs)
    text = own[docs.columns.index(text_col)]
    scanned = scan(apart, benchmark, params, own, text)
    raw = F.col(text).cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans"), F.array(F.octet_length(text).cast("long")))
    kept = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(ends) / 2).cast("int") - 1),
        lambda i: F.substring(raw, ends[2 * i].cast("int") + 1, (ends[2 * i + 1] - ends[2 * i]).cast("int")),
    )
    joined = F.aggregate(kept, F.lit(b""), lambda a, x: F.concat(a, x)).cast("string")
    cleaned = scanned.withColumn(text, F.when(F.size("spans") > 0, joined).otherwise(F.col(text)))
    return put_back(cleaned, own, docs.columns)
