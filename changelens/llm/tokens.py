"""Token ids of whole texts, cut into pieces of at most one sequence.

The vocabulary is a file of the public tokenizers, in the form of ranks, which
encodes several times faster than the ``tokenizers`` library's form of it; the
ids are the same.  A text that the fast encoder gives up on goes to the slow
one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the only special token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}

PIECES = "doc_id bigint, start bigint, length int, ids binary, ids_crc32 bigint, doc_tokens bigint, block bigint"


@dataclass(frozen=True)
class TokenParams:
    """``vocabulary``: name of a tokenizer, without its ending.  ``end_id``
    follows each document.  A block of about ``block_bytes`` of text is packed
    by one task."""

    vocabulary: str = "byte_bpe_50k"
    end_id: int = 0
    capacity: int = 1024
    block_bytes: int = 4 << 20


@lru_cache(maxsize=2)
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def _slow(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def encode(text: str | None, params: TokenParams = TokenParams()) -> np.ndarray:
    """Ids (uint32) of a text with the end id; a null text is an empty one."""
    try:
        ids = _fast(params.vocabulary).encode(text or "", allowed_special="all")
    except BaseException as error:
        # the encoder's own panic isn't an Exception; anything else goes up
        if type(error).__name__ not in ("PanicException", "ValueError"):
            raise
        ids = _slow(params.vocabulary).encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = params.end_id
    return out


def n_blocks(docs: DataFrame, text_col: str, params: TokenParams) -> int:
    """Blocks for the bytes of all texts; a document counts some bytes itself."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 32)).first()[0]
    return max(1, -(-(total or 0) // params.block_bytes))


def pieces(docs: DataFrame, params: TokenParams, blocks: int, keep_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut into full sequences and a rest: rows of ``PIECES``.

    Each piece is dealt to a block by a digest of its document's id and length,
    its place and its ids, so a long document is spread over the blocks, and a
    piece's block doesn't depend on the layout of the table.  Pieces that are
    alike in all of these are told apart by their number in the task: rows that
    are repeated any number of times are spread too.  ``ids`` (little-endian,
    four bytes each) is null for full pieces unless ``keep_ids``.
    """
    capacity = params.capacity

    def block_of(key: tuple, seen: dict[bytes, int]) -> int:
        digest = hashlib.blake2b(repr(key).encode(), digest_size=8).digest()
        n = seen[digest] = seen.get(digest, -1) + 1
        if n:
            digest = hashlib.blake2b(digest + n.to_bytes(8, "little"), digest_size=8).digest()
        return int.from_bytes(digest, "little") % blocks

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py(), params)
                n = len(ids)
                for start in range(0, n, capacity):
                    part = ids[start : start + capacity].tobytes()
                    full = len(part) == 4 * capacity
                    crc = zlib.crc32(part)
                    block = block_of((doc_id, start, crc, n), seen)
                    rows.append((doc_id, start, len(part) // 4, part if keep_ids or not full else None, crc, n, block))
                if len(rows) >= 1024:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(cut_texts, PIECES)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("ids", pa.binary()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("block", pa.int64()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def in_order(block: pa.Table) -> pa.Table:
    """The pieces of a block in an order that no task layout changes."""
    return block.sort_by([(c, "ascending") for c in ("doc_id", "start", "doc_tokens", "ids_crc32")])


class CapacityTree:
    """Segment tree over remaining capacities 0 to ``capacity``.

    Each leaf holds the open bins of that capacity, each node the smallest key
    below it, so the best bin that has room is found in logarithmic time.
    """

    EMPTY = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.best = [self.EMPTY] * (2 * self.size)

    def put(self, room: int, key: tuple) -> None:
        """Sets the smallest key of the bins with this room."""
        best, node = self.best, room + self.size
        best[node] = key
        node >>= 1
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            small = left if left <= right else right
            if best[node] == small:
                break
            best[node] = small
            node >>= 1

    def lowest(self, least_room: int) -> tuple:
        """The smallest key among bins with at least that room."""
        best, found = self.best, self.EMPTY
        node, right = least_room + self.size, 2 * self.size
        while node < right:
            if node & 1:
                if best[node] < found:
                    found = best[node]
                node += 1
            if right & 1:
                right -= 1
                if best[right] < found:
                    found = best[right]
            node >>= 1
            right >>= 1
        return found

    def tightest(self, least_room: int) -> int:
        """The smallest room, of at least that much, that a bin has; else -1."""
        best, node, empty = self.best, least_room + self.size, self.EMPTY
        while best[node] == empty:
            while node & 1:
                node >>= 1
            if not node:
                return -1
            node += 1
        while node < self.size:
            node = 2 * node if best[2 * node] != empty else 2 * node + 1
        return node - self.size
