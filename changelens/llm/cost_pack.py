"""Packing documents into sequences of even cost.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays
within a document.  In each block, pieces are taken by descending cost; each
goes to the sequence of lowest cost that has room for it.  Blocks have just as
many sequences as their tokens fill, so next to nothing is padded; a piece that
no sequence has room for is cut to fill the roomiest ones.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from changelens.llm import tokens
from changelens.llm.tokens import CapacityTree, TokenParams

PACKED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, cost double"
)


@dataclass(frozen=True)
class CostParams:
    """Cost of a piece; by default attention over a full sequence costs as much
    as the linear work on it."""

    linear: float = 1.0
    quadratic: float = 1.0 / 1024


class Sequences:
    """Open sequences of one block: the cheapest with room, the roomiest."""

    def __init__(self, n: int, capacity: int):
        self.capacity = capacity
        self.cost = [0.0] * n
        self.used = [0] * n
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.heaps[capacity] = [(0.0, s) for s in range(n)]
        self.tree = CapacityTree(capacity)
        if n:
            self.tree.put(capacity, self.heaps[capacity][0])

    def cheapest(self, length: int) -> int:
        return self.tree.lowest(length)[1]

    def roomiest(self) -> int:
        """The cheapest of those with the most room left."""
        node, best, empty = 1, self.tree.best, self.tree.EMPTY
        while node < self.tree.size:
            node = 2 * node + 1 if best[2 * node + 1] != empty else 2 * node
        return best[node][1]

    def room(self, sequence: int) -> int:
        return self.capacity - self.used[sequence]

    def add(self, sequence: int, length: int, cost: float) -> int:
        """Appends a piece and returns its offset.  The sequence must stand at
        the top of its heap, as those that the searches return do."""
        offset = self.used[sequence]
        room = self.capacity - offset
        heapq.heappop(self.heaps[room])
        self._show(room)
        self.cost[sequence] += cost
        self.used[sequence] += length
        if room > length:
            heapq.heappush(self.heaps[room - length], (self.cost[sequence], sequence))
            self._show(room - length)
        return offset

    def _show(self, room: int) -> None:
        heap = self.heaps[room]
        self.tree.put(room, heap[0] if heap else self.tree.EMPTY)


def place(lengths: list[int], capacity: int, costs: CostParams) -> list[tuple[int, int, int, int, int]]:
    """``(piece, from, length, sequence, offset)`` for pieces up to ``capacity``.

    Deterministic: ties go by the order of the pieces and of the sequences.
    """
    def cost(n: int) -> float:
        return costs.linear * n + costs.quadratic * n * n

    full = [i for i, n in enumerate(lengths) if n == capacity]
    out = [(i, 0, capacity, s, 0) for s, i in enumerate(full)]
    rest = sorted((i for i, n in enumerate(lengths) if 0 < n < capacity), key=lambda i: (-lengths[i], i))
    total = sum(lengths[i] for i in rest)
    open_ = Sequences(-(-total // capacity), capacity)
    first = len(full)
    for i in rest:
        begin, left = 0, lengths[i]
        while left:
            sequence, n = open_.cheapest(left), left
            if sequence < 0:
                sequence = open_.roomiest()
                n = open_.room(sequence)
            out.append((i, begin, n, first + sequence, open_.add(sequence, n, cost(n))))
            begin, left = begin + n, left - n
    return out


def pack(
    docs: DataFrame,
    params: TokenParams = TokenParams(),
    costs: CostParams = CostParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, cost``.

    ``start`` counts the ids of the document before the piece, ``offset`` those
    of the sequence.  Each id, the end id included, lies in one piece.  Null
    and empty texts are one end id; repeated rows are packed each; a null
    document id stays null; other columns are not read.  An empty table gives
    an empty one.  Sequence ids are unique, not gapless.
    """
    blocks = tokens.n_blocks(docs, text_col, params)
    capacity = params.capacity

    def pack_block(block: pa.Table) -> pa.Table:
        block = tokens.in_order(block)
        number = block["block"][0].as_py()
        lengths, crcs, ids = block["length"].to_pylist(), block["ids_crc32"].to_pylist(), block["ids"]
        piece, begin, length, sequence, offset = (list(c) for c in zip(*place(lengths, capacity, costs)))
        columns = {
            "doc_id": block["doc_id"].take(piece),
            "start": pa.array(block["start"].to_numpy()[piece] + begin, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(
                [
                    crcs[i] if n == lengths[i] else zlib.crc32(ids[i].as_buffer()[4 * b : 4 * (b + n)])
                    for i, b, n in zip(piece, begin, length)
                ],
                pa.int64(),
            ),
            "doc_tokens": block["doc_tokens"].take(piece),
            "sequence_id": pa.array([(number << 32) + s for s in sequence], pa.int64()),
            "offset": pa.array(offset, pa.int64()),
            "cost": pa.array([costs.linear * n + costs.quadratic * n * n for n in length], pa.float64()),
        }
        return pa.table(columns)

    cut = tokens.pieces(docs, params, blocks, keep_ids=False, id_col=id_col, text_col=text_col)
    return cut.groupBy("block").applyInArrow(pack_block, PACKED)
