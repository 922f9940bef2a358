"""Best-fit-decreasing packing into id matrices.

In each block, pieces are taken by descending length; each goes to the open
sequence with the least room that still holds it, which a segment tree over the
remaining capacities finds, or opens a new one.  Documents over the capacity
are first cut into full sequences and a rest, so nothing is lost; no piece is
cut further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changelens.llm import tokens
from changelens.llm.tokens import CapacityTree, TokenParams

ROWS = (
    "sequence_id bigint, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, "
    "doc_ids array<bigint>, doc_starts array<bigint>"
)


def place(lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces of each sequence, in the order they were put there."""
    tree, open_ = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.tightest(n)
        if room < 0:
            room, best = capacity, len(bins)
            bins.append([])
        else:
            best = open_[room].pop()
            if not open_[room]:
                tree.put(room, tree.EMPTY)
        bins[best].append(i)
        if room > n:
            if not open_[room - n]:
                tree.put(room - n, (0, 0))
            open_[room - n].append(best)
    return bins


def pack(
    docs: DataFrame,
    params: TokenParams = TokenParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each sequence: ``sequence_id``, ``input_ids`` padded with the
    end id to the capacity, ``cu_seqlens`` (0 and the end of each piece),
    ``position_ids`` that begin anew at each piece (0 in the padding), and for
    each piece its document and the ids before it there.

    Null and empty texts are one end id; repeated rows are packed each; a null
    document id stays null; other columns are not read.  An empty table gives
    an empty one.  Sequence ids are unique, not gapless.
    """
    blocks = tokens.n_blocks(docs, text_col, params)
    capacity, end_id = params.capacity, params.end_id

    def pack_block(block: pa.Table) -> pa.Table:
        block = tokens.in_order(block)
        number = block["block"][0].as_py()
        lengths, ids = block["length"].to_pylist(), block["ids"].to_pylist()
        bins = place(lengths, capacity)
        rows = np.full((len(bins), capacity), end_id, dtype=np.int32)
        positions = np.zeros((len(bins), capacity), dtype=np.int32)
        places, ends = np.arange(capacity, dtype=np.int32), []
        for s, members in enumerate(bins):
            at = 0
            ends.append([0])
            for i in members:
                n = lengths[i]
                rows[s, at : at + n] = np.frombuffer(ids[i], dtype="<u4")
                positions[s, at : at + n] = places[:n]
                at += n
                ends[-1].append(at)
        members = [i for b in bins for i in b]
        bounds = pa.array(np.cumsum([0] + [len(b) for b in bins]), pa.int32())
        whole = pa.array(np.arange(0, len(bins) * capacity + 1, capacity), pa.int32())

        def lists(column: str) -> pa.Array:
            return pa.ListArray.from_arrays(bounds, block[column].take(members).combine_chunks())

        return pa.table(
            {
                "sequence_id": pa.array([(number << 32) + s for s in range(len(bins))], pa.int64()),
                "input_ids": pa.ListArray.from_arrays(whole, pa.array(rows.ravel())),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "position_ids": pa.ListArray.from_arrays(whole, pa.array(positions.ravel())),
                "doc_ids": lists("doc_id"),
                "doc_starts": lists("start"),
            }
        )

    cut = tokens.pieces(docs, params, blocks, keep_ids=True, id_col=id_col, text_col=text_col)
    return cut.groupBy("block").applyInArrow(pack_block, ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Files with the id matrix as one binary value (int32, little-endian) a
    row, beside the cumulative lengths and position resets."""

    def to_bytes(batches):
        for batch in batches:
            columns = [batch.column("sequence_id")]
            for name in ("input_ids", "cu_seqlens", "position_ids"):
                columns.append(pa.array([np.asarray(x.values, dtype="<i4").tobytes() for x in batch.column(name)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "input_ids", "cu_seqlens", "position_ids"])

    rows = packed.select("sequence_id", "input_ids", "cu_seqlens", "position_ids").mapInArrow(
        to_bytes, "sequence_id bigint, input_ids binary, cu_seqlens binary, position_ids binary"
    )
    rows.write.parquet(path)
