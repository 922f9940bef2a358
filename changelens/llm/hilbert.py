"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a few bits each; rows are ordered by the
index of their cell on the Hilbert curve and the order is cut into runs.  Each
shard then covers a compact region in every dimension, so a reader that filters
on any of them opens few files.  Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changelens.llm.tables import cut, fresh


@dataclass(frozen=True)
class Dimension:
    """A column and how it is quantised.

    ``log``: whole numbers, two cells for each doubling.  ``category``: cells by
    hash, for values without an order.  Null is the first cell.
    """

    column: str
    kind: str


@dataclass(frozen=True)
class CurveParams:
    """``bits`` for each dimension; at most 15 bits in all, so that the cells
    of the curve are a small table."""

    bits: int = 5
    shards: int = 16
    #: Even parts that each cell is dealt to, so that no cell is one task's.
    parts: int = 256


def quantised(dim: Dimension, bits: int) -> Column:
    top = (1 << bits) - 1
    value = F.col(dim.column)
    if dim.kind == "log":
        code = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(1.0)))) + 1
    elif dim.kind == "category":
        code = F.pmod(F.xxhash64(value), F.lit(top)) + 1
    else:
        raise ValueError(f"unknown kind of dimension: {dim.kind}")
    return F.when(value.isNull(), F.lit(0)).otherwise(F.least(code, F.lit(top))).cast("int")


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` for each coordinate.

    Bit by bit from the top: where a coordinate's bit is unset, the lower bits
    of it and of the first coordinate change places; where it is set, the first
    one's are inverted.  The Gray code of what comes out, interleaved, is the
    index.
    """
    n = len(cells)

    def turned(x: Column, q: Column) -> Column:
        low, items = q - 1, [x[i] for i in range(n)]
        for i in range(n):
            is_set = items[i].bitwiseAND(q) != 0
            swap = items[0].bitwiseXOR(items[i]).bitwiseAND(low)
            first = items[0].bitwiseXOR(F.when(is_set, low).otherwise(swap))
            if i:
                items[i] = F.when(is_set, items[i]).otherwise(items[i].bitwiseXOR(swap))
            items[0] = first
        return F.array(*items)

    def interleaved(x: Column) -> Column:
        gray = [x[0]]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[i]))
        flip = F.lit(0)
        for b in range(bits - 1, 0, -1):
            is_set = F.shiftright(gray[-1], b).bitwiseAND(F.lit(1))
            flip = flip.bitwiseXOR(is_set * ((1 << b) - 1))
        index = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                index = index * 2 + F.shiftright(gray[i].bitwiseXOR(flip), b).bitwiseAND(F.lit(1))
        return index

    point = F.array(*[c.cast("int") for c in cells])
    masks = [1 << b for b in range(bits - 1, 0, -1)]
    if not masks:
        return interleaved(point)
    return F.aggregate(F.array(*[F.lit(q) for q in masks]), point, turned, interleaved)


def rank_by_cell(
    rows: DataFrame, cell: str, parts: int, order: Sequence[Column], rank: str, deal: Sequence[Column] | None = None
) -> DataFrame:
    """Adds the gapless global rank, from 0, in the order of ``cell``.

    Within a cell rows are dealt to ``parts`` by hash of ``deal`` (the order, if
    not given).  Counts of (cell, part)
    give each part its first rank; only the rows of one part meet in a task.
    ``cell`` must have a bounded number of values; rows need a unique ``order``.
    """
    cell_, part, n, before, start, local = fresh(rows, "rank_cell", "rank_part", "rank_n", "rank_before", "rank_start", "rank_local")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*(deal or order)), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(F.col(cell).alias(cell_), F.col(part).alias(part + "_")).agg(F.count("*").alias(n))
    by_cell = counts.groupBy(cell_).agg(F.sum(n).alias(n))
    # one row for each cell of the curve, 32,768 at most
    starts = by_cell.select(
        F.col(cell_).alias(cell_ + "0"),
        (F.sum(n).over(Window.orderBy(cell_).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)).alias(start),
    )
    within = Window.partitionBy(cell_).orderBy(part + "_").rowsBetween(Window.unboundedPreceding, 0)
    firsts = (
        counts.withColumn(before, F.sum(n).over(within) - F.col(n))
        .join(starts, F.col(cell_) == F.col(cell_ + "0"))
        .select(cell_, part + "_", (F.col(before) + F.col(start)).alias(start))
    )
    numbered = dealt.withColumn(local, F.row_number().over(Window.partitionBy(cell, part).orderBy(*order)) - 1)
    return (
        numbered.join(firsts, (F.col(cell) == F.col(cell_)) & (F.col(part) == F.col(part + "_")))
        .withColumn(rank, F.col(start) + F.col(local))
        .drop(cell_, part, part + "_", start, local)
    )


def shard_rows(
    rows: DataFrame, dims: Sequence[Dimension], params: CurveParams = CurveParams(), ties: Sequence[str] = ()
) -> DataFrame:
    """The rows and ``curve`` (int), ``shard`` (int), ``slot`` (long).

    Rows of one cell go by the columns of ``ties``, first of all the row's id,
    so that another layout of the table gives the same shards; rows that are
    alike in these, or have no id, go as they stand in the table.

    Shards are runs of the curve order whose row counts differ by one at most;
    slots count from 0 in each.  The rows are written to the shared folder
    once, so hand over only the columns that are wanted.

    Nulls in a dimension are a cell of their own.  Rows of one cell, repeated
    rows among them, may fall to several shards.  An empty table gives an empty
    one.  Columns named like the added ones are replaced.
    """
    if len(dims) * params.bits > 15:
        raise ValueError("at most 15 bits in all")
    rows = rows.drop("curve", "shard", "slot")
    uid, rank, total = fresh(rows, "row_uid", "row_rank", "row_total")
    cells = [quantised(d, params.bits) for d in dims]
    placed = cut(
        rows.withColumn("curve", curve_index(cells, params.bits)).withColumn(uid, F.monotonically_increasing_id()),
        "hilbert",
    )
    n = placed.agg(F.count("*").alias(total))
    order = [F.col(c) for c in (*ties, uid)]
    deal = [*order[:-1], F.when(order[0].isNull(), F.col(uid))] if ties else order
    ranked = rank_by_cell(placed, "curve", params.parts, order, rank, deal).crossJoin(F.broadcast(n))
    shards = F.lit(params.shards).cast("long")
    shard = F.call_function("div", F.col(rank) * shards, F.col(total))
    first = F.call_function("div", shard * F.col(total) + shards - 1, shards)
    return ranked.select(
        *rows.columns,
        F.col("curve").cast("int").alias("curve"),
        shard.cast("int").alias("shard"),
        (F.col(rank) - first).alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in curve order."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shard_ranges(sharded: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Rows and the smallest and largest value of each dimension, by shard."""
    stats = [f(d.column).alias(f"{name}_{d.column}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *stats)
