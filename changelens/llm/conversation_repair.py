"""Conversations brought into legal turn order by cheapest edits.

A legal conversation has the role initials ``(s?(ua)+)?``.  Rows are kept (0),
given the role user or assistant (2) or deleted (3), and rows without text are
inserted (2); a truncated row that stays costs 1 more, and blank and duplicate
rows have to go.  Four states say what may follow, so the dynamic programme is a
row's step on a vector of four costs, and the role that an edit gives is the one
that its state calls for: the edits' initials tell the whole repair.

Square-root checkpoints: rows in order are cut into blocks of about the root of
the longest conversation.  A block's steps make one four-by-four matrix; going
back over a conversation's matrices gives the cost vectors at the checkpoints,
the only ones that are stored.  Each block then works out its own vectors again,
walks forward along the ASCII-least tight edits from each state it may begin in,
and the ends of these walks tell where each block begins.  Blocks are rows of a
table, so a conversation of any length is spread over the cluster; what meets
for one conversation is a matrix and four states for each block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from changelens.llm.tables import cut, drop_tables

#: Costs of the edits.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant.  The state
#: that a user or assistant row leads to, whichever may follow.
_AFTER = (2, 2, 3, 2)
_FAR = 1 << 60
#: Cost of ending in a state: what has to be inserted yet.
_END = (0, 2 * INSERT, INSERT, 0)

#: Codes of rows: the initial, in capitals if truncated, a digit if it has to go.
_CODES = "suaoSUAO0123"
_SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class RepairParams:
    """``least_block``: rows of a block at least; longer conversations have
    blocks of about the root of their length, rounded up to a power of two."""

    least_block: int = 64


def _kept_state(code: str) -> tuple[int, int, int, int]:
    """For each state the one after the row is kept, -1 where it may not be."""
    return {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}.get(code.lower(), (-1,) * 4)


_KEPT = {code: _kept_state(code) for code in _CODES}


def _back(code: str, v: tuple) -> tuple:
    """Costs before a row from those after it."""
    if code.isdigit():
        b0, b1, b2, b3 = (DELETE + x for x in v)
    else:
        extra = TRUNCATED if code.isupper() else 0
        kept = _KEPT[code]
        to = [
            min(DELETE + v[s], RETYPE + extra + v[_AFTER[s]], extra + v[kept[s]] if kept[s] >= 0 else _FAR) for s in range(4)
        ]
        b0, b1, b2, b3 = to
    w2, w3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + w2), min(b1, INSERT + w2), w2, w3


@lru_cache(maxsize=1 << 14)
def block_matrix(codes: str) -> tuple[int, ...]:
    """Cheapest cost of a block from each state to each, row by row."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else _FAR for s in range(4))
        for code in reversed(codes):
            v = _back(code, v)
        columns.append(v)
    return tuple(min(columns[end][s], _FAR) for s in range(4) for end in range(4))


@lru_cache(maxsize=1 << 14)
def walk(codes: str, after: tuple[int, ...], last: bool) -> tuple[tuple[int, str, str], ...]:
    """``(end, audit, rows)`` from each state: the ASCII-least tight edits, and
    for each row what comes of it.  Of a row, ``u`` and ``a`` are rows inserted
    before it (behind the last one: after it), ``K`` is the row kept, ``U`` and
    ``A`` the row with that role; rows are parted by a bar."""
    vectors = [after]
    for code in reversed(codes):
        vectors.append(_back(code, vectors[-1]))
    vectors.reverse()
    walks = []
    for state in range(4):
        audit: list[str] = []
        rows: list[str] = []
        for i, code in enumerate(codes):
            now, then = vectors[i], vectors[i + 1]
            out = ""
            extra = TRUNCATED if code.isupper() else 0
            while True:
                cost = now[state]
                if DELETE + then[state] == cost:
                    audit.append("D")
                    break
                to = _AFTER[state]
                if INSERT + now[to] == cost:
                    audit.append("I")
                    out += "ua"[to - 2]
                    state = to
                    continue
                kept = _KEPT[code][state] if not code.isdigit() else -1
                if kept >= 0 and extra + then[kept] == cost:
                    audit.append("K")
                    out, state = out + "K", kept
                else:
                    audit.append("R")
                    out, state = out + "UA"[to - 2], to
                break
            rows.append(out)
        while last and rows and _END[state]:
            state = _AFTER[state]
            audit.append("I")
            rows[-1] += "ua"[state - 2]
        walks.append((state, "".join(audit), "|".join(rows)))
    return tuple(walks)


def row_faults(role: Column, text: Column) -> dict[str, Column]:
    """What a row alone tells: its initial and whether it is blank or truncated."""
    first = F.substring(role, 1, 1)
    return {
        "initial": F.when(first.isin("s", "u", "a"), first).otherwise("o"),
        "blank": ~text.rlike(r"[^\x20\x09-\x0D]"),
        "cut_off": ~text.rlike(r"[.!?]" + _SPACE + r"*\z"),
    }


def in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``place, conv, turn, role, text, digest`` and faults: ``place`` grows by
    conversation and turn, nulls first, then by role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    named = rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).select(
        "*",
        # a role's length parts it from the text
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("arrival"),
    )
    # arrival spreads rows that are alike in all else; their order makes no difference
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "arrival"]
    faults = row_faults(F.col("role"), F.col("text"))
    return (
        named.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(F.monotonically_increasing_id().alias("place"), "conv", "turn", "role", "text", "digest", *[c.alias(n) for n, c in faults.items()])
    )


def _list(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


_COSTS = T.ArrayType(T.LongType())


@F.pandas_udf(_COSTS)
def _matrices(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: list(block_matrix(c)))


@F.pandas_udf(_list(block=T.LongType(), after=_COSTS, last=T.BooleanType(), cost=T.LongType()))
def _checkpoints(blocks: pd.Series) -> pd.Series:
    """Cost vectors behind each block of a conversation, from its matrices."""

    def back(own: np.ndarray) -> list[dict]:
        v, out = _END, []
        for i, block in enumerate(reversed(own)):
            m = block["matrix"]
            before = tuple(min(int(m[4 * s + e]) + v[e] for e in range(4)) for s in range(4))
            out.append({"block": block["block"], "after": list(v), "last": i == 0, "cost": before[0]})
            v = before
        return out

    return blocks.map(back)


@F.pandas_udf(_list(end=T.IntegerType(), audit=T.StringType(), rows=T.StringType()))
def _walks(codes: pd.Series, after: pd.Series, last: pd.Series) -> pd.Series:
    found = [walk(c, tuple(int(x) for x in v), bool(z)) for c, v, z in zip(codes, after, last)]
    return pd.Series([[{"end": e, "audit": a, "rows": r} for e, a, r in w] for w in found])


@F.pandas_udf(_list(block=T.LongType(), start=T.IntegerType()))
def _starts(blocks: pd.Series) -> pd.Series:
    """The state in which each block of a conversation begins."""

    def forward(own: np.ndarray) -> list[dict]:
        state, out = 0, []
        for block in own:
            out.append({"block": block["block"], "start": state})
            state = int(block["ends"][state])
        return out

    return blocks.map(forward)


def _sorted_list(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


@dataclass
class Repair:
    """``conversations``: ``conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit`` for each that has rows.  ``rows``: the repaired ones as ``conv,
    place, part, role, text``, in order of place and part."""

    conversations: DataFrame
    rows: DataFrame


def repair(
    rows: DataFrame,
    params: RepairParams = RepairParams(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> Repair:
    """The cheapest repair of each conversation; of several the one whose edits'
    initials (Delete, Insert, Keep, Rerole) are the least in ASCII.

    Rows go by turn, null turns first, ties by role and then by a digest of role
    and text.  A null role or text counts as one space, so a null text is blank;
    empty texts are blank.  Rows without a conversation id are one conversation.
    Equal rows: all but the first are duplicates.  A row's first fault counts:
    blank, duplicate, truncated.  ``gaps`` counts the turns missing between the
    least and the greatest.  Roles other than system, user and assistant go by
    their initial.  Texts of any length stay in their rows.  Other columns are
    not read.  An empty table gives empty ones.
    """
    spark = rows.sparkSession
    used: list[str] = []
    ordered = cut(in_order(rows, conv_col, turn_col, role_col, text_col), "conversation-rows")
    firsts = ordered.groupBy("conv", "digest").agg(F.min("place").alias("first_place"))
    code = F.substring(
        F.lit(_CODES),
        F.instr(F.lit("suao"), F.col("initial")) + F.when(F.col("blank") | F.col("repeated"), 8).when(F.col("cut_off"), 4).otherwise(0),
        F.lit(1),
    )
    coded = cut(
        ordered.select("place", "conv", "turn", "initial", "blank", "cut_off")
        .join(firsts.select("first_place"), F.col("place") == F.col("first_place"), "left")
        .withColumn("repeated", F.col("first_place").isNull() & ~F.col("blank"))
        .select("conv", "place", "turn", "blank", "repeated", (F.col("cut_off") & ~F.col("blank") & ~F.col("repeated")).alias("truncated"), "initial", code.alias("code")),
        "row-codes",
        used,
    )
    totals = cut(
        coded.groupBy("conv").agg(
            F.count("*").alias("n"),
            *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "repeated", "truncated")],
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        ),
        "conversation-totals",
    )
    longest = totals.agg(F.max("n")).first()[0] or 1
    bits = math.ceil(math.log2(max(params.least_block, math.isqrt(longest - 1) + 1)))

    entries = F.sort_array(F.collect_list(F.struct("place", "code", "initial")))
    blocks = (
        coded.groupBy("conv", F.shiftright("place", bits).alias("block"))
        .agg(entries.alias("own"))
        .select("conv", "block", F.col("own.place").alias("places"), F.array_join("own.code", "").alias("codes"), F.array_join("own.initial", "").alias("initials"))
    )
    blocks = cut(blocks.withColumn("matrix", _matrices("codes")), "blocks", used)
    # back over the checkpoints
    thin = blocks.groupBy("conv").agg(_sorted_list("block", "matrix").alias("own")).select("conv", _checkpoints("own").alias("own"))
    checkpoints = thin.select("conv", F.explode("own").alias("at")).select(F.col("conv").alias("conv_"), "at.*")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))
    walked = cut(
        blocks.drop("matrix").join(checkpoints.withColumnRenamed("block", "block_"), same).withColumn("walks", _walks("codes", "after", "last")),
        "walks",
        used,
    )
    # forward over the ends of the walks
    ends = walked.select("conv", "block", F.col("walks.end").alias("ends"))
    starts = ends.groupBy("conv").agg(_sorted_list("block", "ends").alias("own")).select("conv", F.explode(_starts("own")).alias("at"))
    starts = starts.select(F.col("conv").alias("conv_"), F.col("at.block").alias("block_"), "at.start")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("initials") - 1, F.lit(1))), lambda i: F.substring(F.col("initials"), i, F.lit(2))
    )
    chosen = cut(
        walked.drop("conv_", "block_")
        .join(starts, same)
        .withColumn("walk", F.element_at("walks", F.col("start") + 1))
        .select(
            "conv",
            "block",
            "places",
            F.col("walk.audit").alias("audit"),
            F.col("walk.rows").alias("edits"),
            "cost",
            F.substring("initials", 1, 1).alias("head"),
            F.substring("initials", -1, 1).alias("tail"),
            F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0).cast("long").alias("inner"),
        ),
        "chosen",
    )
    by_conv = chosen.groupBy("conv").agg(_sorted_list("block", "audit", "cost", "head", "tail").alias("own"), F.sum("inner").alias("inner"))
    seams = F.zip_with(
        F.slice("own.tail", 1, F.greatest(F.size("own") - 1, F.lit(0))),
        F.slice("own.head", 2, F.greatest(F.size("own") - 1, F.lit(0))),
        lambda a, b: F.concat(a, b),
    )
    audits = by_conv.select(
        F.col("conv").alias("conv_"),
        F.array_join("own.audit", "").alias("audit"),
        F.col("own")[0]["cost"].alias("cost"),
        (F.col("inner") + F.size(F.filter(seams, lambda p: ~p.isin("su", "ua", "au")))).alias("illegal"),
    )
    conversations = totals.join(audits, F.col("conv").eqNullSafe(F.col("conv_"))).select(
        "conv", "gaps", "blank", F.col("repeated").alias("duplicate"), "truncated", "illegal", "cost", "audit"
    )
    edited = chosen.select(F.explode(F.arrays_zip("places", F.split("edits", r"\|", -1).alias("edits"))).alias("row")).select(
        F.col("row.places").alias("place_"), F.col("row.edits").alias("edits")
    ).where("edits != ''")
    step = F.col("step")
    out = (
        ordered.select("place", "conv", "role", "text")
        .join(edited, F.col("place") == F.col("place_"))
        .select("conv", "place", "role", "text", F.posexplode(F.split("edits", "")).alias("part", "step"))
        .select(
            "conv",
            "place",
            "part",
            F.when(step == "K", F.col("role")).when(F.lower(step) == "u", "user").otherwise("assistant").alias("role"),
            F.when(step.isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
        )
    )
    drop_tables(spark, used)
    return Repair(conversations, out)


def digests(rows: DataFrame) -> DataFrame:
    """``conv, sha256`` of the rows' ``role:text``, joined by newlines.  A
    digest goes over one conversation from end to end, so its rows stream
    through one task in order; only the running state is held."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            convs, out = [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if state is None or conv != own:
                    if state is not None:
                        convs.append(own)
                        out.append(state.hexdigest())
                    own, state, gap = conv, hashlib.sha256(), ""
                state.update(f"{gap}{role.as_py()}:".encode())
                state.update(text.as_buffer())
                gap = "\n"
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(out, pa.string())], ["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([state.hexdigest()])], ["conv", "sha256"])

    conv_type = rows.schema["conv"].dataType
    kind = to_arrow_type(conv_type)
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", "place", "part").select("conv", "role", "text")
    return sorted_rows.mapInArrow(hashed, f"conv {conv_type.simpleString()}, sha256 string")
