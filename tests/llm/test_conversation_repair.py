"""Repairs against a search over all edits, on hard and on lopsided tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from changelens.llm import conversation_repair as cr, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def legal(state, initial):
    return initial == NEXT[state] or (state == "" and initial == "s")


def sort_key(row):
    turn, role, text = row
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role.encode(), digest)


def cheapest(rows):
    """``(cost, audit, repaired)`` by uniform-cost search over (row, state)."""
    rows, seen = sorted(rows, key=sort_key), set()
    marks = []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        repeated = (role, text) in seen and not blank
        seen.add((role, text))
        marks.append((blank, repeated, not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) and not blank and not repeated))
    done = set()
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out, marks, rows
        to = NEXT[state]
        name = {"u": "user", "a": "assistant"}[to]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            blank, repeated, truncated = marks[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not blank and not repeated:
                heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, to, (*out, f"{name}:{text}")))
                if legal(state, role[:1]):
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))


def expected(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in by_conv.items():
        cost, audit, repaired, marks, ordered = cheapest(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(ordered)]
        out.append((conv, gaps, *[sum(m[k] for m in marks) for k in range(3)], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, repaired))
    return sorted(out, key=repr)


def actual(spark, rows, parts=3, **params):
    found = cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(parts), cr.RepairParams(**params))
    texts, hashes = defaultdict(list), {}
    for r in sorted(found.rows.collect(), key=lambda r: (r.place, r.part)):
        texts[r.conv].append(f"{r.role}:{r.text}")
    for r in cr.digests(found.rows).collect():
        hashes[r.conv] = r.sha256
    assert hashes == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()}
    return sorted(((*r, tuple(texts[r.conv])) for r in found.conversations.collect()), key=repr)


def conversations(seed, n, longest, ids=None):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No", "", " \n", "Is it? ", "same.", "a b c", "é!", None, "x" * 3000]
    rows = []
    for conv in ids or range(n):
        size = rng.randrange(1, longest)
        usual = rng.random() < 0.5
        for turn in range(size):
            role = ["user", "assistant"][turn % 2] if usual and rng.random() < 0.8 else rng.choice(roles)
            text = f"t{turn}." if usual and rng.random() < 0.7 else rng.choice(texts)
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 3, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("least_block", [1, 64])
def test_against_search(spark, least_block):
    rows = conversations(least_block, 60, 14) + conversations(9, 1, 90, ids=[None, 1000])
    assert actual(spark, rows, least_block=least_block) == expected(rows)


def test_one_conversation_of_most_rows(spark):
    rows = conversations(3, 1, 2, ids=range(20)) + [(77, t, "user" if t % 3 else "assistant", f"{t}{'.' * (t % 5)}") for t in range(1500)]
    rows += [(78, 0, "user", "same.")] * 700
    assert actual(spark, rows, least_block=1) == expected(rows)


def test_empty_table_and_columns_of_used_names(spark):
    assert actual(spark, []) == []
    rows = conversations(5, 4, 6)
    wide = spark.createDataFrame([(*r, 1, "p", "c") for r in rows], f"{SCHEMA}, place int, conv string, CODE string")
    found = cr.repair(wide)
    assert sorted((r.conv, r.cost, r.audit) for r in found.conversations.collect()) == [(e[0], e[6], e[7]) for e in expected(rows)]


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "b " * 400_000)]
    assert actual(spark, rows) == expected(rows)


def test_query_with_lost_conversations_and_nulls(spark, tmp_path):
    rows = conversations(8, 40, 4) + [(None, None, "user", "a."), (500, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if fault == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text))
        damaged += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    wanted = {e[0]: (*e[:8], hashlib.sha256("\n".join(e[8]).encode()).hexdigest()) for e in expected(damaged)}
    for conv in {r[0] for r in rows} - set(wanted):
        wanted[conv] = (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(wanted.values(), key=repr)
