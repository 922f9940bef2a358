import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from changelens.llm import best_fit, cost_pack, tokens
from changelens.llm.tokens import TokenParams
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, hard_rows

LENGTHS = st.lists(st.integers(1, 32), max_size=60)


@settings(max_examples=150, deadline=None)
@given(LENGTHS)
def test_cost_places_fill_sequences(lengths):
    costs = cost_pack.CostParams()
    placed = cost_pack.place(lengths, 32, costs)
    pieces, used = defaultdict(list), defaultdict(list)
    for i, begin, n, s, offset in placed:
        pieces[i].append((begin, n))
        used[s].append((offset, n))
    for i, n in enumerate(lengths):
        at = 0
        for begin, length in sorted(pieces[i]):
            assert begin == at and length > 0
            at += length
        assert at == n
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 32
    full = sum(n == 32 for n in lengths)
    assert len(used) == full + -(-(sum(lengths) - 32 * full) // 32)


def test_cost_goes_to_the_cheapest_with_room():
    # 8 goes alone, 7 to the other, 3 to the cheaper that has room for it
    placed = cost_pack.place([8, 7, 3, 2], 10, cost_pack.CostParams())
    assert [(i, s) for i, _, _, s, _ in placed] == [(0, 0), (1, 1), (2, 1), (3, 0)]


@settings(max_examples=150, deadline=None)
@given(LENGTHS)
def test_best_fit_takes_the_tightest(lengths):
    bins = best_fit.place(lengths, 32)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    plain_bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [b for b in plain_bins if 32 - sum(lengths[j] for j in b) >= lengths[i]]
        if fits:
            max(fits, key=lambda b: sum(lengths[j] for j in b)).append(i)
        else:
            plain_bins.append([i])
    assert sorted(sum(lengths[i] for i in b) for b in bins) == sorted(sum(lengths[i] for i in b) for b in plain_bins)


@pytest.fixture(scope="module")
def slow():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(slow, text):
    return np.array(slow.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_ids_are_those_of_the_library(slow):
    for _, text, *_ in hard_rows():
        assert np.array_equal(tokens.encode(text), expected(slow, text)), text


def test_pieces_of_hard_documents(spark, slow):
    rows = hard_rows()
    params = TokenParams(block_bytes=20000)
    packed = cost_pack.pack(documents(spark, clash=True), params).collect()
    want = sorted(expected(slow, r[1]).tobytes() for r in rows)
    assert sum(r.length for r in packed) == sum(len(w) // 4 for w in want)
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
    once = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1]
    for doc_id, text, *_ in once:
        ids, at = expected(slow, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_doc[None]) >= 2


def test_large_ids_beside_null_ones(spark):
    big = (1 << 62) + 1
    docs = documents(spark, [(big, "a b", "en", "s", 1), (None, "c", "en", "s", 1)])
    assert {r.doc_id for r in cost_pack.pack(docs).collect()} == {big, None}
    assert {d for r in best_fit.pack(docs).collect() for d in r.doc_ids} == {big, None}


def test_round_trip_of_matrices(spark, slow, tmp_path):
    docs = documents(spark)
    packed = best_fit.pack(docs, TokenParams(block_bytes=20000))
    rows = packed.collect()
    found = defaultdict(list)
    for r in rows:
        ids = np.array(r.input_ids, dtype="<u4")
        assert len(ids) == 1024 == len(r.position_ids) and r.cu_seqlens[0] == 0
        assert not ids[r.cu_seqlens[-1] :].any()
        for k, doc in enumerate(r.doc_ids):
            a, b = r.cu_seqlens[k : k + 2]
            assert r.position_ids[a:b] == list(range(b - a))
            found[doc].append((r.doc_starts[k], ids[a:b]))
    once = [r for r in hard_rows() if sum(x[0] == r[0] for x in hard_rows()) == 1]
    for doc_id, text, *_ in once:
        whole = np.concatenate([x for _, x in sorted(found[doc_id], key=lambda x: x[0])])
        assert np.array_equal(whole, expected(slow, text))
        assert slow.decode(whole[:-1].tolist(), skip_special_tokens=False) == (text or "")
    best_fit.write_packed(packed, str(tmp_path / "packed"))
    written = {r.sequence_id: r for r in spark.read.parquet(str(tmp_path / "packed")).collect()}
    for r in rows:
        assert np.frombuffer(written[r.sequence_id].input_ids, "<i4").tolist() == r.input_ids
        assert np.frombuffer(written[r.sequence_id].cu_seqlens, "<i4").tolist() == r.cu_seqlens


def test_empty_tables(spark):
    assert cost_pack.pack(documents(spark, [])).count() == 0
    assert best_fit.pack(documents(spark, [])).count() == 0


def placed(packed):
    return sorted((r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in packed)


def test_another_layout_gives_the_same_sequences(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["ab", "cd", "xyz", "9"], k=rng.randrange(1, 900))), None, None, None) for i in range(120)]
    rows += [(500 + i, "a copy", None, None, None) for i in range(60)]
    docs, params = documents(spark, rows), TokenParams(block_bytes=8000)
    one, other = docs.coalesce(1), docs.repartition(7)
    assert placed(cost_pack.pack(one, params).collect()) == placed(cost_pack.pack(other, params).collect())
    matrices = [sorted((r.sequence_id, r.input_ids) for r in best_fit.pack(d, params).collect()) for d in (one, other)]
    assert matrices[0] == matrices[1]


def test_a_long_document_and_repeated_rows_are_spread(spark):
    long = [(1, " ".join(f"word{i}" for i in range(60_000)), None, None, None)]
    rows = long + [(i, f"short text {i}", None, None, None) for i in range(2, 900)] + [(7, "again", None, None, None)] * 400 + [(None, None, None, None, None)] * 400
    docs, params = documents(spark, rows).coalesce(2), TokenParams(block_bytes=40_000)
    blocks = tokens.n_blocks(docs, "text", params)
    cut = tokens.pieces(docs, params, blocks, keep_ids=True).selectExpr("block", "doc_id", "octet_length(ids) AS n")
    sizes = sorted(r["sum(n)"] for r in cut.groupBy("block").sum("n").collect())
    assert blocks >= 10 and len(sizes) == blocks and sizes[-1] < 2.5 * sizes[len(sizes) // 2]
    for doc in ("doc_id = 7", "doc_id IS NULL"):
        counts = [r["count"] for r in cut.where(doc).groupBy("block").count().collect()]
        assert len(counts) == blocks and max(counts) < 100


def best_place(lengths, capacity, costs):
    """The rule spelt out: longest first, to the cheapest sequence with room,
    else cut at the roomiest."""
    cost = lambda n: costs.linear * n + costs.quadratic * n * n
    full = [i for i, n in enumerate(lengths) if n == capacity]
    out = [(i, 0, capacity, s, 0) for s, i in enumerate(full)]
    rest = sorted((i for i, n in enumerate(lengths) if 0 < n < capacity), key=lambda i: -lengths[i])
    total = sum(lengths[i] for i in rest)
    open_ = [[0, 0.0] for _ in range(-(-total // capacity))]
    for i in rest:
        begin, left = 0, lengths[i]
        while left:
            fits = [s for s, (used, _) in enumerate(open_) if capacity - used >= left]
            s = min(fits, key=lambda s: (open_[s][1], s)) if fits else None
            n = left
            if s is None:
                most = max(capacity - used for used, _ in open_)
                s = min((s for s, (used, _) in enumerate(open_) if capacity - used == most), key=lambda s: (open_[s][1], s))
                n = most
            out.append((i, begin, n, len(full) + s, open_[s][0]))
            open_[s][0] += n
            open_[s][1] += cost(n)
            begin, left = begin + n, left - n
    return out


def test_placement_by_cost_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([4, 16, 64])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 40))]
        costs = cost_pack.CostParams()
        assert cost_pack.place(lengths, capacity, costs) == best_place(lengths, capacity, costs)
