"""The eigendecomposition against a direct one, the query against plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from changelens.llm import queries, whitening as w
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=16):
    """What the query has to return: by exact means and one symmetric solver."""
    sound = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, *_ in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in sound}))
    n, sums = len(x), [int(s) for s in x.sum(0)]
    mean = [Fraction(s, n) for s in sums]
    centred = lambda v: np.array([float(a - m) for a, m in zip(v, mean)])
    c = np.array([centred([int(a) for a in v]) for v in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(sums))
    out = {}
    for i, v in sound:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        out.setdefault(i, []).append((deviation, centred(v) @ vectors[:, :k] / np.sqrt(values[:k])))
    return n, values[:k] / values.sum(), out


def check(found, rows):
    n, explained, by_id = plain(rows)
    signs = {}
    got = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got.setdefault(r.vec_id, []).append((r.component, r.deviation, r.whitened))
    assert set(got) == set(by_id)
    for i, entries in got.items():
        entries.sort(key=lambda e: (e[0], e[2]))
        for component in range(1, len(explained) + 1):
            ours = [e for e in entries if e[0] == component]
            theirs = [(d, z[component - 1]) for d, z in by_id[i]]
            assert sorted(e[1] for e in ours) == sorted(d for d, _ in theirs)
            if len(ours) == 1 and abs(theirs[0][1]) > 1e-3:
                sign = math.copysign(1, ours[0][2] * theirs[0][1])
                assert signs.setdefault(component, sign) == sign
                assert ours[0][2] * sign == pytest.approx(theirs[0][1], rel=1e-7, abs=1e-8)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_registered_query(spark):
    found = queries.op11_whitening(spark, SMALL).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(found, rows)


@pytest.mark.parametrize("block_rows", [1, 50])
def test_hard_rows_over_several_rounds(spark, block_rows):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [4, 3, 2, 1, 0.5, 0.25]], i) for i in range(400)]
    rows += [(i, rows[0][1], None) for i in range(1000, 1200)]
    rows += [(2000, None, 1), (2001, [1.0, None] * 3, 1), (2002, [math.nan] * 6, 1), (2003, [math.inf] + [0.0] * 5, 1), (None, rows[1][1], 3), (7, rows[7][1], 7)]
    params = w.WhiteningParams(fit_rows=40, block_rows=block_rows, fan_in=3)
    found = w.whiten(table(spark, rows).repartition(5), params).withColumnRenamed("id", "vec_id").collect()
    check(found, rows)


def test_lengths_single_vectors_and_empty_tables(spark):
    assert w.whiten(table(spark, [])).collect() == []
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, 5.0], 0), (3, [], 0), (4, [7.0], 0), (5, [7.0], 0)]
    found = {(r.id, r.component): r for r in w.whiten(table(spark, rows)).collect()}
    assert set(found) == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (5, 1)}
    assert found[1, 1].whitened == pytest.approx(-found[2, 1].whitened) and abs(found[1, 1].whitened) == pytest.approx(1)
    assert found[1, 2].whitened is None and found[1, 1].explained == pytest.approx(1)
    assert found[4, 1].n == 1 and found[4, 1].whitened is None and found[4, 1].explained is None and found[4, 1].deviation == 0


def test_entries_of_any_size(spark):
    rows = [(i, [float(i) * 1e30, 1.0 * i], 0) for i in range(4)]
    found = w.whiten(table(spark, rows)).collect()
    assert len(found) == 8 and any(r.deviation is None for r in found)


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    rng = np.random.default_rng(seed)
    dims = [1, 2, 5, 16, 40, 64][seed]
    values = np.sort(rng.choice([0.0, 1.0, 1.0 + 1e-15, 2.0, 7.0], dims) * 10.0 ** rng.integers(-6, 6))
    basis = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    matrix = basis * values @ basis.T
    for step in range(60):
        vector = rng.normal(size=dims) * 10.0 ** rng.integers(-8, 3)
        if step % 5 == 0:
            vector[rng.random(dims) < 0.7] = 0
        if step % 7 == 0:
            vector = basis[:, rng.integers(dims)] * 3
        values, basis = w.rank_one(values, basis, vector)
        matrix = matrix + np.outer(vector, vector)
        scale = max(np.abs(matrix).max(), 1e-300)
        assert np.abs(basis * values @ basis.T - matrix).max() < 1e-12 * scale
        assert np.abs(basis.T @ basis - np.eye(dims)).max() < 1e-11
        assert (np.diff(values) >= 0).all()


def test_spectra_combine_as_if_taken_together():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(500, 20))
    parts = [w.Spectrum.empty(20) for _ in range(4)]
    for own, rows in zip(parts, (x[:1], x[1:1], x[1:300], x[300:])):
        own.take(rows, 100)
    whole = parts[1]
    for other in (parts[0], parts[2], parts[3]):
        whole.combine(other)
    c = x - x.mean(0)
    assert whole.n == 500 and whole.sums == x.sum(0).tolist()
    assert np.allclose(whole.values, np.linalg.eigvalsh(c.T @ c), rtol=1e-10)
