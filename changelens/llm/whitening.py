"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become whole numbers and are fitted once each.  A partition keeps the
spectrum of its scatter matrix, basis and eigenvalues, and takes in one vector
after the other as a centred rank-one update: in the basis it is a diagonal plus
one outer product, whose eigenvalues are the roots of the secular equation.  A
block of more vectors than dimensions is first turned (by a triangular factor,
never squared) to as many vectors as dimensions of the same scatter about the
block's mean, and one for the shift of the mean, so the updates are a small
share of the vectors.
Components that the update hardly touches and equal eigenvalues are deflated;
the update's vectors come from the roots, so they stay orthogonal.  Spectra of
partitions are combined in rounds, one taking in the other's components and the
shift of the means by rank-one updates.  The last basis is refined by a
distributed Rayleigh-Ritz step: the exact scatter in that basis, summed over all
fitted vectors, is nearly diagonal and is solved whole.

Memory of a task is a few square matrices of the dimension; the driver gets one
such matrix a step, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.tables import cut, drop_tables

_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class WhiteningParams:
    """``scale`` and ``shift``: an entry c is fitted as floor(scale * c) + shift.
    ``components``: the most that are returned.  ``fit_rows``: vectors that a
    partition takes in, ``block_rows`` at a time.  ``fan_in``: spectra that are
    combined in a round."""

    scale: int = 64
    shift: int = 1_000_000
    components: int = 16
    fit_rows: int = 1 << 14
    block_rows: int = 1 << 12
    fan_in: int = 8


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(pole, step)``: the k-th eigenvalue of diag(d) + z zᵀ is ``d[pole[k]] +
    step[k]``, for rising d without repeats and ``z2`` = z² without zeros.

    Each lies between two neighbouring poles, the last beyond all.  The sums over
    the poles below and above are each replaced by a constant and one pole that
    agree with them in value and slope; a bracket guards the steps.
    """
    m = len(d)
    total = z2.sum()
    if m == 1:
        return np.zeros(1, dtype=int), np.array([total])
    k = np.arange(m)
    gap = np.append(np.diff(d), total)
    middle = 1 + (z2 / (d - d[:, None] - gap[:, None] / 2)).sum(1)
    pole = np.where((middle < 0) & (k < m - 1), k + 1, k)
    sigma = d[pole]
    delta = d - sigma[:, None]
    near_low = pole == k
    low = np.where(near_low, np.where(middle < 0, gap / 2, 0), -gap / 2)
    high = np.where(near_low, np.where(middle < 0, gap, gap / 2), 0)
    delta_k, delta_up = np.where(near_low, 0, -gap), np.where(near_low, gap, 0)
    below = k[None, :] <= k[:, None]
    x = (low + high) / 2
    for _ in range(60):
        off = delta - x[:, None]
        w = z2 / off
        slope = w / off
        psi, dpsi = (w * below).sum(1), (slope * below).sum(1)
        phi, dphi = w.sum(1) - psi, slope.sum(1) - dpsi
        f = 1 + psi + phi
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        a_, b_ = delta_k - x, delta_up - x
        s, t = dpsi * a_ * a_, dphi * b_ * b_
        c = 1 + psi - dpsi * a_ + phi - dphi * b_
        c[-1] = 1 + psi[-1] - dpsi[-1] * a_[-1]
        a = c * (a_ + b_) + s + t
        b = f * a_ * b_
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step[-1] = a_[-1] + s[-1] / c[-1]
        to = x + step
        good = np.isfinite(to) & (to > low) & (to < high)
        to = np.where(good, to, (low + high) / 2)
        moved = np.abs(to - x)
        done = (moved <= 4 * _EPS * np.abs(to)) | (np.abs(f) <= 4 * _EPS * m * (1 + np.abs(w).sum(1)))
        x = np.where(done, x, to)
        if done.all():
            break
    return pole, x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and basis of ``basis diag(values) basisᵀ + vector
    vectorᵀ``."""
    z = vector @ basis
    size = max(abs(values[-1]), abs(values[0])) + z @ z
    if size == 0:
        return values, basis
    values, basis = values.copy(), basis.copy()
    tiny = 8 * _EPS * size
    touched = np.abs(z) * np.sqrt(size) > tiny
    # equal eigenvalues: turn both so that the update misses the first
    kept = np.flatnonzero(touched)
    for i, j in zip(kept[:-1], kept[1:]):
        if values[j] - values[i] <= tiny:
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            basis[:, [i, j]] = basis[:, [i, j]] @ np.array([[c, s], [-s, c]])
            low, high = values[i], values[j]
            values[i], values[j] = c * c * low + s * s * high, s * s * low + c * c * high
            z[i], z[j] = 0.0, r
            touched[i] = False
    live = np.flatnonzero(touched)
    if len(live):
        d, own = values[live], z[live]
        order = np.argsort(d)
        live, d, own = live[order], d[order], own[order]
        pole, step = secular_roots(d, own * own)
        # d[j] - root[k], without cancellation
        apart = (d[:, None] - d[pole][None, :]) - step[None, :]
        # the z for which these roots are exact
        ratio = -apart / np.where(np.eye(len(d), dtype=bool), 1.0, d[:, None] - d[None, :])
        ratio[np.arange(len(d)), np.arange(len(d))] = -np.diag(apart)
        exact = np.sqrt(np.abs(np.prod(np.abs(ratio), axis=1)))
        turn = np.copysign(exact, own)[:, None] / apart
        turn /= np.linalg.norm(turn, axis=0)
        basis[:, live] = basis[:, live] @ turn
        values[live] = d[pole] + step
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Vectors taken in, their exact sums, mean, and the scatter's spectrum."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def update(self, vector: np.ndarray) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, vector)

    def shift(self, n: int, mean: np.ndarray) -> None:
        """The update for the means' distance when n vectors have come in."""
        if not n:
            return
        away = mean - self.mean
        if self.n:
            self.update(away * np.sqrt(self.n * n / (self.n + n)))
        self.n += n
        self.mean = self.mean + away * (n / self.n)

    def take(self, block: np.ndarray, block_rows: int) -> None:
        self.sums = [a + b for a, b in zip(self.sums, exact_sums(block))]
        for i in range(0, len(block), block_rows):
            rows = block[i : i + block_rows].astype(float)
            if len(rows) <= 2 * len(self.sums):
                for row in rows:
                    self.shift(1, row)
                continue
            mean = rows.mean(0)
            for row in np.linalg.qr(rows - mean, mode="r"):
                self.update(row)
            self.shift(len(rows), mean)

    def combine(self, other: Spectrum) -> None:
        for value, column in zip(other.values, other.basis.T):
            if value > 0:
                self.update(np.sqrt(value) * column)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.shift(other.n, other.mean)

    def row(self, part: int) -> dict:
        numbers = np.concatenate([self.mean, self.values, self.basis.ravel()])
        return {"part": part, "n": self.n, "sums": [str(s) for s in self.sums], "numbers": numbers.tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        sums = [int(s) for s in row["sums"]]
        dims = len(sums)
        numbers = np.frombuffer(row["numbers"])
        return cls(int(row["n"]), sums, numbers[:dims], numbers[dims : 2 * dims], numbers[2 * dims :].reshape(dims, dims))


_SPECTRUM = "part bigint, n bigint, sums array<string>, numbers binary"


def exact_sums(block: np.ndarray) -> list[int]:
    """Sums of the columns, in whole numbers of any size."""
    if len(block) and float(np.abs(block.astype(float)).max()) * len(block) >= 2.0**62:
        block = block.astype(object)
    return [int(s) for s in block.sum(0)]


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def whole_entries(vector: Column, params: WhiteningParams) -> Column:
    """``floor(scale * c)`` of the entries; beyond ±2^62 they stay there."""
    edge = float(1 << 62)

    def entry(c: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(c.cast("double") * params.scale, F.lit(edge)), F.lit(-edge)))
        return scaled.cast("long")

    return F.transform(vector, entry)


def sound(vector: Column) -> Column:
    """The vector is there, and so are all its entries, finite ones."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _summed(table: DataFrame, column: str, dims: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of a fixed number of figures over all rows, partition by partition."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = sums(matrix_of(batch.column(0), dims))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    rows = table.select(column).mapInArrow(part, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in rows.orderBy("place").collect()])


@dataclass
class Whitening:
    """What a vector of whole entries y (before the shift) goes through: the
    exact sums of n fitted vectors, components by falling eigenvalue."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float | None = None

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y less the mean, with a whole part of the mean taken off exactly."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        if max(abs(w) for w in whole) < 1 << 61:
            return (y - np.array(whole, dtype=np.int64)) - rest
        return y.astype(float) - np.array([s / self.n for s in self.sums])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Coordinates of unit variance; none (nan) where the variance is 0."""
        with np.errstate(all="ignore"):
            return np.where(self.values > 0, self.centred(y) @ self.basis / np.sqrt(self.values), np.nan)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of (n y - S)² in whole numbers; None where a long can't hold it."""
        largest = max(float(np.abs(y.astype(float)).max(initial=0)), max(abs(s) for s in self.sums) / self.n)
        if self.n * largest * 2 < 2.0**31 / max(1, len(self.sums)) ** 0.5:
            away = self.n * y - np.array(self.sums)
            return (away * away).sum(1).tolist()
        away = self.n * y.astype(object) - np.array(self.sums, dtype=object)
        return [d if (d := int(sum(a * a for a in row))) < 1 << 63 else None for row in away]


def fit(fitted: DataFrame, dims: int, n: int, params: WhiteningParams) -> Whitening:
    """The whitening of a table of n distinct vectors ``y`` of one length."""
    spark = fitted.sparkSession
    used: list[str] = []

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dims)
        for batch in batches:
            own.take(matrix_of(batch.column(0), dims), params.block_rows)
        row = own.row(TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("numbers", pa.binary())]))

    def combined(group: pd.DataFrame) -> pd.DataFrame:
        first = group.sort_values("part")
        own = Spectrum.of(first.iloc[0])
        for i in range(1, len(first)):
            own.combine(Spectrum.of(first.iloc[i]))
        return pd.DataFrame([own.row(int(first.iloc[0]["part"]) // params.fan_in)])

    spectra = cut(fitted.mapInArrow(taken, _SPECTRUM).where("n > 0"), "spectra", used)
    parts = spectra.agg(F.max("part") + 1).first()[0]
    while parts > 1:
        # numbers in a row: the parts that meet follow one another
        up = F.floor(F.col("part") / params.fan_in).alias("up")
        spectra = cut(spectra.groupBy(up).applyInPandas(combined, _SPECTRUM), "spectra", used)
        parts = -(-parts // params.fan_in)
    whole = Spectrum.of(spectra.first())
    drop_tables(spark, used)
    basis = np.linalg.qr(whole.basis)[0]
    found = Whitening(n, whole.sums, basis, np.ones(dims), 0.0)

    def scatter(y: np.ndarray) -> np.ndarray:
        p = found.centred(y) @ basis
        return (p.T @ p).ravel()

    h = _summed(fitted, "y", dims, scatter).reshape(dims, dims) / n
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, refined = values[::-1], (basis @ turn)[:, ::-1]
    k = min(params.components, dims)
    lead = refined[:, :k]
    lead = lead * np.sign(lead[np.abs(lead).argmax(0), np.arange(k)])
    least = dims * 16 * _EPS * max(values[0], 0.0)
    done = Whitening(n, whole.sums, lead, np.where(values[:k] > least, values[:k], 0.0), float(np.trace(h)))
    used_k = int((done.values > 0).sum())

    def moments(y: np.ndarray) -> np.ndarray:
        w = done.whitened(y)[:, :used_k]
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    if used_k:
        sums = _summed(fitted, "y", dims, moments) / n
        mean, square = sums[:used_k], sums[used_k:].reshape(used_k, used_k)
        done.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(used_k)).max())
    return done


def whiten(
    rows: DataFrame, params: WhiteningParams = WhiteningParams(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for
    each row with a sound vector and each component, from 1 on.

    Rows whose vector is null or has a null or non-finite entry are dropped.
    Vectors of different lengths are fitted apart, each length by itself; empty
    vectors have no components.  Repeated vectors are fitted once and each give
    their rows; null ids stay null.  A component without variance (as all have
    where one vector alone is fitted) has no ``whitened``, and where no vector
    varies there is no ``explained`` and no ``identity_error``.  A deviation that
    a long can't hold is null.  Components have the sign that makes their
    largest entry positive.  Other columns are not read; an empty table gives an
    empty one.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    whole = rows.where(sound(vector)).select(F.col(f"`{id_col}`").alias("id"), whole_entries(vector, params).alias("y"))
    distinct = cut(whole.select("y").distinct(), "fit-list")
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    lengths = distinct.groupBy(F.size("y").alias("dims")).count().orderBy("dims").collect()
    for dims, n in lengths:
        if not dims:
            continue
        parts = max(1, min(100_000, -(-n // params.fit_rows)))
        own = distinct.where(F.size("y") == dims)
        used: list[str] = []
        dealt = cut(own.repartition(parts, F.xxhash64("y")), "fit-parts", used)
        done = fit(dealt, dims, n, params)
        drop_tables(spark, used)
        out = out.unionByName(_applied(whole.where(F.size("y") == dims), dims, done, schema))
    return out


def _applied(rows: DataFrame, dims: int, done: Whitening, schema: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(done.values)
        share = done.values / done.total if done.total > 0 else np.full(k, np.nan)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            y = matrix_of(batch.column(1), dims)
            each = pa.array(np.repeat(np.arange(m), k))

            def some(values: np.ndarray) -> pa.Array:
                return pa.array(values, pa.float64(), mask=np.isnan(values))

            error = np.full(m * k, np.nan if done.identity_error is None else done.identity_error)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, done.n)),
                    pa.array(done.deviations(y), pa.int64()).take(each),
                    some(done.whitened(y).ravel()),
                    some(np.tile(share, m)),
                    some(error),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(apply, schema)
