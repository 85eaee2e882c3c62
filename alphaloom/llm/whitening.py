"""Whitening of embeddings by an incremental eigendecomposition.

Every partition takes its vectors one by one: a vector, centred, is a rank-one update of the scatter so far, whose new
eigenvalues are the roots of the secular equation and whose directions of no weight, or of equal eigenvalues, are deflated.
Partial spectra are combined two by two, the directions of one being rank-one updates of the other, and one more for the
difference of the means; they meet by groups, level by level. What comes out is refined by Rayleigh-Ritz: the covariance in
that basis is summed over all vectors by all partitions, and its eigenvectors turn the basis.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table

EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """scale: a component c becomes floor(scale * c). components: kept. together: spectra combined by one task."""

    scale: int = 256
    components: int = 4
    together: int = 16


# --- the symmetric eigenproblem, changed by one vector ---


def secular(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """d ascending, w positive -> gap[i, j] = d[j] minus root i of 1 + sum(w / (d - x)); root i follows d[i].

    Each root is sought from the nearer of its two poles by rational interpolation that keeps both poles, inside a bracket.
    """
    k, total = len(d), w.sum()
    if k == 1:
        return np.array([[-total]])
    i = np.arange(k)
    right = np.append(d[1:], d[-1] + total)
    half = (right - d) / 2
    middle = 1 + (w / (d[None, :] - (d + half)[:, None])).sum(1)
    near = np.where((middle < 0) & (i < k - 1), i + 1, i)
    apart = d[None, :] - d[near][:, None]
    low = np.where(near == i, np.where(middle < 0, half, 0.0), -half)
    high = np.where(near == i, np.where(middle < 0, 2 * half, half), 0.0)
    below = i[None, :] <= i[:, None]
    x, inner, after = (low + high) / 2, i[:-1], np.minimum(i + 1, k - 1)
    for _ in range(60):
        gap = apart - x[:, None]
        t = w / gap
        slope = t / gap
        f, steep = 1 + t.sum(1), slope.sum(1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        open_ = (np.abs(f) > 8 * EPS * k * (1 + np.abs(t).sum(1))) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        left = np.where(below, slope, 0).sum(1)
        a, b = gap[i, i], gap[i, after]
        step = np.empty(k)
        p, q = a[inner], b[inner]
        c = f[inner] - p * left[inner] - q * (steep - left)[inner]
        m, z = (p + q) * f[inner] - p * q * steep[inner], p * q * f[inner]
        root = np.sqrt(np.maximum(m * m - 4 * z * c, 0))
        with np.errstate(all="ignore"):
            step[inner] = np.where(m <= 0, (m - root) / (2 * c), 2 * z / (m + root))
            step[-1] = a[-1] + a[-1] ** 2 * left[-1] / (f[-1] - a[-1] * left[-1])
            new = x + step
        good = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(open_, np.where(good, new, (low + high) / 2), x)
    return apart - x[:, None]


class Spectrum:
    """n vectors: exact sums, mean, and the eigenvalues (ascending) and eigenvectors (columns) of their scatter."""

    def __init__(self, dims: int):
        self.n, self.sums, self.mean = 0, np.zeros(dims, np.int64), np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """One more vector of whole numbers."""
        off = x - self.mean
        self.n += 1
        self.sums += x
        self.mean += off / self.n
        if self.n > 1:
            self.update(off, (self.n - 1) / self.n)

    def update(self, y: np.ndarray, weight: float) -> None:
        """Adds weight * y y' to the scatter."""
        z, d, v = y @ self.vectors, self.values, self.vectors
        most = float(weight * (z @ z))
        if not most > 0:
            return
        tiny = 8 * EPS * max(float(np.abs(d).max()), most)
        heavy = np.flatnonzero(weight * z * z > tiny * EPS)
        for a, b in zip(heavy[:-1], heavy[1:], strict=True):  # equal eigenvalues: turn the plane until one has all the weight
            if d[b] - d[a] <= tiny:
                r = np.hypot(z[a], z[b])
                c, s = z[b] / r, z[a] / r
                v[:, a], v[:, b] = c * v[:, a] - s * v[:, b], s * v[:, a] + c * v[:, b]
                z[a], z[b] = 0.0, r
        live = np.flatnonzero(weight * z * z > tiny * EPS)
        if not len(live):
            return
        own = d[live]
        gap = secular(own, weight * z[live] ** 2)
        k = len(live)
        # The weights for which the roots found are exact: with them, eigenvectors are orthogonal.
        i, j = np.arange(k)[:, None], np.arange(k)[None, :]
        other = np.where(i < j, own[i], own[np.minimum(i + 1, k - 1)]) - own[j]
        ratio = np.where(i == k - 1, -gap, np.divide(-gap, other, out=np.ones_like(gap), where=other != 0))
        turn = (np.copysign(np.sqrt(np.maximum(ratio.prod(0), 0)), z[live])[None, :] / gap).T
        v[:, live] = v[:, live] @ (turn / np.sqrt((turn * turn).sum(0)))
        d[live] = own - np.diagonal(gap)
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], v[:, order]

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        off, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector, float(value))
        if self.n:
            self.update(off, self.n * other.n / n)
        self.n, self.sums = n, self.sums + other.sums
        self.mean = self.sums / n


SPECTRA = pa.schema([("dims", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
_SPECTRA = "dims int, part long, n long, sums array<long>, values array<double>, vectors array<double>"


def _rows(found: dict[int, Spectrum], part: int) -> pa.Table:
    columns = [[d, part, s.n, s.sums.tolist(), s.values.tolist(), s.vectors.ravel().tolist()] for d, s in found.items()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*columns, strict=True), SPECTRA, strict=True)], schema=SPECTRA)


def _matrices(vectors: pa.Array | pa.ChunkedArray):
    """(dimensions, places, matrix) of each length among vectors of whole numbers; empty ones have no dimensions."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, np.int64)
    flat, begin = vectors.flatten().to_numpy(), np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        places = np.flatnonzero(size == d)
        yield int(d), places, flat[begin[places][:, None] + np.arange(d)]


def _spectra(batches):
    release()
    found: dict[int, Spectrum] = {}
    for batch in batches:
        for d, _, x in _matrices(batch.column("x")):
            own = found.setdefault(d, Spectrum(d))
            for row in x:
                own.add(row)
    if found:
        yield from _rows(found, TaskContext.get().partitionId()).to_batches()


def _combined(group: pa.Table) -> pa.Table:
    found: dict[int, Spectrum] = {}
    for r in sorted(group.to_pylist(), key=lambda r: -r["n"]):
        own = Spectrum(r["dims"])
        own.n, own.sums = r["n"], np.array(r["sums"], np.int64)
        own.mean, own.values, own.vectors = own.sums / own.n, np.array(r["values"]), np.array(r["vectors"]).reshape(r["dims"], -1)
        found.setdefault(r["dims"], Spectrum(r["dims"])).combine(own) if r["dims"] in found else found.update({r["dims"]: own})
    return _rows(found, int(group.column("part")[0].as_py()))


@dataclass(frozen=True)
class Model:
    """basis: eigenvectors as columns, by falling eigenvalue. values: the covariance's eigenvalues. trace: their sum."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def whole(self) -> np.ndarray:
        """Whether a component has any variance."""
        return self.values > len(self.sums) * EPS * max(self.values.max(initial=0.0), 0.0)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each component as a whole number; null if the vector is, or holds null or non-finite ones."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(v, lambda c: F.floor(c * scale).cast("long")))


def _sum_of_outer(fit: DataFrame, dims: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Over all x of fit: the sum of y y', y being x less the mean in the basis."""

    def run(batches):
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            for d, _, x in _matrices(batch.column("x")):
                if d == dims:
                    y = (x - mean) @ basis
                    total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["outer"])

    cells = fit.mapInArrow(run, "outer array<double>").select(F.posexplode("outer").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(basis.shape[1] ** 2)
    for r in cells.collect():  # as many as the matrix has
        out[r["cell"]] = r["v"]
    return out.reshape(basis.shape[1], -1)


def _turned(outer: np.ndarray, n: int, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, turn = np.linalg.eigh((outer + outer.T) / (2 * n))
    return np.maximum(values[::-1], 0), basis @ turn[:, ::-1]


def fit(vectors: DataFrame, spec: Whitening = Whitening()) -> dict[int, Model]:
    """vectors (x array<long>) -> a model for each length of vectors: every distinct x counts once.

    The driver gets one spectrum, of dims * dims numbers, for each length.
    """
    once = stored(vectors.select("x").where(F.size("x") > 0).distinct())
    spectra = stored(once.mapInArrow(_spectra, _SPECTRA))
    most = spectra.agg(F.max("part")).first()[0] or 0
    while most > 0:
        most //= spec.together
        spectra = spectra.withColumn("part", F.floor(F.col("part") / spec.together)).groupBy("dims", "part").applyInArrow(_combined, _SPECTRA)
    models = {}
    for r in spectra.collect():
        d, n, mean = r["dims"], r["n"], np.array(r["sums"], np.int64) / r["n"]
        basis, _ = np.linalg.qr(np.array(r["vectors"]).reshape(d, d)[:, ::-1])
        for _ in range(2):
            values, basis = _turned(_sum_of_outer(once, d, mean, basis), n, basis)
        k = min(spec.components, d)
        model = Model(n, tuple(r["sums"]), basis[:, :k], values[:k], float(values.sum()))
        own = model.whole
        error = 0.0
        if own.any():
            white = model.basis[:, own] / np.sqrt(model.values[own])
            error = float(np.abs(_sum_of_outer(once, d, mean, white) / n - np.eye(own.sum())).max())
        models[d] = Model(n, model.sums, model.basis, model.values, model.trace, error)
    return models


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The sum over dimensions of (n * x - sums)**2, exact; raises where that is no 64-bit number."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if len(sums) * most**2 < 2**63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1)
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(out, default=0) >= 2**63:
        raise OverflowError("a deviation has more than 64 bits")
    return np.array(out, np.int64)


WHITE = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _whitener(models: dict[int, Model]):
    def run(batches):
        release()
        for batch in batches:
            ids = batch.column("vec_id")
            for d, places, x in _matrices(batch.column("x")):
                m, k = models[d], len(models[d].values)
                with np.errstate(all="ignore"):
                    white = np.where(m.whole, (x - np.array(m.sums, np.int64) / m.n) @ m.basis / np.sqrt(m.values), np.nan)
                    share = np.where(m.trace > 0, m.values / m.trace, np.nan)
                each = lambda a: np.repeat(a, k)
                columns = [
                    ids.take(pa.array(each(places))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, m.n), each(_deviation(x, m.n, m.sums)),
                    pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())), pa.array(np.tile(share, len(x)), pa.float64(), mask=np.tile(np.isnan(share), len(x))), np.full(len(x) * k, m.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=WHITE)

    return run


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", spec: Whitening = Whitening()) -> DataFrame:
    """df -> vec_id, component (from 1), n, deviation, whitened, explained, identity_error: as many rows per row as
    components, fewer if vectors are shorter.

    Vectors that are null, empty, or hold null or non-finite components are dropped. Vectors of unlike lengths have models of
    their own. Rows that repeat an id or vector, and null ids, are answered each; equal vectors count once in the fit. A
    component without variance (all vectors equal, or on a line) has null for whitened, and explained is null if there is no
    variance at all. Equal eigenvalues: any basis of theirs. Components must be below 2**54, deviations below 2**63, else it
    raises. An empty table gives no rows; other columns play no part.
    """
    rows = df.select(df[vec_id].cast("long").alias("vec_id"), quantised(df[vector], spec.scale).alias("x")).where("x is not null")
    models = fit(rows, spec)
    return rows.where(F.size("x") > 0).mapInArrow(_whitener(models), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
