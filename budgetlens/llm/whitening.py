"""Embedding whitening by incremental eigendecomposition.

Every task keeps the mean and the spectral decomposition of the scatter of the
vectors it has seen. A further vector changes the scatter by one centred
rank-one term (a block of many vectors by as many terms as a vector has
entries, the rows of its triangular factor, and one for its mean); the new eigenvalues are the roots of a secular equation, the new
eigenvectors follow from them, and what the term does not touch (components
with nothing of it, and all but one of equal eigenvalues) is deflated. The
spectra of tasks are combined in a tree, again by rank-one updates: one for
each component of the other spectrum and one for the difference of the means.
The combined basis is refined by a Rayleigh-Ritz step over all vectors, whose
small projected matrix is summed in Spark. So the results do not depend, beyond
rounding, on how the vectors were dealt over tasks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from budgetlens.llm.common import in_arrow, map_batches, stored

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more do not give exact longs.
LIMIT = 2.0 ** 40
EPS = np.finfo(float).eps
#: Vectors whose scatter is put into rank-one terms at once.
BLOCK = 4096
#: Spectra that one task combines.
FAN_IN = 8
SPECTRUM = "part long, n long, sums array<long>, mean array<double>, roots array<double>, basis array<double>"


@functools.lru_cache(maxsize=256)
def _triangle(k: int) -> np.ndarray:
    return np.tril(np.ones((k, k)))


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)) for rising ``d`` and rho > 0.

    Returns (roots, gap) with gap[j, i] = d[i] - roots[j], which is taken from
    the pole nearest to a root and so keeps its relative accuracy. Poles to the
    left and to the right of a root are each replaced by one pole of equal value
    and slope; a step that leaves the bracket becomes a bisection.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    middle = (d + upper) / 2
    weight = rho * z2
    value = 1 + (1 / (d[None, :] - middle[:, None])) @ weight
    left = value >= 0
    left[-1] = True  # the last interval has a pole on its left only
    origin = np.where(left, d, upper)
    delta = d[None, :] - origin[:, None]
    half = middle - origin
    low, high = np.where(left, 0.0, half), np.where(left, half, 0.0)
    if value[-1] < 0:
        low[-1], high[-1] = half[-1], upper[-1] - d[-1]
    t = (low + high) / 2
    rows = np.arange(k)
    below = _triangle(k)
    dl = delta[rows, rows]
    dr = np.append(delta[rows[:-1], rows[1:]], 1.0)
    for _ in range(100):
        inverse = np.reciprocal(delta - t[:, None])
        f = 1 + inverse @ weight
        inverse *= inverse
        slope = inverse @ weight
        inverse *= below
        lower_slope = inverse @ weight
        low, high = np.where(f < 0, t, low), np.where(f > 0, t, high)
        a, b = dl - t, dr - t
        b[-1] = 1.0
        s, q = lower_slope * a * a, (slope - lower_slope) * b * b
        q[-1] = 0.0
        c = f - s / a - q / b
        # The step x solves c + s / (a - x) + q / (b - x) = 0.
        p1, p0 = c * (a + b) + s + q, a * b * f
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(p1 * p1 - 4 * c * p0, 0.0))
            step = np.where(p1 > 0, 2 * p0 / (p1 + root), (p1 - root) / (2 * c))
            step[-1] = f[-1] * a[-1] / c[-1] if c[-1] else np.nan
        step[f == 0] = 0.0
        # Quadratic convergence: the step after so small a one would be rounding.
        close = np.abs(step) <= 1e-9 * np.abs(t)
        new = np.clip(t + step, low, high)
        bad = ~close & ~((t + step > low) & (t + step < high))
        new[bad] = (low[bad] + high[bad]) / 2
        t = new
        if close.all():
            break
    t = np.where(t == 0, np.where(left, np.finfo(float).tiny, -np.finfo(float).tiny), t)
    return origin + t, delta - t[:, None]


def rank_one(roots: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectral decomposition (rising roots, columns) of
    basis * diag(roots) * basis' + rho * vector * vector' for rho >= 0."""
    z = vector @ basis
    size = float(z @ z) * rho
    if not size > 0:
        return roots, basis
    top = abs(roots[-1]) + size
    # Deflation: components with next to nothing of the vector stay as they are.
    live = np.abs(z) * np.sqrt(rho) * np.sqrt(top) > EPS * top
    order = np.nonzero(live)[0]
    close = np.nonzero(np.diff(roots[order]) <= 8 * EPS * top)[0]
    if len(close):
        # Of equal roots a rotation leaves the vector in one component only.
        basis = basis.copy()
        for i in close.tolist():
            a, b = order[i], order[i + 1]
            r = np.hypot(z[a], z[b])
            c, s = z[b] / r, z[a] / r
            basis[:, [a, b]] = basis[:, [a, b]] @ np.array([[c, s], [-s, c]])
            z[a], z[b] = 0.0, r
            live[a] = False
        order = np.nonzero(live)[0]
    if not len(order):
        return roots, basis
    d, z2 = roots[order], z[order] ** 2
    new, gap = secular_roots(d, z2, rho)
    # The weights for which the computed roots are exact keep the vectors orthogonal.
    apart = d[:, None] - d[None, :]  # apart[j, i] = d[j] - d[i]
    ratio = -gap
    ratio[:-1] /= np.where(_triangle(len(order))[:-1], apart[1:], apart[:-1])
    ratio[-1] /= rho
    weight = np.sqrt(np.abs(ratio.prod(axis=0))) * np.where(z[order] < 0, -1.0, 1.0)
    q = weight / gap
    q /= np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
    out_roots, out = roots.copy(), basis.copy()
    out_roots[order], out[:, order] = new, basis[:, order] @ q.T
    rise = np.argsort(out_roots, kind="stable")
    return out_roots[rise], out[:, rise]


class Spectrum:
    """Number, mean, and spectral decomposition of the scatter of vectors."""

    def __init__(self, n: int, mean: np.ndarray, roots: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.roots, self.basis = n, mean, roots, basis

    @classmethod
    def of_none(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray) -> None:
        apart = vector - self.mean
        self.roots, self.basis = rank_one(self.roots, self.basis, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def add_block(self, x: np.ndarray) -> None:
        """Many vectors at once: their scatter about their own mean is the sum of
        the rank-one terms of the rows of a triangular factor, of which there
        are no more than entries in a vector."""
        if len(x) <= x.shape[1]:
            for v in x:
                self.add(v)
            return
        mean = x.mean(axis=0)
        factor = np.linalg.qr(x - mean, mode="r")
        self._terms(len(x), mean, zip(np.ones(len(factor)), factor, strict=True))

    def join(self, other: Spectrum) -> None:
        """The other spectrum's components are the rank-one terms."""
        if other.n:
            self._terms(other.n, other.mean, zip(np.maximum(other.roots, 0.0), other.basis.T, strict=True))

    def _terms(self, n: int, mean: np.ndarray, terms) -> None:
        for rho, vector in terms:
            self.roots, self.basis = rank_one(self.roots, self.basis, vector, float(rho))
        apart, both = mean - self.mean, self.n + n
        self.roots, self.basis = rank_one(self.roots, self.basis, apart, self.n * n / both)
        self.mean = self.mean + apart * (n / both)
        self.n = both


def vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): which rows hold ``size`` finite entries, and floor(SCALE * c) of those."""
    column = batch.column("embedding")
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), -1,
                      np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1))
    rows = np.nonzero(length == size)[0]
    values = column.take(pa.array(rows)).flatten()
    c = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)  # nulls become NaN
    with np.errstate(invalid="ignore"):
        good = (np.abs(c) < LIMIT).all(axis=1)
    return rows[good], np.floor(SCALE * c[good])


def spectra(pick: DataFrame, size: int) -> DataFrame:
    """One row a task: its vectors' number, exact sums, and spectrum."""
    target = to_arrow_schema(StructType.fromDDL(SPECTRUM))

    def run(batches):
        have, sums = Spectrum.of_none(size), np.zeros(size, np.int64)
        for batch in batches:
            _, x = vectors(batch, size)
            sums += x.astype(np.int64).sum(axis=0)
            for k in range(0, len(x), BLOCK):
                have.add_block(x[k:k + BLOCK])
        if have.n:
            yield _row(TaskContext.get().partitionId(), have, sums, target)

    return in_arrow(pick, run, SPECTRUM)


def _row(part: int, have: Spectrum, sums: np.ndarray, target: pa.Schema) -> pa.RecordBatch:
    made = (part, have.n, sums, have.mean, have.roots, have.basis.ravel())
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, target, strict=True)], schema=target)


def combined(rows: DataFrame, size: int) -> tuple[Spectrum, np.ndarray]:
    """The spectrum of all tasks and the sums: ``FAN_IN`` spectra a task and round."""
    target = to_arrow_schema(StructType.fromDDL(SPECTRUM))

    def merge(table: pa.Table) -> pa.Table:
        have, sums = Spectrum.of_none(size), np.zeros(size, np.int64)
        got = sorted(table.to_pylist(), key=lambda r: r["part"])
        for r in got:
            have.join(Spectrum(r["n"], np.array(r["mean"]), np.array(r["roots"]),
                               np.array(r["basis"]).reshape(size, size)))
            sums += np.array(r["sums"], np.int64)
        return pa.Table.from_batches([_row(got[0]["part"] // FAN_IN, have, sums, target)])

    rows = stored(rows, "spectra")
    most = rows.agg(F.max("part")).first()[0]
    if most is None:
        return Spectrum.of_none(size), np.zeros(size, np.int64)
    while most > 0:
        rows = stored(rows.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(merge, SPECTRUM), "spectra")
        most //= FAN_IN
    r = rows.first()
    return (Spectrum(r["n"], np.array(r["mean"]), np.array(r["roots"]), np.array(r["basis"]).reshape(size, size)),
            np.array(r["sums"], np.int64))


def moments(pick: DataFrame, size: int, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the projections (x - mean) * basis over all vectors."""
    k = basis.shape[1]

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x = vectors(batch, size)
            y = (x - mean) @ basis
            first += y.sum(axis=0)
            second += y.T @ y
        every = np.concatenate((first, second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every)), pa.int32()), pa.array(every)], ["at", "v"])

    # (k + 1) * k rows whatever the number of vectors.
    got = in_arrow(pick, run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * (k + 1))
    for r in got:
        out[r["at"]] = r["v"]
    return out[:k], out[k:].reshape(k, k)


class Whitener:
    """The fitted components: columns of ``basis`` by falling eigenvalue."""

    def __init__(self, size: int, n: int, sums: np.ndarray, basis: np.ndarray, roots: np.ndarray, trace: float):
        self.size, self.n, self.sums, self.basis, self.roots, self.trace = size, n, sums, basis, roots, trace
        self.identity_error = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    def scaled(self, components: int) -> np.ndarray:
        """Columns that project on the components and divide by the root of the
        eigenvalue; a component without variance projects on nothing."""
        e = self.roots[:components]
        flat = e <= 1e-13 * max(self.roots.max(initial=0.0), 0.0)
        return self.basis[:, :components] / np.where(flat, np.inf, np.sqrt(np.maximum(e, np.finfo(float).tiny)))


def fit(pick: DataFrame, components: int) -> Whitener:
    """Learn from all vectors of ``pick``'s column embedding."""
    lengths = (pick.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count()
               .orderBy(F.desc("count"), F.desc("d")).first())
    size = lengths["d"] if lengths else 0
    if not size:
        return Whitener(0, 0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    have, sums = combined(spectra(pick, size), size)
    model = Whitener(size, have.n, sums, np.eye(size), np.zeros(size), 0.0)
    if not have.n:
        return model
    # Rayleigh-Ritz: the covariance within the combined basis, solved exactly.
    basis = np.linalg.qr(have.basis[:, ::-1])[0]
    first, second = moments(pick, size, model.mean, basis)
    small = second / have.n - np.outer(first, first) / have.n ** 2
    roots, turn = np.linalg.eigh((small + small.T) / 2)
    basis = basis @ turn[:, ::-1]
    sign = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(size)])
    model.basis, model.roots, model.trace = basis * np.where(sign == 0, 1, sign), np.maximum(roots[::-1], 0.0), np.trace(small)
    w = model.scaled(components)
    first, second = moments(pick, size, model.mean, w)
    cov = second / have.n - np.outer(first, first) / have.n ** 2
    varies = np.abs(w).max(axis=0) > 0
    off = np.abs(cov - np.eye(len(varies)))[np.ix_(varies, varies)]
    model.identity_error = float(off.max(initial=0.0))
    return model


def whiten(table: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: (vec_id, component, n, deviation,
    whitened, explained, identity_error).

    Defined cases: a null vector, or one with a null or non-finite entry (or one
    of 2**40 or more), is left out, and so is a vector of another length than
    the commonest one (of ties: the longest); a null id keeps its rows; repeated
    rows count and are returned as often as they occur; a component without
    variance whitens to 0 and does not count for identity_error; one vector, or
    equal ones, have explained 0; deviation is null where it does not fit into a
    long; an empty table, or one without vectors, gives an empty result; other
    columns are not read.
    """
    pick = table.select(F.col(id_col).cast("long").alias("vec_id"),
                        F.col(vector_col).cast("array<double>").alias("embedding"))
    model = fit(pick, components)
    w = model.scaled(components)
    k = w.shape[1]
    explained = model.roots[:k] / model.trace if model.trace > 0 else np.zeros(k)
    size, n, sums, mean, error = model.size, model.n, model.sums, model.mean, model.identity_error

    def run(batch):
        rows, x = vectors(batch, size)
        apart = n * x.astype(np.int64) - sums
        fits = (apart.astype(float) ** 2).sum(axis=1) < 9.2e18
        deviation = (apart * apart).sum(axis=1)
        m = len(rows)
        return {"vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows, k))),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                "n": np.full(m * k, n), "deviation": pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                "whitened": ((x - mean) @ w).ravel(), "explained": np.tile(explained, m),
                "identity_error": np.full(m * k, error)}

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return pick.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in
                                                 (f.split() for f in schema.split(", ")[1:])])
    return map_batches(pick, run, schema)
