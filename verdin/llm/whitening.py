"""PCA whitening of vectors by incremental eigendecomposition.

Entries are taken as whole numbers: x = floor(scale * c) + offset.  Each partition keeps the spectrum of
the scatter of the vectors it has read: count, mean, eigenvalues, eigenvectors.  A vector (or w equal
ones) moves the mean and adds one centred rank-one term; the eigenvalues of diagonal plus rank one are
the roots of the secular equation, found between the old ones, after deflation of terms without weight
and of equal eigenvalues.  Two spectra combine through further rank-one updates: one for each
eigenpair of the other, one for the difference of the means.  Partition spectra meet in rounds of
bounded groups, so that neither a task nor the driver holds more than a few of them.  The basis so
found is refined by one distributed Rayleigh-Ritz step: the covariance is projected on it around the
exact mean, and the small projected matrix is solved.

Sums are exact integers.  Rows whose vector is null or empty, holds null or non-finite entries, or
entries too large for the whole-number form (2**40 and more after scaling), are left out; so are rows whose
vector is not as long as most of the remaining ones (of equally common lengths the largest counts).
Components without variance, to rounding, do not exist: one vector, or equal vectors, give no row.
Repeated rows each count.  An empty table gives no rows.  Other columns are never read.  The sign of a component is such that its
largest entry (of equally large ones the first) is positive.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from verdin.llm.common import ship_package, stored

SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0 ** 40
EPS = np.finfo(float).eps


# --- one symmetric matrix, known by its spectrum

def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """Differences d[i] - root[j] of the roots of 1 + rho * sum(z2 / (d - x)), for rising distinct d and
    positive z2 and rho: each root lies above d[j] and below the next one, and is measured from the
    nearer of the two, so that small differences stay exact."""
    k = len(d)
    wide = np.append(np.diff(d), rho * z2.sum())
    gaps = d[:, None] - d
    right = 1 + rho * (z2[:, None] / (gaps - wide / 2)).sum(axis=0) <= 0
    last = np.arange(k) == k - 1
    far = right & ~last                      # the nearer pole is the upper one
    delta = gaps - np.where(far, wide, 0.0)
    low = np.where(far, -wide / 2, np.where(right, wide / 2, 0.0))
    high = np.where(far, 0.0, np.where(right, wide, wide / 2))
    lower = np.triu(np.ones((k, k)))         # poles at or below the root
    near, next_ = np.where(far, -wide, 0.0), np.where(far, 0.0, wide)
    mu = (low + high) / 2
    weight = rho * z2[:, None]
    for _ in range(60):
        g = delta - mu
        t = weight / g
        psi = np.einsum("ij,ij->j", t, lower)
        phi = t.sum(axis=0) - psi
        value = 1 + psi + phi
        t /= g
        s = np.einsum("ij,ij->j", t, lower)
        u = t.sum(axis=0) - s
        u[-1] = 0.0
        # as near to zero as rounding of the terms and of the root itself lets it come
        open_ = np.abs(value) > EPS * (8 * (1 + np.abs(psi) + np.abs(phi)) + np.abs(mu) * (s + u))
        if not open_.any():
            break
        low, high = np.where(value < 0, mu, low), np.where(value > 0, mu, high)
        # the poles below as one, those above as another: a quadratic in the step
        p, q = near - mu, next_ - mu
        a = value - s * p - u * q
        b, c = a * (p + q) + s * p * p + u * q * q, p * q * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * a * c, 0.0))
            step = np.where(last, p * value / a, np.where(b <= 0, (b - root) / (2 * a), 2 * c / (b + root)))
        new = mu + step
        mu = np.where(open_, np.where((new > low) & ((new < high) | last & (new == high)), new, (low + high) / 2), mu)
    return delta - mu


class Spectrum:
    """Count, mean, and eigenvalues (rising) with eigenvectors (columns) of the scatter matrix about the mean."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add_term(self, v: np.ndarray, rho: float) -> None:
        """The matrix becomes itself + rho * v v^T."""
        z = self.vectors.T @ v
        size = float(np.sqrt(z @ z))
        rho = rho * size * size
        if not rho > 0:
            return
        z /= size
        d = self.values
        least = 8 * EPS * max(abs(d[0]), abs(d[-1]), rho)
        # deflation of equal eigenvalues: a reflection inside their space leaves weight on one of them
        if np.any(np.diff(d) <= least):
            a = 0
            while a < len(d):
                b = int(np.searchsorted(d, d[a] + least, "right"))
                if b - a > 1:
                    w = z[a:b].copy()
                    norm = float(np.sqrt(w @ w))
                    if norm > 0:
                        w[-1] += norm if w[-1] >= 0 else -norm
                        w /= np.sqrt(w @ w)
                        part = self.vectors[:, a:b]
                        self.vectors[:, a:b] = part - 2 * np.outer(part @ w, w)
                        z[a:b] -= 2 * w * (w @ z[a:b])
                        z[a:b - 1] = 0.0
                a = b
        # deflation of terms without weight
        on = np.flatnonzero(rho * np.abs(z) > least)
        if not len(on):
            return
        d, z = d[on], z[on]
        gaps = secular_roots(d, z * z, rho)
        # the weights for which these roots are exact, so that the new vectors are orthogonal
        ratio = -gaps / np.where(np.eye(len(on), dtype=bool), rho, d - d[:, None])
        turn = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), z)[:, None] / gaps
        turn /= np.sqrt((turn * turn).sum(axis=0))
        self.vectors[:, on] = self.vectors[:, on] @ turn
        self.values[on] = d - np.diagonal(gaps)
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """``times`` equal vectors."""
        delta = x - self.mean
        total = self.n + times
        if self.n:
            self.add_term(delta, self.n * times / total)
        self.mean = self.mean + delta * (times / total)
        self.n = total

    def combine(self, other: Spectrum) -> None:
        """All that ``other`` has read, through one update an eigenpair and one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.add_term(vector, float(value))
        delta, total = other.mean - self.mean, self.n + other.n
        if self.n:
            self.add_term(delta, self.n * other.n / total)
        self.mean = self.mean + delta * (other.n / total)
        self.n = total


# --- distributed steps

def whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows kept, their x as int64 rows) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    at = np.flatnonzero(right)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    c = np.asarray(flat.fill_null(np.nan), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        scaled = SCALE * c
        fine = (np.abs(scaled) < LARGEST).all(axis=1)
    return at[fine], np.floor(scaled[fine]).astype(np.int64) + OFFSET


def common_length(rows: DataFrame, vector: str) -> int:
    """The length of most usable vectors; 0 where there is none."""
    usable = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) < LARGEST))
    found = (rows.where(F.col(vector).isNotNull() & usable).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
             .where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    return found[0]["d"] if found else 0


def _partials(rows: DataFrame, start, step) -> DataFrame:
    """One state for each partition that has rows: ``step(state, batch)`` changes it."""
    def run(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                state = start() if state is None else state
                step(state, batch)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())],
                                             names=["part", "state"])
    return rows.mapInArrow(run, "part long, state binary")


def _gathered(parts: DataFrame, merge, name: str, state_bytes: int):
    """All states merged, in rounds of groups of bounded size; None without any."""
    fan = int(max(2, min(16, 64_000_000 // max(1, state_bytes))))
    parts = stored(parts, name)
    k = parts.count()

    def run(table: pa.Table) -> pa.Table:
        states = [pickle.loads(s) for s in table.column("state").to_pylist()]
        for other in states[1:]:
            merge(states[0], other)
        return pa.table({"part": pa.array([table.column("group")[0].as_py()], pa.int64()), "state": pa.array([pickle.dumps(states[0])], pa.binary())})

    while k > 1:
        groups = -(-k // fan)
        numbered = parts.withColumn("group", F.pmod("part", F.lit(groups)))
        parts = stored(numbered.groupBy("group").applyInArrow(run, "part long, state binary"), name)
        k = parts.count()
    found = parts.collect()
    return pickle.loads(found[0]["state"]) if found else None


@dataclass
class Whitening:
    """n vectors with per-dimension ``total``; the first components (rows) with their eigenvalues, and the trace."""
    dim: int
    n: int
    total: list
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - total / n, without cancellation: the whole part of the mean is taken off as an integer."""
        whole = np.array([t // self.n for t in self.total], np.int64)
        part = np.array([float(Fraction(t % self.n, self.n)) for t in self.total])
        return (x - whole) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list:
        """Exact sum over dimensions of (n * x - total)**2; None beyond 63 bits."""
        total = np.array(self.total, object)
        largest = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.total), default=0)
        if largest < 2 ** 62 and len(x):
            apart = self.n * x - total.astype(np.int64)
            if self.dim * int(np.abs(apart).max()) ** 2 < 2 ** 63:
                return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - t) ** 2 for v, t in zip(row, self.total, strict=True)) for row in x]
        return [v if v < 2 ** 63 else None for v in exact]


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors; None where there is none."""
    ship_package(rows.sparkSession)
    rows = rows.select(F.col(vector).alias("v"))
    dim = common_length(rows, "v")
    if not dim:
        return None

    def read(state, batch):
        x = whole_numbers(batch.column("v"), dim)[1]
        state["total"] = [t + int(s) for t, s in zip(state["total"], x.sum(axis=0), strict=True)]
        x, times = np.unique(x, axis=0, return_counts=True)   # equal vectors as one weighted term
        for v, k in zip(x.astype(float), times.tolist(), strict=True):
            state["spectrum"].add(v, k)

    def both(a, b):
        a["total"] = [s + t for s, t in zip(a["total"], b["total"], strict=True)]
        a["spectrum"].combine(b["spectrum"])

    first = _gathered(_partials(rows, lambda: {"total": [0] * dim, "spectrum": Spectrum(dim)}, read), both, "spectra", 8 * dim * dim)
    model = Whitening(dim, first["spectrum"].n, first["total"], np.zeros((0, dim)), np.zeros(0), 0.0)
    basis = np.linalg.qr(first["spectrum"].vectors)[0]
    sent = rows.sparkSession.sparkContext.broadcast((model, basis))   # dim x dim numbers

    def project(state, batch):
        about, q = sent.value
        y = about.centred(whole_numbers(batch.column("v"), dim)[1]) @ q
        state += y.T @ y

    def plus(a, b):
        a += b

    projected = _gathered(_partials(rows, lambda: np.zeros((dim, dim)), project), plus, "projected", 8 * dim * dim) / model.n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    model.trace = float(np.trace(projected))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > dim * EPS * max(values[-1], 0.0)]
    found = (basis @ turn[:, order]).T
    sign = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)]) if len(found) else np.zeros(0)
    model.components, model.eigenvalues = found * sign[:, None], values[order]
    return model


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    sent, k = rows.sparkSession.sparkContext.broadcast(model), len(model.eigenvalues)

    def measure(state, batch):
        w = sent.value.whitened(whole_numbers(batch.column("v"), sent.value.dim)[1])
        state += w.T @ w

    def plus(a, b):
        a += b

    got = _gathered(_partials(rows.select(F.col(vector).alias("v")), lambda: np.zeros((k, k)), measure), plus, "whitened", 8 * k * k)
    return float(np.abs(got / model.n - np.eye(k)).max(initial=0.0))


def transform(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each usable row and component: the key, component (from 1), n, deviation (null beyond 63
    bits), whitened, explained."""
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
                         StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType())])
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        k = len(m.eigenvalues)
        for batch in batches:
            at, x = whole_numbers(batch.column(1), m.dim)
            each = np.repeat(np.arange(len(at)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                 pa.array(np.full(len(each), m.n, np.int64)), pa.array(m.deviation(x), pa.int64()).take(pa.array(each)),
                 pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.eigenvalues / m.trace, len(at)))],
                names=[f.name for f in schema])

    return rows.select(key, vector).mapInArrow(run, schema)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """``transform`` by a model of the same rows, with its identity_error in every row."""
    model = fit(rows, vector, components)
    error = identity_error(rows, model, vector) if model is not None else None
    return transform(rows, model, key, vector).withColumn("identity_error", F.lit(error).cast("double"))
