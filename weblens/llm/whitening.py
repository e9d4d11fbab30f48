"""Embedding whitening: principal components to double precision from float32.

Every entry c of a vector becomes the integer x = floor(1024 c) + 100000. Three
passes over the table, each a sum per task that Spark adds up:

1. number of vectors and exact integer sums S per dimension;
2. the covariance V of x, centred before multiplying: x minus the integer part
   of the mean is exact, the fraction of the mean is taken off after it;
3. the covariance of the whitened rows, for the identity error.

Only the d x d covariance reaches the driver (d: the width of a vector). Its
eigenvectors are found in float32 and corrected there by Ogita-Aishima
iterations, matrix products in extended precision that double the correct
digits each time. Eigenvalues that the float32 vectors cannot tell apart form
clusters: inside a cluster the formula only makes the vectors orthonormal, so
the covariance is projected on the cluster's subspace, shifted by its mean
eigenvalue and solved again at the precision left, before the iteration goes
on. The sign of a component is the one that makes its largest entry positive.

Defined results: a vector that is null or holds a null, NaN or infinity is
dropped; so are vectors of another width than the commonest one (ties: the
widest). Entries are read as double; x is held between -2^62 and 2^62. A
component without variance (to double precision) has no scale: its ``whitened``
is null, and the identity error is over the others (0 if there are none);
``explained`` is null where no dimension varies. Repeated rows count each time.
An empty table, or one without usable vectors, gives no rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.session import cut, ship

SCALE, SHIFT = 1024, 100_000
_TOP = 1 << 62
#: Rows whose integers and products are held at once.
_BLOCK = 4096
_WIDE = np.longdouble


def _blocks(batch: pa.RecordBatch, width: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, x) of the usable vectors of a batch whose column 1
    holds the vectors, in blocks of rows of one width."""
    col = batch.column(1).cast(pa.list_(pa.float64()))
    sizes = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for w in [width] if width is not None else sorted(set(sizes.tolist()) - {-1, 0}):
        rows = np.flatnonzero(sizes == w)
        for i in range(0, len(rows), _BLOCK):
            at = rows[i:i + _BLOCK]
            c = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)  # null entries read as NaN
            ok = np.isfinite(c).all(axis=1)
            if ok.any():
                with np.errstate(over="ignore"):
                    f = np.clip(np.floor(c[ok] * SCALE), -float(_TOP), float(_TOP)).astype(np.int64)
                yield w, at[ok], np.clip(f + SHIFT, -_TOP, _TOP)


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Width, number of vectors and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        acc: dict[int, list] = {}
        for b in batches:
            for w, _, x in _blocks(b, None):
                n[w] = n.get(w, 0) + len(x)
                hi, lo = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                old = acc.setdefault(w, [0] * w)
                acc[w] = [o + (int(h) << 32) + int(v) for o, h, v in zip(old, hi, lo)]
        for w, s in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array([n[w]] * w, pa.int64()),
                                              pa.array([decimal.Decimal(v) for v in s], pa.decimal128(38, 0))], ["w", "dim", "n", "s"])

    sums = cut(vectors.mapInArrow(run, "w int, dim int, n long, s decimal(38,0)").groupBy("w", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "whitening-sums")
    best = sums.filter("dim = 0").orderBy(F.desc("n"), F.desc("w")).first()
    if best is None:
        return 0, 0, []
    return best.w, best.n, [int(r.s) for r in sums.filter(F.col("w") == best.w).orderBy("dim").collect()]


def _gram(parts: DataFrame, d: int) -> np.ndarray:
    """The d x d matrix that (cell, v) rows add up to; cells are of the upper triangle."""
    out = np.zeros((d, d))
    for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[divmod(r.cell, d)] = r.v
    return np.triu(out) + np.triu(out, 1).T


def _emit(g: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(g.ravel()[cells])], ["cell", "v"])


class Centre:
    """x minus the mean S / n as doubles: the integer part is taken off exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def covariance(vectors: DataFrame, centre: Centre) -> np.ndarray:
    d = len(centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cells = np.zeros((d, d)), np.flatnonzero(np.triu(np.ones((d, d), dtype=bool)).ravel())
        for b in batches:
            for _, _, x in _blocks(b, d):
                y = centre(x)
                g += y.T @ y
        yield _emit(g, cells)

    return _gram(vectors.mapInArrow(run, "cell long, v double"), d) / centre.n


def _clusters(lam: np.ndarray, gap: float) -> list[list[int]]:
    """Runs of eigenvalues, by size, whose neighbours lie within ``gap``."""
    order = np.argsort(-lam, kind="stable")
    runs = [[int(order[0])]]
    for a, b in zip(order, order[1:]):
        if lam[a] - lam[b] <= gap:
            runs[-1].append(int(b))
        else:
            runs.append([int(b)])
    return runs


def refine(v: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric ``v``, from
    approximate vectors ``x``, to double precision."""
    d = len(v)
    a, x = v.astype(_WIDE), x.astype(_WIDE)
    eye = np.eye(d, dtype=_WIDE)
    floor = 8 * np.finfo(np.float64).eps  # of the largest eigenvalue: closer ones are one to double precision
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        # symmetric to the last digit, else rounding over small gaps tilts the vectors
        r, s = (r + r.T) / 2, (s + s.T) / 2
        lam = np.diag(s) / (1 - np.diag(r))
        top = np.abs(lam).max()
        off = s - np.diag(np.diag(s))
        # what these vectors can tell apart
        gap = 2 * (np.sqrt((off * off).sum()) + top * np.sqrt((r * r).sum()))
        fine = gap <= floor * top * 1e-3
        gap = max(gap, floor * top)
        diff = lam[None, :] - lam[:, None]
        far = np.abs(diff) > gap
        e = np.where(far, (s + lam[None, :] * r) / np.where(far, diff, 1), r / 2)
        steep = far & (np.abs(e) > 0.1)
        if steep.any():  # too large for a first-order correction: solved in the cluster as well
            gap = np.abs(diff)[steep].max()
            far = np.abs(diff) > gap
            e = np.where(far, e, r / 2)
        x = x + x @ e
        if fine:
            break
        for g in _clusters(lam, gap):
            if len(g) > 1:
                # sub-solve: the covariance on the cluster's subspace, shifted by the
                # cluster's mean, so that the small differences keep their digits
                xs = x[:, g]
                sub = xs.T @ (a @ xs) - lam[g].mean() * (xs.T @ xs)
                _, w = np.linalg.eigh(((sub + sub.T) / 2).astype(np.float64))
                x[:, g] = xs @ w.astype(_WIDE)
    order = np.argsort(-lam, kind="stable")
    return lam[order].astype(np.float64), x[:, order].astype(np.float64)


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling, not below 0) and unit eigenvectors (columns)."""
    top = np.abs(v).max() if v.size else 0.0
    if not top:
        return np.zeros(len(v)), np.eye(len(v))
    _, x = np.linalg.eigh((v / top).astype(np.float32))
    lam, x = refine(v / top, x)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return np.maximum(lam, 0) * top, x * np.where(sign == 0, 1, sign)


class Whitener:
    """The fitted transform: mean, components, scales."""

    def __init__(self, centre: Centre, v: np.ndarray, k: int):
        lam, x = components(v)
        d = len(lam)
        self.centre, self.k = centre, min(k, d)
        e, self.vectors = lam[:self.k], x[:, :self.k]
        self.alive = e > (lam.max() if d else 0) * d * np.finfo(np.float64).eps
        trace = float(np.trace(v))
        self.explained = [float(q) / trace for q in e] if trace else [None] * self.k
        with np.errstate(divide="ignore"):
            self.project = np.where(self.alive, self.vectors / np.sqrt(np.where(self.alive, e, 1)), 0)
        self.identity_error = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.project

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exactly."""
        c = self.centre
        off = [s - c.n * int(w) for s, w in zip(c.sums, c.whole)]  # n x - S = n (x - whole) - off, 0 <= off < n
        y = x - c.whole
        top = (int(np.abs(y).max()) + 1) * c.n
        if top * top * x.shape[1] < 1 << 63:
            z = y * np.int64(c.n) - np.array(off, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * c.n - np.array(off, dtype=object)
        return (z * z).sum(axis=1).tolist()


def fit(vectors: DataFrame, k: int = 8) -> Whitener | None:
    """The transform of a table (id, vector): None if no vector is usable."""
    ship(vectors.sparkSession)
    d, n, sums = _sums(vectors)
    if not n:
        return None
    centre = Centre(n, sums)
    w = Whitener(centre, covariance(vectors, centre), k)
    k = w.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cells = np.zeros((k, k)), np.flatnonzero(np.triu(np.ones((k, k), dtype=bool)).ravel())
        for b in batches:
            for _, _, x in _blocks(b, d):
                z = w(x)
                g += z.T @ z
        yield _emit(g, cells)

    cov = _gram(vectors.mapInArrow(run, "cell long, v double"), k) / n
    live = np.flatnonzero(w.alive)
    if len(live):
        w.identity_error = float(np.abs(cov[np.ix_(live, live)] - np.eye(len(live))).max())
    return w


def whiten(table: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (exact), whitened, explained,
    identity_error: a row for each usable vector and component up to ``k``."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    w = fit(vectors, k)
    if w is None:
        return table.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dec = w.k, pa.decimal128(38, 0)
        for b in batches:
            for _, at, x in _blocks(b, len(w.centre.sums)):
                m = len(at)
                z = w(x)
                dev = pa.array([decimal.Decimal(q) if q < 10 ** 38 else None for q in w.deviations(x)], dec)
                rows = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.centre.n)), dev.take(rows),
                    pa.array(z.ravel(), mask=~np.tile(w.alive, m)), pa.array(w.explained * m, pa.float64()),
                    pa.array(np.full(m * k, w.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
