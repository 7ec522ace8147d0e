"""Whitening of embeddings by spectral divide-and-conquer on polar decompositions (QDWH).

Spark makes the vectors distinct, sums them exactly, and adds up partial covariances; one d x d matrix (d: the dimension)
comes to the driver, is split there into invariant subspaces, and goes back with the tasks. Nothing else grows with d, and
nothing on the driver grows with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clampspark.llm.text import column
from clampspark.session import materialise

SCALE = 256
TOP = 4
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration.

    Its eigenvalues are the signs of those of ``a``; an eigenvalue of zero stays undecided.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low, eye = min(max(low, EPS), 1.0), np.eye(n)
    for _ in range(30):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - l2) / (l2 * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            y = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        y = (y + y.T) / 2
        low = min(low * (wa + wb * l2) / (1 + wc * l2), 1.0)
        moved, x = np.linalg.norm(y - x), y
        if moved <= EPS ** (1 / 3) * np.sqrt(n) * 0.1 and 1 - low < 1e-12:
            break
    return x


def _shifts(a: np.ndarray):
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / n
    yield np.median(np.diag(a))
    for t in (0, 0.31, -0.31, 0.17, -0.17, 0.07, -0.07, 0.013, -0.013, 0.9, -0.9):
        yield mean + t * spread


def split(a: np.ndarray, rng) -> tuple[np.ndarray, int] | None:
    """Orthogonal basis whose first columns span the invariant subspace above a shift, and their number."""
    n, eye = len(a), np.eye(len(a))
    best = None
    for shift in _shifts(a):
        moved = a - shift * eye
        if not np.linalg.norm(moved):
            continue
        u = polar(moved)
        if np.linalg.norm(u @ u - eye) > 1e-8 * n:
            continue  # the shift is an eigenvalue: undecided
        upper = (eye + u) / 2
        k = int(round(np.trace(upper)))
        if not 0 < k < n:
            continue
        q = rng.standard_normal((n, n))
        for _ in range(3):
            q = np.linalg.qr(np.hstack([upper @ q[:, :k], q[:, k:] - upper @ q[:, k:]]))[0]
        off = np.linalg.norm(q[:, :k].T @ a @ q[:, k:])
        if best is None or off < best[0]:
            best = off, q, k
        if off <= 100 * n * EPS * np.linalg.norm(a):
            break
    return None if best is None else best[1:]


def eigen(a: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix; with ``top`` only the first ones.

    Each subspace is split at a shift by the projector of its polar factor until it is one-dimensional or its
    matrix is a multiple of the identity. A lower subspace is left unsplit where the upper one holds enough components.
    """
    a = (a + a.T) / 2
    whole, rng = np.linalg.norm(a), np.random.default_rng(7)
    want = len(a) if top is None else min(top, len(a))
    done: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(len(a))]
    while todo and len(done) < want:
        basis = todo.pop()
        m = basis.T @ a @ basis
        m = (m + m.T) / 2
        n, mean = len(m), np.trace(m) / len(m)
        parts = None
        if n > 1 and np.linalg.norm(m - mean * np.eye(n)) > 4 * n * EPS * whole:
            parts = split(m, rng)
        if parts is None:
            done += [(float(m[i, i]), basis[:, i]) for i in range(n)]
            continue
        q, k = parts
        q = basis @ q
        todo += [q[:, k:], q[:, :k]]  # the upper one is taken first
    done = sorted(done, key=lambda e: -e[0])[:want]
    if not done:
        return np.zeros(0), np.zeros((len(a), 0))
    vectors = np.stack([v / np.linalg.norm(v) for _, v in done], 1)
    return np.array([v @ a @ v for v in vectors.T]), vectors


@dataclass
class Whitening:
    n: int
    sums: list[int]           # exact, per dimension
    values: np.ndarray        # eigenvalues, falling
    vectors: np.ndarray       # unit eigenvectors as columns
    trace: float
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def vectors(rows: DataFrame, name: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rows`` with the vector as array of longs ``x``: floor of ``scale`` times each entry. Rows whose vector is null or holds a
    null or non-finite entry are dropped, as are empty vectors; an entry beyond the range of a long becomes its end."""
    def finite(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))

    v = F.col(name).cast("array<double>")
    good = rows.where(F.col(name).isNotNull() & (F.size(name) > 0)).where(F.forall(v, finite))
    return good.withColumn(name, F.transform(v, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))).withColumnRenamed(name, "x")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    x = column(batch, "x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), dim)


def _reach(x: np.ndarray) -> int:
    """Largest absolute entry (that of the smallest long has no long of its own)."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _triangle(m: np.ndarray):
    i, j = np.triu_indices(len(m))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["i", "j", "v"])


def _collect(parts: DataFrame, dim: int) -> np.ndarray:
    out = np.zeros((dim, dim))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # at most dim * (dim + 1) / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """``x`` minus the mean: the mean's whole part exactly, then its rest."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    if _reach(x) >= 1 << 61:
        return x.astype(float) - (base.astype(float) + rest)
    return (x - base).astype(float) - rest


def fit(x: DataFrame, top: int = TOP) -> Whitening | None:
    """Fit on every distinct vector of ``x`` once; None where there is none.

    The dimension is the commonest length among distinct vectors (ties: the shorter one); others are left out. A direction
    without variance (below ``dim * eps`` of the trace) has no component.
    """
    fits = materialise(x.select("x").distinct(), "vectors")
    widths = fits.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if widths is None:
        return None
    dim, n = int(widths["d"]), int(widths["count"])
    fits = fits.where(F.size("x") == dim)

    def add(batches):
        total = [0] * dim
        for b in batches:
            m = _matrix(b, dim)
            if _reach(m) < 1 << 40:
                part = m.sum(0).tolist()
            else:
                part = m.astype(object).sum(0).tolist()
            total = [a + int(p) for a, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    got = {r.i: int(r.s) for r in fits.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    sums = [got[i] for i in range(dim)]

    def spread(batches):
        m = np.zeros((dim, dim))
        for b in batches:
            y = _centred(_matrix(b, dim), sums, n)
            m += y.T @ y
        yield _triangle(m)

    v = _collect(fits.mapInArrow(spread, "i int, j int, v double"), dim) / n
    trace = float(np.trace(v))
    values, vecs = eigen(v, top) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    good = values > dim * EPS * trace
    model = Whitening(n, sums, values[good], vecs[:, good], trace, 0.0)
    k = len(model.values)

    def white(batches):
        m = np.zeros((k + 1, k + 1))  # the last row and column hold the sums
        for b in batches:
            w = transform(_matrix(b, dim), model)
            w = np.hstack([w, np.ones((len(w), 1))])
            m += w.T @ w
        yield _triangle(m)

    if k:
        m = _collect(fits.mapInArrow(white, "i int, j int, v double"), k + 1) / n
        model.identity_error = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())
    return model


def transform(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.sums, model.n) @ model.vectors / np.sqrt(model.values)


def _deviations(x: np.ndarray, model: Whitening) -> list[int] | np.ndarray:
    """Sum over dimensions of (n x - S)^2, exactly."""
    top = _reach(x)
    span = model.n * top + max((abs(s) for s in model.sums), default=0)
    if span * span * model.dim < 1 << 63:
        d = x * model.n - np.array(model.sums, np.int64)
        return (d * d).sum(1)
    d = x.astype(object) * model.n - np.array(model.sums, object)
    return [int(v) for v in (d * d).sum(1)]


def apply(x: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """Whitened coordinates of every row of ``x(key, x, ...)`` of the model's dimension: a row per component. No shuffle.

    ``deviation`` is null where it exceeds a long; ``deviation_text`` has it in any case. Null and repeated keys are rows of their own.
    """
    k, dim = len(model.values), model.dim
    explained = model.values / model.trace if k else np.zeros(0)

    def run(batches):
        for b in batches:
            if not b.num_rows or not k:
                continue
            m = _matrix(b, dim)
            w, dev = transform(m, model), _deviations(m, model)
            at = np.repeat(np.arange(len(m)), k)
            fits = pa.array([int(v) if v < 1 << 63 else None for v in dev], pa.int64())
            text = pc.cast(fits, pa.string()) if not fits.null_count else pa.array([str(v) for v in dev])
            rows = len(at)
            yield pa.RecordBatch.from_arrays([
                column(b, "_key").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(rows, model.n, np.int64)),
                fits.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(rows, model.identity_error)), text.take(pa.array(at))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])

    kind = x.schema[key].dataType.simpleString()
    src = x.where(F.size("x") == dim).select(F.col(key).alias("_key"), "x")
    return src.mapInArrow(run, f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
