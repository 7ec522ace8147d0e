"""Lag of a command behind its recording, for trials of any length.

The cross-correlation of a long trial is worked out by a Fourier transform in four steps: the signal is laid out as a
matrix of R rows and C columns; columns are transformed, turned, and rows are transformed; the product of both spectra goes back
the same way. Each step is one shuffle of bounded pieces, so a trial may exceed any task's memory and n samples move a fixed
number of times. Trials that fit in a row are correlated directly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .kernels import lag_of

ROW = 1 << 15      # columns of a long trial's matrix
CELLS = 1 << 19    # complex numbers per signal in one task


def _geometry(n: int, row: int, cells: int) -> tuple[int, int, int, int]:
    """Padded length, rows, and the columns and rows of one piece."""
    m = 1 << max(0, 2 * n - 2).bit_length()
    c = min(m, row)
    r = m // c
    return m, r, max(1, min(c, cells // r)), max(1, min(r, cells // c))


def _turn(sign: int, k1: np.ndarray, n2: np.ndarray, m: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((k1[:, None] * n2[None, :]) % m) / m)


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _table(keys: list[str], head: dict, rows: dict[str, pa.Array]) -> pa.Table:
    n = len(next(iter(rows.values())))
    return pa.table({**{k: pa.array([head[k].as_py()] * n, head[k].type) for k in keys}, **rows})


def lags(pieces: DataFrame, keys: list[str], row: int = ROW, cells: int = CELLS) -> DataFrame:
    """``(keys, lag)``: the lag in samples at the largest absolute cross-correlation, positive when the recording trails.

    ``pieces`` has ``keys, at, rec, level, n, mean_r, mean_e``: recorded samples from position ``at`` of a trial of ``n`` positions, the
    command's constant level there, and both means, which are taken off. Positions without a piece count as zero; of equal
    correlations the smallest lag wins. Trials without pieces have no row.
    """
    if row & (row - 1):
        raise ValueError("a row's length must be a power of two")
    # A short trial's pieces meet as one array of at most row / 2 positions.
    small = pieces.where(F.col("n") * 2 <= row)
    whole = small.groupBy(*keys, "n", "mean_r", "mean_e").agg(F.collect_list(F.struct("at", "rec", "level")).alias("p"))

    def direct(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            out = []
            for ps, n, mean_r, mean_e in zip(col["p"].to_pylist(), col["n"].to_pylist(), col["mean_r"].to_pylist(), col["mean_e"].to_pylist()):
                e, r = np.zeros(n), np.zeros(n)
                for p in ps:
                    place = slice(p["at"], p["at"] + len(p["rec"]))
                    e[place], r[place] = p["level"] - mean_e, np.array(p["rec"], float) - mean_r
                out.append(lag_of(e, r))
            yield pa.RecordBatch.from_arrays([*[col[k] for k in keys], pa.array(out, pa.int64())], names=[*keys, "lag"])

    long = pieces.where(F.col("n") * 2 > row)
    return whole.mapInArrow(direct, f"{_ddl(pieces, keys)}, lag bigint").unionByName(_four_steps(long, keys, row, cells))


def _four_steps(pieces: DataFrame, keys: list[str], row: int, cells: int) -> DataFrame:
    ddl = _ddl(pieces, keys)

    def cut(batches):
        """Pieces of pieces that lie in one row and one group of columns."""
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                n, start = col["n"][i].as_py(), col["at"][i].as_py()
                rec = col["rec"][i].values.to_numpy(zero_copy_only=False).astype(float) - col["mean_r"][i].as_py()
                level = col["level"][i].as_py() - col["mean_e"][i].as_py()
                _, _, wide, _ = _geometry(n, row, cells)
                first = np.arange(start // wide, (start + len(rec) - 1) // wide + 1)
                lo, hi = np.maximum(first * wide, start), np.minimum((first + 1) * wide, start + len(rec))
                per = row // wide
                yield pa.RecordBatch.from_pydict({
                    **{k: pa.array([col[k][i].as_py()] * len(first), col[k].type) for k in keys}, "g": pa.array((first % per).astype(np.int32)), "r": pa.array(first // per),
                    "c": pa.array(lo - first * wide), "rec": pa.array([rec[x - start:y - start] for x, y in zip(lo, hi)], pa.list_(pa.float64())),
                    "level": pa.array(np.full(len(first), level)), "n": pa.array(np.full(len(first), n, np.int64))})

    def columns(t: pa.Table) -> pa.Table:
        """A group of columns: transform along the rows, turn, and deal out by groups of rows."""
        head = {k: t[k][0] for k in keys}
        n, g = t["n"][0].as_py(), t["g"][0].as_py()
        m, rows, wide, tall = _geometry(n, row, cells)
        both = np.zeros((2, rows, wide))
        for r, c, rec, level in zip(t["r"].to_pylist(), t["c"].to_pylist(), t["rec"], t["level"].to_pylist()):
            x = rec.values.to_numpy(zero_copy_only=False)
            both[0, r, c:c + len(x)], both[1, r, c:c + len(x)] = level, x
        spectrum = np.fft.fft(both, axis=1) * _turn(-1, np.arange(rows), g * wide + np.arange(wide), m)
        h = np.arange(0, rows, tall)
        return _table(keys, head, {"h": pa.array(h // tall, pa.int32()), "g": pa.array([g] * len(h), pa.int32()), "n": pa.array([n] * len(h), pa.int64()),
                                   "data": pa.array([np.ascontiguousarray(spectrum[:, x:x + tall]).tobytes() for x in h], pa.binary())})

    def rows_(t: pa.Table) -> pa.Table:
        """A group of rows: finish both spectra, multiply, and start the way back."""
        head = {k: t[k][0] for k in keys}
        n, h = t["n"][0].as_py(), t["h"][0].as_py()
        m, rows, wide, tall = _geometry(n, row, cells)
        tall = min(tall, rows - h * tall)
        both = np.zeros((2, tall, row), complex)
        for g, data in zip(t["g"].to_pylist(), t["data"]):
            both[:, :, g * wide:(g + 1) * wide] = np.frombuffer(data.as_buffer(), complex).reshape(2, tall, wide)
        spectrum = np.fft.fft(both, axis=2)
        k1 = h * _geometry(n, row, cells)[3] + np.arange(tall)
        back = np.fft.ifft(spectrum[1] * np.conj(spectrum[0]), axis=1) * _turn(1, k1, np.arange(row), m)
        g = np.arange(row // wide)
        return _table(keys, head, {"g": pa.array(g, pa.int32()), "h": pa.array([h] * len(g), pa.int32()), "n": pa.array([n] * len(g), pa.int64()),
                                   "data": pa.array([np.ascontiguousarray(back[:, x * wide:(x + 1) * wide]).tobytes() for x in g], pa.binary())})

    def best(t: pa.Table) -> pa.Table:
        """A group of columns of the correlation: its largest absolute value and that one's lag."""
        head = {k: t[k][0] for k in keys}
        n, g = t["n"][0].as_py(), t["g"][0].as_py()
        m, rows, wide, tall = _geometry(n, row, cells)
        x = np.zeros((rows, wide), complex)
        for h, data in zip(t["h"].to_pylist(), t["data"]):
            part = np.frombuffer(data.as_buffer(), complex).reshape(-1, wide)
            x[h * tall:h * tall + len(part)] = part
        z = np.abs(np.fft.ifft(x, axis=0).real)
        place = np.arange(rows)[:, None] * row + g * wide + np.arange(wide)[None, :]
        lag = np.where(place < n, place, place - m)
        ok = np.abs(lag) < n
        z, lag = z[ok], lag[ok]
        if not len(z):
            return _table(keys, head, {"size": pa.array([-1.0]), "lag": pa.array([0], pa.int64())})
        top = z.max()
        return _table(keys, head, {"size": pa.array([top]), "lag": pa.array([int(lag[z == top].min())], pa.int64())})

    parts = pieces.select(*keys, F.col("at").cast("bigint").alias("at"), "rec", F.col("level").cast("double").alias("level"), F.col("n").cast("bigint").alias("n"), "mean_r", "mean_e").mapInArrow(
        cut, f"{ddl}, g int, r bigint, c bigint, rec array<double>, level double, n bigint")
    one = parts.groupBy(*keys, "g").applyInArrow(columns, f"{ddl}, h int, g int, n bigint, data binary")
    two = materialise(one, "spectra").groupBy(*keys, "h").applyInArrow(rows_, f"{ddl}, g int, h int, n bigint, data binary")
    three = two.groupBy(*keys, "g").applyInArrow(best, f"{ddl}, size double, lag bigint")
    return three.groupBy(*keys).agg(F.max_by("lag", F.struct("size", -F.col("lag"))).alias("lag"))
