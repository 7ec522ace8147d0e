"""Partial spectra and sums of blocks, one numpy pass per block; only a few numbers per block leave it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import LINE_BAND_HZ, LINE_FREQS_HZ
from .isolate import guarded


@lru_cache(16)
def _plan(rate: int, freqs: tuple, band: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periodic Hann window of one second, the needed bins, and each bin's weight in the line integral.

    Bins are 1 Hz apart. An integral by trapezoids over a run of bins counts its two ends half.
    """
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(rate) / rate)
    f = np.fft.rfftfreq(rate, 1 / rate)
    weight = np.zeros(len(f))
    for f0 in freqs:
        inside = np.flatnonzero((f >= f0 - band) & (f <= f0 + band))
        if len(inside) > 1:
            weight[inside] += 1
            weight[inside[[0, -1]]] -= 0.5
    bins = np.unique(np.concatenate([np.flatnonzero(weight), [0], [rate // 2] if rate % 2 == 0 else [len(f) - 1]])).astype(int)
    return win, bins, weight[bins]


def _powers(x: np.ndarray, energy: np.ndarray, rate: int, bins: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and whole power from the needed bins and the energy of the windowed segment (Parseval's theorem)."""
    win = _plan(rate, (), 0.0)[0]
    p = np.abs(x) ** 2
    last = len(np.fft.rfftfreq(rate)) - 1
    single = (bins == 0) | ((bins == last) & (rate % 2 == 0))
    p = np.where(single, p, 2 * p) / (rate * np.sum(win ** 2))
    # One-sided power sums to the energy; the trapezoid rule counts the first and last bin half.
    total = rate * energy / (rate * np.sum(win ** 2)) - 0.5 * (p[..., bins == 0].sum(-1) + p[..., bins == last].sum(-1))
    return (p * weight).sum(-1), total


def _segment_power(segs: np.ndarray, rate: int, freqs: tuple, band: float) -> tuple[float, float]:
    win, bins, weight = _plan(rate, freqs, band)
    y = (segs - segs.mean(axis=1, keepdims=True)) * win
    line, total = _powers(np.fft.rfft(y, axis=1)[:, bins], (y ** 2).sum(1), rate, bins, weight)
    return float(line.sum()), float(total.sum())


_PART = "struct<n:int,mean:double,wx:double,wxx:double,w:double,ww:double,re:array<double>,im:array<double>,wre:array<double>,wim:array<double>>"


def _partial(x: np.ndarray, at: int, rate: int, freqs: tuple, band: float) -> dict:
    """What part of a segment, beginning at its place ``at``, gives to the whole: sums around the part's own mean."""
    win, bins, _ = _plan(rate, freqs, band)
    place = np.arange(at, at + len(x))
    w = win[place]
    c = float(x.mean())
    y = x - c
    wave = np.exp(-2j * np.pi * ((place[:, None] * bins[None, :]) % rate) / rate)
    d, dw = (w * y) @ wave, w @ wave
    return {"n": len(x), "mean": c, "wx": float((w * w * y).sum()), "wxx": float((w * w * y * y).sum()), "w": float(w.sum()), "ww": float((w * w).sum()),
            "re": d.real.tolist(), "im": d.imag.tolist(), "wre": dw.real.tolist(), "wim": dw.imag.tolist()}


def spectra(blocks: DataFrame, keys: list[str], rate: int, freqs=LINE_FREQS_HZ, band: float = LINE_BAND_HZ) -> DataFrame:
    """Per block: one row with the powers of the segments inside it, and one per segment that crosses its border.

    Columns ``keys, _seg, _line, _total, _part, _good, _error``: ``_seg`` and ``_part`` are null in the former. A segment belongs to every half
    second; one that its recording ends before completing has no power, but its samples must be finite too. A block that raises has a
    row with its error instead.
    """
    freqs, hop = tuple(freqs), rate - rate // 2
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)

    part_type = pa.struct([("n", pa.int32()), *[(c, pa.float64()) for c in ("mean", "wx", "wxx", "w", "ww")], *[(c, pa.list_(pa.float64())) for c in ("re", "im", "wre", "wim")]])
    types = {"_seg": pa.int64(), "_line": pa.float64(), "_total": pa.float64(), "_part": part_type, "_good": pa.bool_()}

    def step(b: pa.RecordBatch):
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        out: dict[str, list] = {c: [] for c in (*keys, *types)}
        for i in range(b.num_rows):
            x = col["samples"][i].values.to_numpy(zero_copy_only=False).astype(float)
            start, end = col["block_start"][i].as_py(), col["block_start"][i].as_py() + len(x)
            good = bool(np.isfinite(x).all())
            first, last = -(-start // hop), (end - rate) // hop  # segments wholly inside
            line = total = 0.0
            rows = []
            if good and len(x):
                if last >= first:
                    view = np.lib.stride_tricks.sliding_window_view(x, rate)[first * hop - start::hop][:last - first + 1]
                    for a in range(0, len(view), 64):
                        p = _segment_power(view[a:a + 64], rate, freqs, band)
                        line, total = line + p[0], total + p[1]
                for s in range(max(0, (start - rate) // hop + 1), (end - 1) // hop + 1):
                    if not (last >= first and first <= s <= last):
                        lo, hi = max(s * hop, start), min(s * hop + rate, end)
                        rows.append((s, _partial(x[lo - start:hi - start], lo - s * hop, rate, freqs, band)))
            for seg, part in [(None, None), *rows]:
                for k in keys:
                    out[k].append(col[k][i].as_py())
                for c, v in zip(types, (seg, line if seg is None else None, total if seg is None else None, part, good)):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c) or col[c].type) for c, v in out.items()], names=list(out))

    def run(batches):
        yield from guarded(batches, step, keys, types)

    return blocks.select(*keys, "block_start", "samples").mapInArrow(run, f"{ddl}, _seg bigint, _line double, _total double, _part {_PART}, _good boolean, _error string")


def merged_power(parts: Column, rate: int, freqs=LINE_FREQS_HZ, band: float = LINE_BAND_HZ) -> Column:
    """Powers of one segment from its parts: struct ``line, total``; zero for a segment that is not whole."""
    freqs = tuple(freqs)

    def one(ps) -> tuple[float, float]:
        n = sum(p["n"] for p in ps)
        if n < rate:
            return 0.0, 0.0
        _, bins, weight = _plan(rate, freqs, band)
        m = sum(p["n"] * p["mean"] for p in ps) / n
        x, energy = np.zeros(len(bins), complex), 0.0
        for p in sorted(ps, key=lambda p: (p["w"], p["mean"])):
            c = p["mean"] - m
            x += np.asarray(p["re"]) + 1j * np.asarray(p["im"]) + c * (np.asarray(p["wre"]) + 1j * np.asarray(p["wim"]))
            energy += p["wxx"] + 2 * c * p["wx"] + c * c * p["ww"]
        line, total = _powers(x, np.float64(energy), rate, bins, weight)
        return float(line), max(float(total), 0.0)

    @F.pandas_udf("line double, total double")
    def kernel(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(list(p)) for p in s], columns=["line", "total"])
    return kernel(parts)


def tones(blocks: DataFrame, keys: list[str], freqs: dict[str, float], rate: float) -> DataFrame:
    """Sums of each block under a symmetric Hann window of the whole recording: ``keys, sw`` and per frequency a cosine and a sine sum.

    ``blocks`` has ``n_samples``, the recording's length. A block works with its own places; its sums are then turned by the phase at
    which it begins, so that long recordings lose no precision.
    """
    names = list(freqs)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    cols = ["sw", *[f"{p}_{k}" for k in names for p in ("c", "s")]]

    def run(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rows = np.zeros((b.num_rows, len(cols)))
            for i in range(b.num_rows):
                x = col["samples"][i].values.to_numpy(zero_copy_only=False).astype(float)
                there = ~np.isnan(x)
                start, n = col["block_start"][i].as_py(), col["n_samples"][i].as_py()
                j = np.arange(len(x))
                w = 0.5 - 0.5 * np.cos(2 * np.pi * (start + j) / (n - 1)) if n > 1 else np.ones(len(x))
                rows[i, 0] = w[there].sum()
                for k, name in enumerate(names):
                    z = (np.where(there, x, 0.0) * w) @ np.exp(2j * np.pi * freqs[name] / rate * j)
                    z *= np.exp(2j * np.pi * ((freqs[name] * start / rate) % 1.0))
                    rows[i, 1 + 2 * k], rows[i, 2 + 2 * k] = z.real, z.imag
            yield pa.RecordBatch.from_arrays([*[col[k] for k in keys], *[pa.array(rows[:, c]) for c in range(len(cols))]], names=[*keys, *cols])

    return blocks.select(*keys, "block_start", "n_samples", "samples").mapInArrow(run, ", ".join([ddl, *[f"`{c}` double" for c in cols]]))


def piece_errors(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of each piece ``part`` against its constant ``volts``: ``keys, part_start, volts, n, sq, worst, total, lo, hi, _error``."""
    cols = {"n": "bigint", "sq": "double", "worst": "double", "total": "double", "lo": "double", "hi": "double"}
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keys).schema] + ["part_start bigint, volts double"] + [f"{k} {t}" for k, t in cols.items()])

    types = {"part_start": pa.int64(), "volts": pa.float64(), "n": pa.int64(), **{c: pa.float64() for c in list(cols)[1:]}}

    def step(b: pa.RecordBatch):
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        off = col["part"].offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        x = col["part"].flatten().to_numpy(zero_copy_only=False).astype(float)
        v = col["volts"].to_numpy(zero_copy_only=False)
        e = x - np.repeat(v, np.diff(off))
        at = off[:-1]
        out = [np.diff(off), np.add.reduceat(e * e, at), np.maximum.reduceat(np.abs(e), at), np.add.reduceat(x, at), np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)]
        yield pa.RecordBatch.from_arrays([*[col[k] for k in keys], col["part_start"], col["volts"], *map(pa.array, out)], names=[*keys, *types])

    def run(batches):
        yield from guarded(batches, step, keys, types)

    src = pieces.select(*keys, F.col("part_start").cast("bigint").alias("part_start"), F.col("volts").cast("double").alias("volts"), "part").where(F.size("part") > 0)
    return src.mapInArrow(run, f"{ddl}, _error string")
