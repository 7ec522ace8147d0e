"""Vector kernels numpy does better than SQL. Each sees one bounded array at a time: one second
of a channel, a trial, or the fit window of a sweep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..config import LINE_BAND_HZ, LINE_FREQS_HZ


def _welch(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: half-overlapping segments, periodic Hann, mean removed per segment."""
    n = min(x.size, rate)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segs = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    segs = segs - segs.mean(axis=1, keepdims=True)
    p = np.abs(np.fft.rfft(segs * win, axis=1)) ** 2 / (rate * np.sum(win**2))
    p[:, 1: (-1 if n % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(n, 1 / rate), p.mean(axis=0)


def _line_fraction(x: np.ndarray, rate: int, freqs, band: float) -> float | None:
    if x.size < rate or not np.all(np.isfinite(x)):
        return None
    f, p = _welch(x, rate)
    total = np.trapezoid(p, f)
    if not total > 0:
        return None
    line = 0.0
    for f0 in freqs:
        m = (f >= f0 - band) & (f <= f0 + band)
        line += np.trapezoid(p[m], f[m]) if m.any() else 0.0
    return float(line / total)


def line_fraction(samples: Column, rate: int, freqs=LINE_FREQS_HZ, band: float = LINE_BAND_HZ) -> Column:
    """Share of power within ``band`` of the line frequencies; null below one second of data or
    without any power."""
    freqs = tuple(freqs)

    @F.pandas_udf("double")
    def kernel(s: pd.Series) -> pd.Series:
        return pd.Series([_line_fraction(np.asarray(x, float), rate, freqs, band) for x in s], dtype="float64")
    return kernel(samples)


def line_power(samples: Column, rate: int, freqs=LINE_FREQS_HZ, band: float = LINE_BAND_HZ) -> Column:
    """One segment of Welch's method: struct of the power within ``band`` of the line frequencies, the whole power, and
    whether all samples are finite. A segment shorter than one second adds no power."""
    freqs = tuple(freqs)

    def one(x: np.ndarray) -> tuple[float, float, bool]:
        good = bool(np.all(np.isfinite(x)))
        if x.size < rate or not good:
            return 0.0, 0.0, good
        f, p = _welch(x, rate)
        near = [(f >= f0 - band) & (f <= f0 + band) for f0 in freqs]
        return float(sum(np.trapezoid(p[m], f[m]) for m in near)), float(np.trapezoid(p, f)), True

    @F.pandas_udf("line double, total double, good boolean")
    def kernel(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(np.asarray(x, float)) for x in s], columns=["line", "total", "good"])
    return kernel(samples)


def lag_of(expected: np.ndarray, recorded: np.ndarray) -> int:
    size = 1 << int(expected.size + recorded.size - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(recorded, size) * np.conj(np.fft.rfft(expected, size)), size)
    full = np.concatenate([full[size - expected.size + 1:], full[: recorded.size]])
    return int(np.argmax(np.abs(full))) - (expected.size - 1)


def xcorr_lag(expected: Column, recorded: Column, mean_e: Column, mean_r: Column, flat: Column) -> Column:
    """Lag in samples at the largest absolute cross-correlation, positive when ``recorded``
    trails; 0 for flat input. The whole of both arrays counts."""
    @F.pandas_udf(T.LongType())
    def lag(e: pd.Series, r: pd.Series, a: pd.Series, b: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([0 if k or not len(x) or not len(y) else lag_of(np.asarray(x, float) - m, np.asarray(y, float) - n)
                          for x, y, m, n, k in zip(e, r, a, b, f)], dtype="int64")
    return lag(expected, recorded, mean_e, mean_r, flat)


def _fit_decay(y: np.ndarray, rate: int) -> tuple:
    none = (None, None, None, False)
    if y.size < 3 or not np.all(np.isfinite(y)):
        return none
    t = np.arange(y.size) / rate
    p = np.array([y[-1], y[0] - y[-1], 0.005])
    damp = 1e-3

    def residual(q):
        return y - (q[0] + q[1] * np.exp(-t / max(q[2], 1e-6)))

    r = residual(p)
    for _ in range(400):
        tau = max(p[2], 1e-6)
        e = np.exp(-t / tau)
        jac = np.stack([np.ones_like(t), e, p[1] * e * t / tau**2], axis=1)
        h, g = jac.T @ jac, jac.T @ r
        try:
            step = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-30)), g)
        except np.linalg.LinAlgError:
            return none
        q = p + step
        rq = residual(q)
        if rq @ rq <= r @ r:
            small = np.all(np.abs(step) <= 1e-10 * (np.abs(p) + 1e-10))
            p, r, damp = q, rq, max(damp / 10, 1e-12)
            if small:
                return float(p[2] * 1000), float(p[0]), float(p[1]), True
        else:
            damp *= 10
            if damp > 1e12:
                # No direction improves the fit any more.
                return float(p[2] * 1000), float(p[0]), float(p[1]), True
    return none


def decay_fit(samples: Column, rate: int) -> Column:
    """Fit ``i_ss + d_i * exp(-t / tau)``: struct ``tau_ms, i_ss, d_i, converged``."""
    @F.pandas_udf("tau_ms double, i_ss double, d_i double, converged boolean")
    def kernel(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_fit_decay(np.asarray(x, float), rate) for x in s], columns=["tau_ms", "i_ss", "d_i", "converged"])
    return kernel(samples)
