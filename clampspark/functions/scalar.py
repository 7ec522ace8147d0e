"""Scalar expressions: unit conversion, staircase arithmetic, text and metadata clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import MIN_AMP_PA, MV_PER_VOLT, PA_PER_VOLT, SAMPLE_RATE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def ms_to_samples(ms, rate=SAMPLE_RATE) -> Column:
    """Whole samples in ``ms``, truncated toward zero, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), (_c(ms) / 1000.0 * _c(rate)).cast("bigint"))


def ms_count(ms: float, rate: int = SAMPLE_RATE) -> int:
    """Driver-side twin of :func:`ms_to_samples` for fixed settings."""
    return max(0, int(ms / 1000.0 * rate))


def to_display(volts, scale) -> Column:
    return _c(volts) * _c(scale)


def command_to_volts(amplitude, clamp_mode, mv_per_volt=MV_PER_VOLT) -> Column:
    return F.when(_c(clamp_mode) == "voltage_clamp", _c(amplitude) / _c(mv_per_volt)).otherwise(
        _c(amplitude) / F.lit(PA_PER_VOLT)
    )


def achievable_rate(frame_rate, rate=SAMPLE_RATE) -> Column:
    """Frame rate left after rounding the trigger period down to whole samples."""
    period = F.greatest(F.lit(1).cast("bigint"), (_c(rate) / _c(frame_rate)).cast("bigint"))
    return _c(rate) / period


def step_amplitudes(lo, hi, step) -> Column:
    """Amplitudes from ``lo`` to ``hi`` inclusive; empty for a step that is not positive."""
    lo, hi, step = _c(lo), _c(hi), _c(step)
    n = F.floor((hi - lo + 1e-9) / step).cast("int")
    # least/greatest keep the sequence legal where the guard below discards it.
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.round(lo + k * step, 6))
    usable = (step > 0) & (hi - lo + 1e-9 >= 0)
    return F.when(usable, grid).otherwise(F.array().cast("array<double>"))


def expected_pulses(kind, lo, hi, step, repeats, min_amp=MIN_AMP_PA) -> Column:
    """Pulses a staircase should show above the threshold; null unless it is a full staircase."""
    lo, hi, step = _c(lo).cast("double"), _c(hi).cast("double"), _c(step).cast("double")
    seen = F.size(F.filter(step_amplitudes(lo, hi, step), lambda a: F.abs(a) >= min_amp))
    times = F.coalesce(F.nullif(_c(repeats), F.lit(0)), F.lit(1))
    full = (_c(kind) == "staircase") & lo.isNotNull() & hi.isNotNull() & (step > 0)
    return F.when(full, (seen * times).cast("bigint"))


def staircase_ms(lo, hi, step, width, gap, repeats) -> Column:
    """Planned staircase length; the step count is rounded half to even."""
    n = F.greatest(F.lit(1.0), F.bround((_c(hi) - _c(lo)) / _c(step)) + 1)
    period = F.coalesce(_c(width), F.lit(0.0)) + F.coalesce(_c(gap), F.lit(0.0))
    times = F.coalesce(F.nullif(_c(repeats), F.lit(0)), F.lit(1))
    valid = (_c(step) > 0) & _c(lo).isNotNull() & _c(hi).isNotNull()
    return F.when(valid, n * period * times).otherwise(F.lit(0.0))


def stimulus_ms(kind, lo, hi, step, width, gap, repeats, duration, pulse_ms) -> Column:
    """Planned stimulus length. ``pulse_ms`` is null when the protocol has no leading pulse."""
    lead = F.when(_c(pulse_ms).isNotNull(), _c(pulse_ms) + F.coalesce(_c(gap), F.lit(0.0))).otherwise(F.lit(0.0))
    return (
        F.when(_c(kind) == "staircase", lead + staircase_ms(lo, hi, step, width, gap, repeats))
        .when(_c(kind) == "voltage_step", F.coalesce(_c(duration), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def to_the_second(ts) -> Column:
    return F.substring_index(_c(ts), ".", 1)


def blank_if_falsy(x) -> Column:
    s = _c(x).cast("string")
    return F.when(s.isNull() | s.isin("", "0", "false"), F.lit("")).otherwise(s)


def when_drug(flag, x) -> Column:
    return F.when(F.coalesce(_c(flag), F.lit(False)), F.trim(F.coalesce(_c(x), F.lit("")))).otherwise(F.lit(""))


def missing_fields(required: dict[str, str]) -> Column:
    """Names of the required columns that are blank: ``required`` maps label to column."""
    marks = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(n)) for n, c in required.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def history_key(check_name) -> Column:
    """Check name as a column prefix."""
    spaced = F.translate(_c(check_name), " /", "__")
    return F.translate(spaced, "(),", "")


def truthy(x) -> Column:
    return F.coalesce(F.lower(_c(x).cast("string")).isin("true", "1", "yes"), F.lit(False))


def not_finite(x) -> Column:
    v = _c(x)
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def array_median(a: Column) -> Column:
    """Median of an array of bounded length; null when empty or with NaN."""
    s = F.array_sort(a)
    n = F.size(a)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    return F.when((n > 0) & ~F.exists(a, F.isnan), mid)
