"""Calibration statistics over recorded sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BLOCK_SAMPLES
from ..session import materialise
from ..functions.scalar import array_median
from .decay import decay_fits
from .quantiles import exact_median, window_medians
from .spectra import tones
from .store import Store, attach


def status_by(value: Column, warn: float, fail: float | None = None) -> Column:
    """``fail`` above one limit, ``warn`` above the other, else ``pass``."""
    out = F.when(value > fail, "fail") if fail is not None else None
    out = F.when(value > warn, "warn") if out is None else out.when(value > warn, "warn")
    return out.otherwise("pass")


def input_resistance(response: DataFrame, pulses: DataFrame, keys: list[str], ident: list[str],
                     size: int = BLOCK_SAMPLES) -> DataFrame:
    """Resistance of each pulse: median of its last half minus the baseline median, over the
    current. ``pulses`` has ``keys, ident, onset, offset, amplitude, base_start, base_end``."""
    on, off = F.col("onset"), F.col("offset")
    w = pulses.select(*keys, *ident, F.explode(F.array(
        F.struct(F.lit("steady").alias("kind"), (on + F.floor((off - on) / 2)).cast("bigint").alias("start"), off.cast("bigint").alias("end")),
        F.struct(F.lit("base").alias("kind"), F.col("base_start").cast("bigint").alias("start"), F.col("base_end").cast("bigint").alias("end")),
    )).alias("w")).select(*keys, *ident, "w.*")
    m = window_medians(response, materialise(w, "median-windows"), keys, [*keys, *ident, "kind"], "m", size)
    m = m.groupBy(*keys, *ident).agg(F.max(F.when(F.col("kind") == "steady", F.col("m"))).alias("steady"),
                                     F.max(F.when(F.col("kind") == "base", F.col("m"))).alias("base"))
    p = pulses.select(*keys, *ident, "amplitude").join(m, [*keys, *ident], "left")
    ok = F.abs("amplitude") >= 1e-9
    return p.withColumn("resistance", F.when(ok, (F.col("steady") - F.col("base")) / (F.col("amplitude") / 1000.0)))


def reference_check(resistances: DataFrame, expected: float, tolerance: float = 0.05) -> DataFrame:
    """Compare computed resistances with a known resistor."""
    dev = F.abs(F.col("resistance") - expected) / expected
    return resistances.withColumn("deviation", dev).withColumn("status", status_by(dev, tolerance))


def overlay_baseline(segments: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Median over segments of each segment's median before its onset."""
    before = F.slice("samples", F.lit(1), F.col("onset_in_segment").cast("int"))
    m = segments.select(*keys, ident, array_median(before).alias("_m"))
    return exact_median(m, keys, "_m", "rmp")


def step_medians(sweeps: DataFrame, keys: list[str], width: int, gap: int, baseline: int) -> DataFrame:
    """Baseline and plateau medians of each step of a calibration sweep.

    ``sweeps`` has ``keys, samples`` (one sweep, display units) and ``steps``, the amplitudes in
    order. Steps last ``width`` and are ``gap`` apart; the baseline is the ``baseline`` samples
    before the step, the plateau its last half. The first step has no baseline and is left out,
    as is any step the sweep does not reach.
    """
    s = sweeps.select(*keys, "samples", F.posexplode("steps").alias("step_no", "amplitude"))
    start = F.col("step_no") * (width + gap)
    base_from = F.greatest(F.lit(0), start - baseline)
    plateau_from, plateau_to = start + width // 2, start + width
    s = s.where((start > base_from) & (plateau_to <= F.size("samples")))
    return s.select(
        *keys, "step_no", "amplitude",
        array_median(F.slice("samples", base_from + 1, start - base_from)).alias("baseline"),
        array_median(F.slice("samples", plateau_from + 1, F.lit(width - width // 2))).alias("plateau"),
    ).withColumn("delta", F.col("plateau") - F.col("baseline"))


def current_linearity(steps: DataFrame, keys: list[str], expected: float) -> DataFrame:
    """Slope, fit quality and worst step of current steps against a known resistor (MOhm)."""
    s = steps.where("amplitude <> 0")
    dev = F.abs(F.col("delta") / F.col("amplitude") * 1000.0 - expected) / expected
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), (F.regr_slope("delta", "amplitude") * 1000.0).alias("slope_MOhm"),
        F.regr_intercept("delta", "amplitude").alias("intercept_mV"), F.regr_r2("delta", "amplitude").alias("r_squared"),
        F.max(dev).alias("worst_deviation"))
    off = F.abs(F.col("slope_MOhm") - expected) / expected
    status = (F.when(F.col("n_steps") < 2, "fail")
              .when((off > 0.05) | (F.col("r_squared") < 0.999) | (F.col("worst_deviation") > 0.05), "warn").otherwise("pass"))
    # A sweep without usable steps still gets its verdict.
    return steps.select(*keys).distinct().join(g, keys, "left").withColumn("status", F.when(F.col("n_steps").isNull(), "fail").otherwise(status))


def voltage_scaling(steps: DataFrame, keys: list[str], expected: float) -> DataFrame:
    """Resistance implied by voltage steps: per step and from the slope of current on voltage."""
    implied = F.when(F.col("delta") != 0, F.col("amplitude") / F.col("delta") * 1000.0)
    g = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.regr_slope("delta", "amplitude").alias("slope"),
        F.regr_intercept("delta", "amplitude").alias("intercept_pA"),
        F.max(F.abs(implied - expected) / expected).alias("worst_deviation"))
    g = g.withColumn("implied_R_from_slope", F.when(F.col("slope") != 0, 1000.0 / F.col("slope")))
    return g.withColumn("status", status_by(F.coalesce("worst_deviation", F.lit(0.0)), 0.05))


def narrowband_rms(store: Store, freqs: dict[str, float], rate: float) -> DataFrame:
    """RMS at single frequencies under a symmetric Hann window of the whole sweep.

    The sweep's length travels to its blocks; each gives three numbers and more per frequency, which add up.
    """
    keys = store.keys
    b = attach(store.blocks.select(*keys, "block_no", "block_start", "samples"), store.per_block(store.lengths()), keys)
    t = tones(b, keys, freqs, rate)
    g = t.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in t.columns if c not in keys])
    return g.select(*keys, *[
        (F.sqrt(F.lit(2.0)) * F.sqrt(F.col(f"c_{k}") ** 2 + F.col(f"s_{k}") ** 2) / F.col("sw")).alias(k) for k in freqs])


def crosstalk(store: Store, drive: float, background: float, rate: float) -> DataFrame:
    """Coupling at the drive frequency with the background bin taken out."""
    g = narrowband_rms(store, {"drive_rms": drive, "background_rms": background}, rate)
    c = F.sqrt(F.greatest(F.lit(0.0), F.col("drive_rms") ** 2 - F.col("background_rms") ** 2))
    return g.withColumn("coupled_rms", c).withColumn("status", status_by(F.col("coupled_rms"), 0.01, 0.05))


def period_stability(edges: DataFrame, all_keys: DataFrame, keys: list[str], rate: float, commanded: float) -> DataFrame:
    """Trigger period statistics from rising edges. ``all_keys`` lists keys with their threshold,
    null where the line is flat."""
    from .ordered import neighbour, segment_of
    e = neighbour(edges, keys, ["sample_index"], segment_of("sample_index"), {"sample_index": "_prev"}, ahead=False)
    p = (F.col("sample_index") - F.col("_prev")) / rate
    g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), F.avg(p).alias("mean_period_s"), F.stddev_pop(p).alias("std_period_s"))
    g = all_keys.join(g, keys, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)).cast("bigint"))
    g = g.withColumn("observed_rate_hz", 1.0 / F.col("mean_period_s")).withColumn("jitter_frac", F.col("std_period_s") / F.col("mean_period_s"))
    off = F.abs(F.col("observed_rate_hz") - commanded) / commanded
    status = (F.when(F.col("threshold").isNull() | (F.col("n_edges") < 3), "fail")
              .when((off > 0.005) | (F.col("jitter_frac") > 1e-3), "warn").otherwise("pass"))
    return g.withColumn("status", status)


def resting_baseline(samples: DataFrame, keys: list[str], scale: float = 1.0, limit: float = 10.0) -> DataFrame:
    """Median in display units, checked against zero."""
    m = exact_median(samples, keys, "v", "_m")
    return m.select(*keys, (F.col("_m") * scale).alias("resting")).withColumn("status", status_by(F.abs("resting"), limit))


def append_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Add wide rows to the history: when the columns differ, the union of both, sorted by name."""
    both = history.unionByName(rows, allowMissingColumns=True)
    return both if set(history.columns) == set(rows.columns) else both.select(*sorted(both.columns))


def history_rows(checks: DataFrame, run_keys: list[str], names: list[str], metrics: list[str]) -> DataFrame:
    """Checks of each run as one wide row: ``<check>__status`` and ``<check>__<metric>``.

    ``checks`` has ``run_keys, check_key, status, metrics MAP``. The columns are listed by the
    caller, so no pass over the data is needed to find them.
    """
    from ..plans.qc import worst
    cols = [worst("status").alias("overall_status")]
    for n in names:
        here = F.col("check_key") == n
        cols.append(F.max(F.when(here, F.col("status"))).alias(f"{n}__status"))
        cols += [F.max(F.when(here, F.try_element_at("metrics", F.lit(m)))).alias(f"{n}__{m}") for m in metrics]
    return checks.groupBy(*run_keys).agg(*cols)


def loopback_latency(sweeps: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Delay of each recorded sweep ``rec`` behind its command ``exp``."""
    from .kernels import xcorr_lag
    n = F.least(F.size("exp"), F.size("rec"))
    s = sweeps.select(*keys, F.slice("exp", F.lit(1), n).alias("exp"), F.slice("rec", F.lit(1), n).alias("rec"))

    def mean(a: str) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)

    flat = (F.array_max("exp") - F.array_min("exp") < 1e-9) | (F.array_max("rec") - F.array_min("rec") < 1e-9)
    lag = xcorr_lag(F.col("exp"), F.col("rec"), mean("exp"), mean("rec"), flat)
    r = s.select(*keys, (lag / rate * 1000.0).alias("lag_ms"))
    return r.withColumn("status", status_by(F.abs("lag_ms"), 0.5, 2.0))


def capacitance_tau(sweeps: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Decay constant of each sweep's onset response; a fit that fails is a warning."""
    from .kernels import decay_fit
    r = sweeps.select(*keys, decay_fit(F.col("samples"), rate).alias("_f")).select(*keys, "_f.*")
    return r.withColumn("status", F.when(F.col("converged"), "pass").otherwise("warn"))


def capacitance_fits(store: Store, rate: float) -> DataFrame:
    """:func:`decay_fits` of every stored sweep, of any length, with its status; a fit that fails is a warning."""
    return decay_fits(store, rate).withColumn("status", F.when(F.col("converged"), "pass").otherwise("warn"))
