"""Step analysis, calibration, kernels and checks on inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clampspark.functions import scalar as X
from clampspark.operators.blocks import pack
from clampspark.operators.store import land
from clampspark.operators import blocks as B, calibration as C, decimate, kernels, stimulus as S
from clampspark.plans import qc, steps
from clampspark.operators.protocols import decode, unknown_keys

KEY = ["recording_id"]


def test_known_resistor(spark):
    """Vm = -65 mV + I * 0.5 mV/pA, that is 500 MOhm."""
    rate = 1000
    cmd = np.zeros(6000)
    cmd[500:800] = -50.0
    for k, a in enumerate(range(-40, 41, 20)):
        cmd[1000 + k * 200:1100 + k * 200] = a
    cmd[3000:3100] = 60.0
    vm = -65 + 0.5 * cmd
    rows = [(1, c, i, float(v)) for c, t in ((2, cmd), (0, vm)) for i, v in enumerate(t)]
    # Recording 2 has no events at all, so its staircases come from the waveform.
    rows += [(2, c, i, float(v)) for c, t in ((2, cmd), (0, vm)) for i, v in enumerate(t)]
    b = B.pack(spark.createDataFrame(rows, "recording_id bigint, channel_index int, sample_index bigint, v double"), ["recording_id", "channel_index"], 512, 11)
    ev = spark.createDataFrame([(1, 0, 400, "apply", "s", 0), (1, 1, 2500, "clear", "s", 0)],
                               "recording_id bigint, event_seq bigint, sample_index bigint, event_type string, stimulus_name string, stimulus_index int")
    n = spark.createDataFrame([(1, 6000), (2, 6000)], "recording_id bigint, n_samples bigint")
    runs = spark.createDataFrame([(1, 0, 0, True)], "recording_id bigint, run_seq bigint, start_sample bigint, has_pulse boolean")
    cfg = steps.StepSettings(rate=rate, block=512, halo=11, max_gap_ms=500.0)
    part = {c: b.where(F.col("channel_index") == c).drop("channel_index") for c in (0, 2)}
    out = steps.intrinsics(part[2], part[0], ev, n, runs, KEY, cfg)
    got = {(r.recording_id, r.staircase_index): r for r in out.collect()}
    a = got[1, 0]
    assert (a.n_steps, a.min_amp_pA, a.max_amp_pA, a.rmp_mV) == (4, -40.0, 40.0, -65.0)
    assert a.input_resistance_MOhm == pytest.approx(500.0)
    assert (a.t_start_s, a.t_end_s) == (1.0, 1.9)
    assert got[2, 0].stimulus_name == "unknown" and got[2, 0].n_steps == 4
    # A gap-grouped staircase starts at its first pulse and so has no baseline.
    assert got[2, 0].rmp_mV is None and got[2, 0].input_resistance_MOhm is None
    assert got[2, 1].n_steps == 1 and len(got) == 3


def test_calibration_of_a_resistor(spark):
    amps = [float(a) for a in range(-100, 101, 20)]
    width, gap = 40, 40
    wave = np.concatenate([np.concatenate([np.full(width, a), np.zeros(gap)]) for a in amps])
    df = spark.createDataFrame([(1, (wave * 0.5).tolist(), amps), (2, (wave * 0.6).tolist(), amps), (3, [0.0] * 20, amps)],
                               "recording_id bigint, samples array<double>, steps array<double>")
    st = C.step_medians(df, KEY, width, gap, 10)
    assert st.where("recording_id = 1 AND step_no = 0").count() == 0      # the first step has no baseline
    r = {x.recording_id: x for x in C.current_linearity(st, KEY, 500.0).collect()}
    assert r[1].slope_MOhm == pytest.approx(500.0) and r[1].r_squared == pytest.approx(1.0) and r[1].status == "pass"
    assert r[2].slope_MOhm == pytest.approx(600.0) and r[2].status == "warn"
    v = C.voltage_scaling(C.step_medians(df.withColumn("samples", F.transform("samples", lambda x: x * 4)), KEY, width, gap, 10), KEY, 500.0)
    v = {x.recording_id: x for x in v.collect()}
    assert v[1].implied_R_from_slope == pytest.approx(500.0) and v[1].status == "pass"


def test_welch_against_the_formula(spark):
    rate = 500
    t = np.arange(rate * 4) / rate
    rng = np.random.default_rng(0)
    x = np.sin(2 * np.pi * 60 * t) + rng.normal(0, 0.3, t.size)
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / rate) for i in range(rate)])
    acc = []
    for s in range(0, x.size - rate + 1, rate // 2):
        seg = x[s:s + rate] - x[s:s + rate].mean()
        p = np.abs(np.fft.rfft(seg * w)) ** 2 / (rate * (w**2).sum())
        p[1:-1] *= 2
        acc.append(p)
    p, f = np.mean(acc, axis=0), np.fft.rfftfreq(rate, 1 / rate)
    area = lambda m: np.trapezoid(p[m], f[m])
    want = sum(area((f >= h - 2) & (f <= h + 2)) for h in (60, 120, 180)) / area(f >= 0)
    df = spark.createDataFrame([(1, x.tolist()), (2, [1.0] * 600), (3, x[:100].tolist())], "k int, s array<double>")
    got = {r.k: r.f for r in df.select("k", kernels.line_fraction(F.col("s"), rate).alias("f")).collect()}
    assert got[1] == pytest.approx(want, rel=1e-9) and got[1] > 0.5
    assert got[2] is None and got[3] is None


def test_lag_against_full_correlation(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k, shift in enumerate((0, 3, -4, 11)):
        e = rng.normal(size=80)
        r = np.roll(e, shift) + rng.normal(0, 0.05, 80)
        full = np.correlate(r - r.mean(), e - e.mean(), "full")
        want[k] = int(np.argmax(np.abs(full))) - 79
        rows.append((k, e.tolist(), r.tolist(), float(e.mean()), float(r.mean()), False))
    rows.append((9, [1.0] * 5, [1.0] * 5, 1.0, 1.0, True))
    df = spark.createDataFrame(rows, "k int, e array<double>, r array<double>, me double, mr double, flat boolean")
    got = {r.k: r.l for r in df.select("k", kernels.xcorr_lag(*[F.col(c) for c in ("e", "r", "me", "mr", "flat")]).alias("l")).collect()}
    assert got == {**want, 9: 0}


@pytest.mark.parametrize("tau_ms", [1.0, 5.0, 16.5])
def test_decay_fit(spark, tau_ms):
    t = np.arange(400) / 20000
    y = 3.0 + 90.0 * np.exp(-t / (tau_ms / 1000))
    df = spark.createDataFrame([(1, y.tolist())], "k int, samples array<double>")
    r = C.capacitance_tau(df, ["k"], 20000).first()
    assert r.tau_ms == pytest.approx(tau_ms, rel=1e-5) and r.i_ss == pytest.approx(3.0, abs=1e-3) and r.status == "pass"


@pytest.mark.parametrize("n", [0, 1, 20, 21, 103])
def test_minmax_decimation(spark, n, tmp_path):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 1.0)], "recording_id bigint, sample_index bigint, v double")
    store = land(pack(df, KEY, 16, 2), str(tmp_path / "store"), KEY, 16)
    got = sorted((r.sample_index, r.v) for r in decimate.minmax_decimate(store, 20).where("recording_id = 1").collect())
    if n <= 20:
        assert got == list(enumerate(x))
        return
    size = n // 10
    want = []
    for b in range(10):
        seg = x[b * size:(b + 1) * size]
        want += [(b * size + int(seg.argmin()), seg.min()), (b * size + int(seg.argmax()), seg.max())]
    assert got == sorted(want)


def test_event_check_and_windows(spark):
    ev = [(1, 0, 5, "apply", 0), (1, 1, 9, "apply", 0), (1, 2, 7, "clear", 1), (1, 3, 12, "clear", 0), (1, 4, 20, "apply", 2), (2, 0, 1, "apply", 0), (2, 1, 3, "clear", 0)]
    e = spark.createDataFrame(ev, "recording_id bigint, event_seq bigint, sample_index bigint, event_type string, stimulus_index int").withColumn("stimulus_name", F.lit("s"))
    n = spark.createDataFrame([(1, 20), (2, 10)], "recording_id bigint, n_samples bigint")
    r = {x.recording_id: x for x in qc.events(e, n, KEY).collect()}
    assert r[1].message == ("sample indices go back; 1 events beyond the 20 samples; stimulus 0 started again while on")
    assert r[1].unclosed == [2] and r[1].n_orphan == 1 and r[1].status == "warn"
    assert (r[2].status, r[2].message, r[2].unclosed) == ("pass", "", [])
    w = sorted((x.recording_id, x.start, x.end) for x in S.apply_windows(e, n, KEY).collect())
    assert w == [(1, 5, 9), (2, 1, 3)]          # the window 9 to 7 is empty, the one at 20 lies behind the end
    p = sorted((x.recording_id, x.stimulus_index, x.start, x.end, x.open) for x in S.paired_windows(e, n, KEY).collect())
    assert p == [(1, 0, 9, 12, False), (2, 0, 1, 3, False)]   # the one at 20 lies behind the end


def test_failing_check_is_reported(spark):
    recs = spark.createDataFrame([(1,), (2,)], "recording_id bigint")

    def broken():
        raise ValueError("no such column")
    r = qc.run_checks({"x": broken}, recs, KEY, "Signal").collect()
    assert {(x.recording_id, x.status, x.message) for x in r} == {(1, "fail", "not carried out: no such column"), (2, "fail", "not carried out: no such column")}


def test_amplitudes_and_plan(spark):
    df = spark.createDataFrame([(-50.0, 50.0, 10.0), (0.0, 0.3, 0.1), (5.0, 1.0, 1.0), (0.0, 10.0, 0.0), (0.0, 10.0, 3.0)], "lo double, hi double, st double")
    got = [r.a for r in df.select(X.step_amplitudes("lo", "hi", "st").alias("a")).collect()]

    def plain(lo, hi, st):
        out, v = [], lo
        while st > 0 and v <= hi + 1e-9:
            out.append(round(v, 6))
            v += st
        return out
    assert got == [plain(*r) for r in [(-50.0, 50.0, 10.0), (0.0, 0.3, 0.1), (5.0, 1.0, 1.0), (0.0, 10.0, 0.0), (0.0, 10.0, 3.0)]]
    r = spark.range(1).select(
        X.staircase_ms(F.lit(0.0), F.lit(25.0), F.lit(10.0), F.lit(1.0), F.lit(0.0), F.lit(1)).alias("half_even"),
        X.ms_to_samples(F.lit(-3.0)).alias("neg"), X.ms_to_samples(F.lit(0.0749)).alias("cut"), X.achievable_rate(F.lit(33.0)).alias("rate")).first()
    assert (r.half_even, r.neg, r.cut) == (3.0, 0, 1) and r.rate == 20000 / 606


def test_protocol_decode(spark):
    rows = [('{"version": 1, "name": "p", "hyperpolarization": null, "stimuli": [{"type": "baseline"}]}',), ('{"hyperpolarization": {"amplitude_pA": -20}, "odd": 1}',), ("not json",)]
    r = [x.p for x in spark.createDataFrame(rows, "j string").select(decode(F.col("j")).alias("p")).collect()]
    assert r[0].name == "p" and r[0].hyperpolarization is None and r[0].stimuli[0].min_pA == -50.0 and r[0].pre_ms == 1000.0
    assert r[1].hyperpolarization.amplitude_pA == -20.0 and r[1].hyperpolarization.duration_ms == 100.0 and r[1].stimuli == []
    assert r[2] is None
    odd = [x.k for x in spark.createDataFrame(rows[:2], "j string").select(unknown_keys(F.col("j")).alias("k")).collect()]
    assert odd == [[], ["odd"]]


def test_recordings_without_events_are_skipped(spark):
    log = spark.createDataFrame([(1, 5, 5, "apply", 0), (1, 9, 9, "clear", 0)], "recording_id bigint, event_seq bigint, sample_index bigint, event_type string, stimulus_index int")
    n = spark.createDataFrame([(1, 20), (2, 20)], "recording_id bigint, n_samples bigint")
    got = {r.recording_id: (r.status, r.n_events) for r in qc.events(log, n, ["recording_id"]).collect()}
    assert got == {1: ("pass", 2), 2: ("skip", 0)}
