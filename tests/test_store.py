"""The stored block table and what is answered from it, against numpy; plans that leave the samples where they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clampspark.operators import align, blocks as B, correlate, decimate, intervals as I, kernels, spectra
from clampspark.operators.calibration import narrowband_rms
from clampspark.operators.quantiles import window_medians
from clampspark.operators.store import extremes, land, open_store
from clampspark.plans import qc

KEY = ["rec"]
SIZE = 48


def exchanged_arrays(df) -> list[str]:
    """Exchanges of ``df``'s plan that carry an array of samples."""
    out = []

    def visit(node):
        if node.nodeName() in ("Exchange", "BroadcastExchange"):
            cols = node.output()
            out.extend(node.nodeName() for i in range(cols.size()) if "array<double>" in cols.apply(i).dataType().simpleString())
        kids = node.children()
        for i in range(kids.size()):
            visit(kids.apply(i))
    plan = df._jdf.queryExecution().executedPlan()
    visit(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return out


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(8)
    out = {r: np.round(g.standard_normal(n).cumsum(), 2) + 30 * (r == 2) for r, n in ((0, 5), (1, 48), (2, 1000), (3, 4 * 48 * 16 + 1), (4, 700))}
    out[4][[0, 100, 101, 699]] = np.nan
    out[1][:] = out[1].round(0)
    return out


@pytest.fixture(scope="module")
def store(spark, data, tmp_path_factory):
    rows = [(r, i, float(v)) for r, x in data.items() for i, v in enumerate(x) if not (r == 2 and 200 <= i < 210)]
    s = spark.createDataFrame(rows, "rec int, sample_index long, v double")
    path = str(tmp_path_factory.mktemp("store"))
    land(B.pack(s, KEY, SIZE, 11), path, KEY, SIZE, buckets=6)
    return open_store(spark, path, KEY, SIZE)


@pytest.fixture(scope="module")
def gone(data):
    """The data as stored: a stretch of recording 2 is missing."""
    x = {r: v.copy() for r, v in data.items()}
    x[2][200:210] = np.nan
    return x


@pytest.fixture()
def apart(spark):
    """No broadcast, so that every join shows how it would run on a cluster."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_extremes_of_any_window(spark, store, gone, apart):
    g = np.random.default_rng(1)
    rows, want = [], {}
    for r, x in gone.items():
        for k in range(40):
            a, b = sorted(g.integers(0, len(x) + 20, 2).tolist())
            if k < 3:
                a, b = [(0, len(x)), (SIZE, 3 * SIZE), (5, 6)][k]
            rows.append((r, k, a, b, len(x)))
            part = x[a:b]
            good = np.flatnonzero(~np.isnan(part))
            if len(part):
                lo = good[part[good].argmin()] if len(good) else None
                hi = good[part[good].argmax()] if len(good) else None
                want[r, k] = (None if lo is None else (part[lo], a + lo, part[hi], a + hi)), len(part), len(good)
    w = spark.createDataFrame(rows, "rec int, k int, start long, end long, n_samples long")
    out = extremes(store, w, ["k"])
    assert exchanged_arrays(out) == []
    got = {(r.rec, r.k): (None if r.lo is None else (r.lo, r.lo_at, r.hi, r.hi_at), r.n, r.n_good) for r in out.collect()}
    assert got == want
    assert store.nodes.where("level > 4").count() > 0
    firsts = {r.rec: r.nan_at for r in extremes(store, w.where("k = 0"), ["k"]).collect()}
    assert firsts[4] == 0 and firsts[2] is None  # missing samples are no NaN


def test_decimation_from_nodes(store, gone, apart):
    out = decimate.minmax_decimate(store, 20)
    assert exchanged_arrays(out) == []
    got = {}
    for r in out.collect():
        got.setdefault(r.rec, []).append((r.sample_index, r.v))
    assert len(got[0]) == 5 and len(got[3]) == 20
    for r in (2, 3):
        x, want = gone[r], []
        w = len(x) // 10
        for k in range(10):
            a, b = k * w, len(x) if k == 9 else (k + 1) * w
            want += [a + int(np.nanargmin(x[a:b])), a + int(np.nanargmax(x[a:b]))]
        assert sorted(i for i, _ in got[r]) == sorted(want)
    assert sum(v != v for _, v in got[4]) == 3   # bins with a NaN show it as their highest


def test_adaptive_edges_open_few_blocks(spark, store, gone, apart):
    out = align.adaptive_edges(store, 2.0)
    assert exchanged_arrays(out) == []
    got = {}
    for r in out.collect():
        got.setdefault(r.rec, []).append(r.sample_index)
    for r in (0, 1, 3):
        x = gone[r]
        t = (x.min() + x.max()) / 2
        want = (np.flatnonzero((x[1:] > t) & (x[:-1] <= t)) + 1).tolist() if x.max() - x.min() >= 2 else []
        assert sorted(got.get(r, [])) == want
    t = {r.rec: r.threshold for r in align.thresholds(store, 2.0).collect()}
    assert t[3] == (gone[3].min() + gone[3].max()) / 2
    assert align.thresholds(store, 1e9).where("threshold IS NOT NULL").count() == 0


@pytest.mark.parametrize("rate", [8, 32, 90, 200])
def test_line_share_from_partial_spectra(spark, store, gone, rate, apart):
    """Equal to Welch's method over the whole recording, whether segments are shorter or longer than a block."""
    freqs, band = (rate / 4.0, rate / 8.0), 1.0
    out = qc.line_share(store.blocks, KEY, rate, freqs=freqs, band=band)
    assert exchanged_arrays(out) == []
    got = {r.rec: r.line_fraction for r in out.collect()}
    for r, x in gone.items():
        want = kernels._line_fraction(x, rate, freqs, band)
        assert (got[r] is None) == (want is None) and (want is None or abs(got[r] - want) < 1e-9)


def test_line_share_keeps_small_signals_on_large_offsets(spark):
    x = 1e5 + 1e-3 * np.random.default_rng(2).standard_normal(400)
    b = B.pack(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "rec int, sample_index long, v double"), KEY, 30, 11)
    got = qc.line_share(b, KEY, 64, freqs=(16.0,), band=2.0).first().line_fraction
    assert abs(got - kernels._line_fraction(x - 1e5, 64, (16.0,), 2.0)) < 1e-6


def test_tones(store, gone, apart):
    out = narrowband_rms(store, {"a": 3.0, "b": 7.5}, 100.0)
    assert exchanged_arrays(out) == []
    for r in out.collect():
        x = np.nan_to_num(gone[r.rec])
        n, there = len(x), ~np.isnan(gone[r.rec])
        w = np.where(there, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)), 0)
        for name, f in (("a", 3.0), ("b", 7.5)):
            z = (x * w * np.exp(2j * np.pi * f * np.arange(n) / 100)).sum()
            assert abs(r[name] - np.sqrt(2) * abs(z) / w.sum()) < 1e-9


def test_medians_stay_with_the_blocks(spark, store, gone, apart):
    rows = [(2, 0, 0, 1000), (2, 1, 195, 215), (3, 0, 0, 4 * 48 * 16 + 1), (3, 1, 40, 60), (1, 0, 0, 48), (4, 0, 90, 110), (4, 1, 3, 90)]
    w = spark.createDataFrame(rows, "rec int, k int, start long, end long")
    out = window_medians(store.blocks, w, KEY, ["rec", "k"], "m", SIZE)
    assert exchanged_arrays(out) == []
    got = {(r.rec, r.k): r.m for r in out.collect()}
    for r, k, a, b in rows:
        x = gone[r][a:b]
        want = None if r == 4 and np.isnan(x).any() else np.median(x[~np.isnan(x)])
        assert got[r, k] == want
    smooth = window_medians(store.blocks, w.where("rec = 3"), KEY, ["rec", "k"], "m", SIZE, prepare=lambda b: B.running_median(b, 5, 11))
    assert exchanged_arrays(smooth) == []
    y = B._median_same(gone[3], 5)
    assert {r.k: r.m for r in smooth.collect()} == {0: np.median(y), 1: np.median(y[40:60])}


def test_interval_join_moves_windows_only(spark, store, gone, apart):
    w = spark.createDataFrame([(2, 30, 990), (3, 100, 101)], "rec int, start long, end long")
    out = I.slices(store.blocks, w, KEY, SIZE)
    assert exchanged_arrays(out) == []
    assert sum(len(r.part) for r in out.collect()) == 961
    plain = I.slices(store.blocks.repartition(3), w, KEY, SIZE)
    assert exchanged_arrays(plain) != []     # the same join on blocks that are not stored by key


def test_frames_outside_are_missing(spark, store):
    f = spark.createDataFrame([(0, 0, 2), (0, 1, 400), (3, 0, 100), (9, 0, 5), (2, 0, 998)], "rec int, frame_no long, sample_index long")
    got = {(r.rec, r.frame_no): None if r.part is None else len(r.part) for r in align.frame_windows(store.blocks, f, KEY, 4, SIZE).collect() if r.part is None or r.rec != 3}
    assert got == {(0, 0): 5, (0, 1): None, (9, 0): None, (2, 0): 6}


def test_lag_in_four_steps(spark):
    """Trials longer than a task may hold give the direct sum's lag; the pieces may come from any blocks."""
    g = np.random.default_rng(5)
    rows, want = [], {}
    for r, n in ((0, 20), (1, 33), (2, 700), (3, 5000), (4, 4096)):
        e = np.repeat(g.integers(-3, 4, n // 10 + 1), 10)[:n].astype(float)
        x = np.roll(e, int(g.integers(-9, 10))) * 2 + 0.1 * g.standard_normal(n) + 5
        want[r] = kernels.lag_of(e - e.mean(), x - x.mean())
        at = 0
        while at < n:
            m = min(int(g.integers(1, 60)), 10 - at % 10, n - at)
            rows.append((r, at, x[at:at + m].tolist(), float(e[at]), n, float(x.mean()), float(e.mean())))
            at += m
    p = spark.createDataFrame(rows, "rec int, at long, rec_samples array<double>, level double, n long, mean_r double, mean_e double")
    p = p.withColumnsRenamed({"rec": "trial", "rec_samples": "rec"}).repartition(3)
    for sizes in ({"row": 64, "cells": 256}, {"row": 16, "cells": 1024}, {"row": 256, "cells": 64}, {}):
        assert {r.trial: r.lag for r in correlate.lags(p, ["trial"], **sizes).collect()} == want
