"""Ordered, block, interval and quantile operators against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clampspark.operators.store import land
from clampspark.operators import align, blocks as B, intervals as I, ordered as O, pulses as P
from clampspark.operators.quantiles import exact_quantiles

KEY = ["recording_id"]


def long_table(spark, traces):
    rows = [(r, i, float(x)) for r, v in traces.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "recording_id bigint, sample_index bigint, v double")


def steps(seed, n=400):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        out += [float(rng.choice([0, 0, 50, -80, 12, 9]))] * int(rng.integers(1, 25))
    return np.array(out[:n])


@pytest.mark.parametrize("segment", [1, 7, 1000])
def test_running_matches_one_window(spark, segment):
    rng = np.random.default_rng(segment)
    # Key 0 holds most rows; positions have gaps, so some segments are empty.
    rows = []
    for k, n in ((0, 200), (1, 3), (2, 30)):
        pos = np.sort(rng.choice(n * 3, n, replace=False))
        rows += [(k, int(p), float(rng.integers(0, 100)), int(p) if rng.random() < 0.3 else None) for p in pos]
    df = spark.createDataFrame(rows, "k int, i bigint, x double, m bigint")
    got = O.running(df, ["k"], ["i"], O.segment_of("i", segment), {
        "s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "last": ("last", F.col("m"))}).toPandas().sort_values(["k", "i"])
    p = pd.DataFrame(rows, columns=["k", "i", "x", "m"]).sort_values(["k", "i"])
    g = p.groupby("k")
    assert np.allclose(got["s"], g["x"].cumsum())
    assert np.allclose(got["hi"], g["x"].cummax())
    assert got["last"].fillna(-1).tolist() == g["m"].ffill().fillna(-1).tolist()
    nxt = O.neighbour(df, ["k"], ["i"], O.segment_of("i", segment), {"i": "next_i"}, ahead=True).toPandas().sort_values(["k", "i"])
    assert nxt["next_i"].fillna(-1).tolist() == g["i"].shift(-1).fillna(-1).tolist()
    num = O.ordinal(df, ["k"], ["i"], O.segment_of("i", segment), "n").toPandas().sort_values(["k", "i"])
    assert num["n"].tolist() == g.cumcount().tolist()


def plain_runs(x, min_amp):
    hi = np.concatenate([[0], (np.abs(x) >= min_amp).astype(int), [0]])
    d = np.diff(hi)
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pulses_do_not_depend_on_blocks(spark, size):
    first = steps(1)
    first[:5] = 50.0            # starts high
    first[-9:] = -80.0          # run to the last sample, sign change before it
    first[100:300] = 50.0       # spans several blocks
    traces = {1: first, 2: steps(2, 130), 3: np.zeros(20), 4: np.full(33, 77.0)}
    b = B.pack(long_table(spark, traces), KEY, size, 11)
    got = P.find_pulses(b, KEY, 4, 10.0, size).collect()
    want = {(r, a, z): np.median(x[a:z]) for r, x in traces.items() for a, z in plain_runs(x, 10) if z - a >= 4}
    assert {(g.recording_id, g.onset, g.offset): g.amplitude for g in got} == want


@pytest.mark.parametrize("size", [1, 7, 64])
def test_running_median_reflects_at_ends(spark, size):
    rng = np.random.default_rng(size)
    traces = {1: rng.normal(size=150), 2: rng.normal(size=9), 3: rng.normal(size=1)}
    s = B.running_median(B.pack(long_table(spark, traces), KEY, size, 11), 21, 11)
    got = B.unpack(s, KEY).toPandas()
    for r, x in traces.items():
        # The reflected sequence has period 2 n: d c b a | a b c d | d c b a.
        n = len(x)
        at = np.arange(-10, n + 10) % (2 * n)
        ext = x[np.where(at < n, at, 2 * n - 1 - at)]
        want = [np.median(ext[i:i + 21]) for i in range(n)]
        assert np.allclose(got[got.recording_id == r].sort_values("sample_index")["v"], want)
    e = B.edges(s, KEY, lambda v: v > 0)
    y = got[got.recording_id == 1].sort_values("sample_index")["v"].to_numpy()
    up = np.flatnonzero(np.diff(np.concatenate([[0], (y > 0).astype(int)])) == 1)
    assert sorted(r.sample_index for r in e.where("recording_id = 1 AND direction = 1").collect()) == up.tolist()


@pytest.mark.parametrize("size", [3, 50])
def test_edge_rules(spark, size, tmp_path):
    ttl = np.tile([5.0] * 2 + [0.0] * 8, 12)          # starts high
    flat, small = np.full(40, 1.0), np.tile([0.0, 0.4], 20)
    b = B.pack(long_table(spark, {1: ttl, 2: flat, 3: small}), KEY, size, 11)
    fixed = align.frame_samples(b, KEY, 2.5).where("recording_id = 1").orderBy("frame_no").collect()
    assert [r.sample_index for r in fixed] == list(range(0, 120, 10))
    n = {r.recording_id: (r.n_edges, r.threshold) for r in align.adaptive_edge_counts(land(b, str(tmp_path / "store"), KEY, size)).collect()}
    assert n == {1: (11, 2.5), 2: (0, None), 3: (0, None)}


def test_slices_and_masks(spark):
    x = np.arange(100.0)
    b = B.pack(long_table(spark, {1: x, 2: x[:30]}), KEY, 16, 2)
    win = [(1, 0, 5), (1, 3, 40), (1, 40, 41), (1, 90, 200), (2, 28, 60), (2, 7, 7)]
    w = spark.createDataFrame(win, "recording_id bigint, start bigint, end bigint")
    got = I.samples_in(b, w, KEY, 16).groupBy("recording_id", "start").agg(F.sum("v").alias("s")).collect()
    want = {(r, a): x[a:min(z, 100 if r == 1 else 30)].sum() for r, a, z in win if z > a}
    assert {(g.recording_id, g.start): g.s for g in got} == want
    m = sorted(tuple(r) for r in I.merge_overlaps(w, KEY).collect())
    # Touching windows merge as well; the covered samples are the same.
    assert m == [(1, 0, 41), (1, 90, 200), (2, 28, 60)]


def test_asof_with_ties(spark):
    marks = [(1, 5, 0, "a"), (1, 5, 1, "b"), (1, 9, 2, "c"), (2, 4, 0, "z")]
    points = [(1, 4), (1, 5), (1, 8), (1, 50), (2, 3), (2, 4), (1, 5)]
    m = spark.createDataFrame(marks, "recording_id bigint, s bigint, seq bigint, name string")
    p = spark.createDataFrame(points, "recording_id bigint, at bigint")
    back = I.latest_before(p, m, KEY, "at", "s", F.col("seq"), ["name"]).collect()
    assert sorted((r.recording_id, r.at, r.name or "") for r in back) == [
        (1, 4, ""), (1, 5, "a"), (1, 5, "a"), (1, 8, "a"), (1, 50, "c"), (2, 3, ""), (2, 4, "z")]
    fwd = I.first_at_or_after(p, m.where("seq <> 1"), KEY, "at", "s", ["name"], F.floor(F.col("_at") / 3)).collect()
    assert sorted((r.recording_id, r.at, r.name or "") for r in fwd) == [
        (1, 4, "a"), (1, 5, "a"), (1, 5, "a"), (1, 8, "c"), (1, 50, ""), (2, 3, "z"), (2, 4, "z")]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {
        1: rng.normal(-65, 0.01, 501), 2: rng.integers(-3, 3, 400).astype(float), 3: np.array([4.0]),
        4: np.array([1.0, np.nan, 3.0]), 5: np.concatenate([np.zeros(300), rng.lognormal(0, 9, 100), -rng.lognormal(0, 9, 101)]),
        6: np.full(10, np.nan), 7: np.array([-np.inf, 1.0, np.inf]),
    }
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k int, v double")
    probs = {"p01": 0.01, "mid": 0.5, "p99": 0.99}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for k in (1, 2, 3, 5):
        for n, q in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(groups[k], q), rel=1e-12, abs=1e-12)
    assert got[4].mid is None and 6 not in got and got[7].mid == 1.0
    skip = {r.k: r.mid for r in exact_quantiles(df, ["k"], "v", {"mid": 0.5}, skip_nan=True).collect()}
    assert skip[4] == 2.0


def test_quantiles_keep_null_keys(spark):
    df = spark.createDataFrame([(k, float(x)) for k in (None, 1) for x in range(9)], "k int, v double")
    assert {(r.k, r.mid, r.n) for r in exact_quantiles(df, ["k"], "v", {"mid": 0.5}).collect()} == {(None, 4.0, 9), (1, 4.0, 9)}


def test_pack_keeps_places_across_gaps(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(40) if i not in (3, 4, 15, 16) and not 24 <= i < 32], "recording_id bigint, sample_index bigint, v double")
    b = B.pack(df, KEY, 8, 2)
    got = {r.sample_index: r.v for r in B.unpack(b, KEY).collect()}
    assert {i: v for i, v in got.items() if v is not None} == {r.sample_index: r.v for r in df.collect()}
    assert all(got[i] is None for i in (3, 4, 15, 16)) and 24 not in got
    by = {r.block_no: r for r in b.collect()}
    assert by[1].before == [6.0, 7.0] and by[0].after == [8.0, 9.0] and by[2].before == [14.0, None] and by[4].before == []
    # High from 0 on with a hole: one edge at the start, none where samples come back after a missing block.
    e = B.edges(b, KEY, lambda x: x >= 0).where("sample_index >= 32").collect()
    assert e == []


def test_pack_refuses_an_index_given_twice(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 1, 3.0), (1, 3, 4.0)], "recording_id bigint, sample_index bigint, v double")
    with pytest.raises(Exception, match="given twice"):
        B.pack(df, KEY, 8, 2).collect()


def test_interval_join_has_no_nested_loop(spark):
    b = B.pack(long_table(spark, {1: np.arange(50.0)}), KEY, 16, 2)
    w = spark.createDataFrame([(1, 3, 9)], "recording_id bigint, start bigint, end bigint")
    plan = I.samples_in(b, w, KEY, 16)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_window_medians_of_long_and_short_windows(spark):
    from clampspark.operators.quantiles import window_medians
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    b = B.pack(long_table(spark, {1: x}), KEY, 32, 2)
    win = [(1, 0, 300), (1, 5, 6), (1, 30, 70), (1, 250, 900)]
    w = spark.createDataFrame(win, "recording_id bigint, start bigint, end bigint")
    want = {(a, z): np.median(x[a:z]) for _, a, z in win}
    got = window_medians(b, w, KEY, ["start", "end"], "m", 32).collect()
    assert {(r.start, r.end): r.m for r in got} == pytest.approx(want)


def test_running_keeps_null_keys_and_segments(spark):
    rows = [(None, i) for i in range(6)] + [(1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "recording_id bigint, sample_index bigint")
    got = O.ordinal(df, ["recording_id"], ["sample_index"], O.segment_of("sample_index", 2), "n").collect()
    assert all(r.n == r.sample_index for r in got) and len(got) == len(rows)


def test_read_range_prunes_on_both_sides(spark, tmp_path):
    from clampspark.sources.tables import read_range
    b = spark.createDataFrame([(1, k, [float(k)] * 4) for k in range(0, 40, 4)], "recording_id bigint, block_start bigint, samples array<double>")
    b.write.parquet(str(tmp_path / "b"))
    q = read_range(spark.read.parquet(str(tmp_path / "b")), ["recording_id"], 9, 14, 1, block=4)
    assert sorted(r.sample_index for r in q.collect()) == [9, 10, 11, 12, 13]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(block_start,5)" in plan and "LessThan(block_start,14)" in plan


def test_drift_of_short_recordings_is_null(spark):
    from clampspark.plans import qc
    df = spark.createDataFrame([(1, i, 2.0 * i) for i in range(20)] + [(2, 0, 1.0)], "recording_id bigint, sample_index bigint, v double")
    got = {r.recording_id: r for r in qc.drift(df, ["recording_id"], 10).collect()}
    assert abs(got[1].slope_v_per_s - 20.0) < 1e-9 and got[2].slope_v_per_s is None
