"""Dispatch by mode, failures kept to their recording, stimulus names, verdicts, long trials, logs and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clampspark.operators import catalog, stimulus
from clampspark.operators.decay import decay_fits
from clampspark.operators.isolate import guarded
from clampspark.operators.store import land
from clampspark.plans import qc
from clampspark.session import shared_dir
from clampspark.sources import rawbin

KEY = ["rec"]


@pytest.fixture()
def recordings(spark):
    return spark.createDataFrame([(1, "continuous"), (2, "trial"), (3, "continuous"), (4, "trial")], "rec int, mode string")


def blocks(spark):
    g = np.random.default_rng(1)
    rows = [(r, k, 64 * k, g.standard_normal(64).tolist()) for r in (1, 2, 3) for k in range(3)]
    rows[4] = (2, 1, 64, None)      # a block whose samples were lost
    return spark.createDataFrame(rows, "rec int, block_no long, block_start long, samples array<double>").repartition(2)


def test_a_recording_that_raises_fails_alone(spark, recordings):
    noise = qc.line_noise(blocks(spark), KEY, 32, freqs=(8.0,), band=1.0)
    got = {r.rec: (r.line_fraction is None, r.error) for r in noise.collect()}
    assert got[1] == (False, None) and got[3] == (False, None) and got[2][0] and "Error" in got[2][1]
    out = qc.dispatch([
        qc.Check("S", "noise", lambda: qc.line_noise(blocks(spark), KEY, 32, freqs=(8.0,), band=1.0)),
        qc.Check("S", "plain", lambda: recordings.select("rec", F.lit("pass").alias("status")).where("rec < 4")),
        qc.Check("S", "no plan", lambda: recordings.select("no_such_column")),
        qc.Check("A", "events", lambda: recordings.select("rec", F.lit("warn").alias("status"), F.lit("m").alias("message")), ("continuous",)),
        qc.Check("A", "trials", lambda: recordings.select("rec", F.lit("pass").alias("status")), ("trial",)),
    ], recordings, KEY)
    rows = out.collect()
    got = {(r.rec, r.check_name): r.status for r in rows}
    assert len(rows) == len(got) == 16
    assert got[2, "noise"] == "fail" and got[4, "noise"] == "skip" and got[1, "noise"] != "skip" and got[4, "plain"] == "skip"
    assert {got[r, "no plan"] for r in (1, 2, 3, 4)} == {"fail"} and (1, "trials") not in got and got[2, "trials"] == "pass" and got[3, "events"] == "warn"
    assert all(("not carried out" in r.message) == (r.status == "fail") for r in rows if r.check_name in ("noise", "no plan") and r.rec != 1 and r.rec != 3 or r.check_name == "no plan")
    rep = {r.rec: r for r in qc.report(out, recordings, KEY).collect()}
    assert rep[1].status == "fail" and [s.section for s in rep[2].sections] == ["A", "S"]


def test_guarded_takes_rows_alone_after_an_error():
    import pyarrow as pa

    def step(b):
        x = b.column(1).to_pylist()
        if 3 in x:
            raise ValueError("three")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v * 2 for v in x])], names=["k", "y"])
    b = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([1, 3, 5])], names=["k", "x"])
    out = [r for o in guarded([b, b.slice(0, 1), b.slice(0, 0)], step, ["k"], {"y": pa.int64()}) for r in o.to_pylist()]
    assert sorted(out, key=str) == sorted([{"k": "a", "y": 2, "_error": None}, {"k": "b", "y": None, "_error": "ValueError: three"}, {"k": "c", "y": 10, "_error": None}, {"k": "a", "y": 2, "_error": None}], key=str)


def test_stimulus_names_and_verdicts(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, None), (3, 0, "x")], "rec int, trial_index int, name string")
    d = spark.createDataFrame([(1, "a", 5), (1, "a", 2), (1, "b", 1), (2, "a", 9), (3, "y", 4)], "rec int, name string, stimulus_index int")
    got = {(r.rec, r.trial_index): (r.stimulus_index, r.found) for r in qc.stimulus_by_name(t, d, KEY).collect()}
    assert got == {(1, 0): (5, True), (1, 1): (1, True), (2, 0): (9, True), (2, 1): (None, False), (3, 0): (None, False)}
    e = spark.createDataFrame([(1, 0, "warn", 0.1, 0.0, None), (1, 1, "fail", 0.9, 2.0, None), (2, 0, None, None, None, "ValueError: x")], "rec int, trial_index int, status string, rmse_v double, timing_offset_ms double, error string")
    v = {r.rec: r for r in qc.command_verdict(t, e, KEY).collect()}
    assert (v[1].status, v[1].worst_trial, v[1].n_trials, v[1].n_skipped) == ("fail", 1, 2, 0) and v[2].error == "ValueError: x" and (v[3].status, v[3].n_skipped, v[3].message) == ("pass", 1, "")


def test_trial_blocks_are_ranges_of_bytes(spark, tmp_path):
    x = np.arange(2 * 1050, dtype="<f8").reshape(2, 1050)
    path = str(tmp_path / "t.bin")
    (np.concatenate([np.zeros(7, "<f8"), x.ravel()])).tofile(path)
    idx = spark.createDataFrame([(path, 3, 56, 1050)], "path string, trial_index long, byte_offset long, n_samples long")
    rows = rawbin.scan_trials(idx, 2, 400).collect()
    assert sorted((r.channel_index, r.block_start, len(r.samples)) for r in rows) == [(c, s, n) for c in (0, 1) for s, n in ((0, 400), (400, 400), (800, 250))]
    assert all(r.samples == x[r.channel_index, r.block_start:r.block_start + len(r.samples)].tolist() for r in rows)


def test_decay_fits_of_sweeps_over_blocks(spark, tmp_path):
    """Known decays, noise, and sweeps that cannot be fitted; sweeps lie in blocks of 50 samples."""
    g = np.random.default_rng(2)
    t = np.arange(400)
    sweeps = {i: 3.0 + 90 * np.exp(-t / tau) for i, tau in enumerate((8.0, 40.0, 150.0))}
    sweeps[3] = sweeps[1] + g.standard_normal(400)
    sweeps[4] = np.ones(2)
    sweeps[5] = np.full(120, np.nan)
    sweeps[6] = np.full(90, 4.0)
    rows = [(r, k // 50, k, x[k:k + 50].tolist(), [], []) for r, x in sweeps.items() for k in range(0, len(x), 50)]
    b = spark.createDataFrame(rows, "rec int, block_no long, block_start long, samples array<double>, before array<double>, after array<double>")
    got = {r.rec: r for r in decay_fits(land(b, str(tmp_path / "s"), KEY, 50, buckets=3), 1000.0).collect()}
    for i, tau in enumerate((8.0, 40.0, 150.0)):
        assert got[i].converged and abs(got[i].tau_ms / tau - 1) < 1e-6 and abs(got[i].i_ss - 3) < 1e-5 and got[i].rmse < 1e-4
    assert got[3].converged and 30 < got[3].tau_ms < 50 and got[3].gradient < 1e-8 and 0.8 < got[3].rmse < 1.2
    assert all(not got[i].converged and got[i].tau_ms is None for i in (4, 5, 6))


def test_log_columns_and_rows_in_file_order(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 'say "hi", you', "2", "u"), ("a", None, "n", "1", "v")], "metadata_file string, mine string, notes string, start_time string, expt_id string")
    catalog.write_log(df, str(tmp_path / "log"))
    lines = [line for f in sorted((tmp_path / "log").glob("part*")) for line in f.read_text().splitlines()]
    assert lines[0] == "expt_id,metadata_file,notes,mine,start_time" and [x[:1] for x in lines if not x.startswith("expt_id")] == ["v", "u"]


def test_assembly_defaults(spark):
    r = spark.createDataFrame([(1, True, False, None), (2, False, True, "t"), (3, True, True, "t")], "rec int, has_trials boolean, has_continuous boolean, start_time string")
    ch = spark.createDataFrame([(1, 1, "b", 2.0, "V"), (1, 0, "a", 1.0, "mV")], "rec int, channel_index int, name string, display_scale double, units string")
    t = spark.createDataFrame([(1, None, None, None), (1, 4, 2, "s"), (3, 0, 0, "s")], "rec int, trial_index int, stimulus_index int, stimulus_name string")
    e = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (3, 1)], "rec int, sample_index int")
    out, trials, events = catalog.assemble(r, ch, t, e, spark.createDataFrame([(2,)], "rec int"), KEY)
    got = {x.rec: (x.mode, x.start_time, x.channel_names, x.n_trials, x.n_events, x.has_sidecar) for x in out.collect()}
    assert got == {1: ("trial", "", ["a", "b"], 2, 0, False), 2: ("continuous", "t", [], 0, 2, True), 3: ("continuous", "t", [], 0, 1, False)}
    assert sorted((x.rec, x.trial_index, x.stimulus_index, x.stimulus_name) for x in trials.collect()) == [(1, -1, -1, ""), (1, 4, 2, "s")] and events.count() == 3


def test_residuals_of_planned_events(spark):
    p = spark.createDataFrame([(1, "apply", 10, 0), (1, "apply", 30, 0), (1, "clear", 20, 0)], "rec int, event_type string, offset long, run_start long")
    g = spark.createDataFrame([(1, "apply", 12, 0), (1, "clear", 25, 1)], "rec int, event_type string, sample_index long, event_seq long")
    got = sorted((r.event_type, r.place, r.planned_index, r.residual) for r in stimulus.timing_residuals(p, g, KEY, 4).collect())
    assert got == [("apply", 0, 12, 0), ("apply", 1, 32, None), ("clear", 0, 20, 5)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default if key == "spark.checkpoint.dir" else "/w"

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session()) == "/w/_scratch"
