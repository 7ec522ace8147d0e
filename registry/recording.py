"""Step analysis on two-channel recordings."""

from pyspark.sql import functions as F

from clampspark.operators.quantiles import window_medians
from clampspark.plans import steps
from clampspark.session import materialise
from . import query
from .intervals import APPLY
from .views import BLOCK, HALO, KEY, RATE, blk, channel_store, evt, proto, rec_lengths, sql

SETTINGS = steps.StepSettings(rate=RATE, block=BLOCK, halo=HALO, min_amp=60.0, min_step_ms=2.0, max_gap_ms=5.0, margin_ms=1.0)

STEPS = dict(
    sm="""SELECT recording_id, sample_index, vm, greatest(least(a, cmd), least(greatest(a, cmd), b)) AS cmd FROM (SELECT *,
        coalesce(lag(cmd) OVER w, cmd) AS a, coalesce(lead(cmd) OVER w, cmd) AS b FROM two WINDOW w AS (PARTITION BY recording_id ORDER BY sample_index))""",
    **APPLY,
    isl="""SELECT recording_id, sample_index, cmd, sample_index - row_number() OVER (PARTITION BY recording_id ORDER BY sample_index) AS g FROM sm WHERE abs(cmd) >= 60""",
    ev="""SELECT w.recording_id, w.start AS apply_sample, w.stop AS clear_sample, w.stimulus_name, w.stimulus_index, g, min(sample_index) AS onset, max(sample_index) + 1 AS stop, median(cmd) AS amp
        FROM win w JOIN isl i ON i.recording_id = w.recording_id AND sample_index >= w.start AND sample_index < w.stop GROUP BY ALL HAVING count(*) >= 2""",
    wv="""SELECT recording_id, g, min(sample_index) AS onset, max(sample_index) + 1 AS stop, median(cmd) AS amp FROM isl
        WHERE recording_id NOT IN (SELECT recording_id FROM ev) GROUP BY ALL HAVING count(*) >= 2""",
    wf="SELECT *, CASE WHEN onset - lag(stop) OVER (PARTITION BY recording_id ORDER BY onset) > 5 THEN 1 ELSE 0 END AS fresh FROM wv",
    ws="SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY onset) AS st FROM wf",
    wg="""SELECT recording_id, min(onset) OVER (PARTITION BY recording_id, st) AS apply_sample, max(stop) OVER (PARTITION BY recording_id, st) AS clear_sample,
        'unknown' AS stimulus_name, -1 AS stimulus_index, onset, stop, amp FROM ws""",
    pl="""SELECT *, row_number() OVER (PARTITION BY recording_id, apply_sample ORDER BY onset) AS rn, count(*) OVER (PARTITION BY recording_id, apply_sample) AS n FROM (
        SELECT recording_id, apply_sample, clear_sample, stimulus_name, stimulus_index, onset, stop, amp FROM ev
        UNION ALL SELECT recording_id, apply_sample, clear_sample, stimulus_name, stimulus_index, onset, stop, amp FROM wg)""",
    ld="""SELECT pl.recording_id, pl.apply_sample, pl.onset AS on0, pl.stop AS off0, pl.amp AS a0, n, amp < 0 AND (coalesce(has_pulse, false) OR n > 1) AS lead
        FROM pl ASOF LEFT JOIN proto p ON p.recording_id = pl.recording_id AND pl.apply_sample >= p.start_sample WHERE rn = 1""",
    md="""SELECT ld.*, (SELECT median(vm) FROM two t WHERE t.recording_id = ld.recording_id AND t.sample_index >= ld.apply_sample AND t.sample_index < greatest(ld.apply_sample, ld.on0 - 1)) AS rmp,
        (SELECT median(vm) FROM two t WHERE t.recording_id = ld.recording_id AND t.sample_index >= ld.on0 + (ld.off0 - ld.on0) // 2 AND t.sample_index < ld.off0) AS steady FROM ld""",
    agg="""SELECT recording_id, pl.apply_sample, stimulus_name, md.lead, md.rmp, md.steady, md.a0, md.n - CASE WHEN md.lead THEN 1 ELSE 0 END AS n_steps,
        min(onset) AS on_, max(stop) AS off_, min(amp) AS lo, max(amp) AS hi FROM pl JOIN md USING (recording_id, apply_sample)
        WHERE NOT md.lead OR rn > 1 OR md.n = 1 GROUP BY ALL""",
)

INTRINSICS = sql("two evt len proto", """SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY apply_sample) - 1 AS BIGINT) AS staircase_index, stimulus_name,
    on_ / 1000.0::DOUBLE AS t_start_s, off_ / 1000.0::DOUBLE AS t_end_s, n_steps, round(lo, 6) AS min_amp, round(hi, 6) AS max_amp, round(rmp, 6) AS rmp,
    round(CASE WHEN lead AND abs(a0) >= 1e-9 THEN (steady - rmp) / (a0 / 1000) END, 6) AS resistance FROM agg""", **STEPS)


def run(spark, d):
    cmd, vm = (channel_store(spark, d, c).blocks for c in (2, 0))
    return steps.intrinsics(cmd, vm, evt(spark, d), rec_lengths(spark, d), proto(spark, d), KEY, SETTINGS)


@query("intrinsics", INTRINSICS)
def intrinsics(spark, d):
    """Flagship: resting level and resistance of every staircase in the archive."""
    r = run(spark, d)
    return r.select("recording_id", "staircase_index", "stimulus_name", "t_start_s", "t_end_s", "n_steps",
                    F.round("min_amp_pA", 6).alias("min_amp"), F.round("max_amp_pA", 6).alias("max_amp"),
                    F.round("rmp_mV", 6).alias("rmp"), F.round("input_resistance_MOhm", 6).alias("resistance"))


@query("intrinsics_csv", sql("two evt len proto", """SELECT recording_id, count(*) AS n_rows, CAST(sum(n_steps) AS BIGINT) AS n_steps,
    round(sum(round_even(on_ / 1000.0::DOUBLE, 2)), 4) AS t_total FROM agg GROUP BY 1""", **STEPS))
def intrinsics_csv(spark, d):
    from clampspark.session import scratch_path
    path = scratch_path(spark, "intrinsics-csv")
    steps.write_csv(run(spark, d), KEY, path)
    return steps.read_csv(spark, path, KEY).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_steps").alias("n_steps"), F.round(F.sum("t_start_s"), 4).alias("t_total"))


@query("rmp", sql("sig evt len", """SELECT w.recording_id, w.event_seq, round(median(s.v), 6) AS rmp FROM win w JOIN sig s
    ON s.recording_id = w.recording_id AND s.sample_index >= w.start AND s.sample_index < w.stop GROUP BY 1, 2""", **APPLY))
def rmp(spark, d):
    from clampspark.operators.stimulus import apply_windows
    from .views import sig_blocks
    w = apply_windows(evt(spark, d), rec_lengths(spark, d), KEY).select("recording_id", "event_seq", "start", "end")
    m = window_medians(sig_blocks(spark, d), materialise(w, "windows"), KEY, ["recording_id", "event_seq"], "rmp", BLOCK)
    return m.withColumn("rmp", F.round("rmp", 6))


RI = dict(
    **APPLY,
    h="SELECT w.*, n_samples, start + (stop - start) // 2 AS mid FROM win w JOIN len USING (recording_id)",
    r="""SELECT h.recording_id, h.event_seq, h.stimulus_index * 50 - 50 AS amp,
        (SELECT median(v) FROM sig s WHERE s.recording_id = h.recording_id AND s.sample_index >= h.mid AND s.sample_index < h.stop) AS steady,
        (SELECT median(v) FROM sig s WHERE s.recording_id = h.recording_id AND s.sample_index < 10) AS base FROM h""",
)


@query("input_resistance", sql("sig evt len", """SELECT recording_id, event_seq, round(CASE WHEN abs(amp) >= 1e-9 THEN (steady - base) / (amp / 1000.0::DOUBLE) END, 6) AS resistance FROM r""", **RI))
def input_resistance(spark, d):
    return resistance(spark, d).select("recording_id", "event_seq", F.round("resistance", 6).alias("resistance"))


def resistance(spark, d):
    from clampspark.operators.calibration import input_resistance as ri
    from clampspark.operators.stimulus import apply_windows
    from .views import sig_blocks
    w = apply_windows(evt(spark, d), rec_lengths(spark, d), KEY)
    p = w.select("recording_id", "event_seq", F.col("start").alias("onset"), F.col("end").alias("offset"),
                 (F.col("stimulus_index") * 50.0 - 50).alias("amplitude"), F.lit(0).alias("base_start"), F.lit(10).alias("base_end"))
    return ri(sig_blocks(spark, d), p, KEY, ["event_seq"], BLOCK)


@query("ri_reference_check", sql("sig evt len", """SELECT recording_id, event_seq, CASE WHEN abs(ri - 500) / 500 > 0.05 THEN 'warn' ELSE 'pass' END AS status FROM (
    SELECT recording_id, event_seq, (steady - base) / (amp / 1000.0::DOUBLE) AS ri FROM r WHERE abs(amp) >= 1e-9)""", **RI))
def ri_reference_check(spark, d):
    from clampspark.operators.calibration import reference_check
    return reference_check(resistance(spark, d).where("resistance IS NOT NULL"), 500.0).select("recording_id", "event_seq", "status")


@query("median_of_medians", sql("bs", """SELECT recording_id, round(median(m), 9) AS rmp FROM (SELECT recording_id, trial_index, median(v) AS m FROM bs WHERE sample_index - 20 < 0 GROUP BY 1, 2) GROUP BY 1"""))
def median_of_medians(spark, d):
    from clampspark.operators.calibration import overlay_baseline
    b = blk(spark, d).select("recording_id", "trial_index", "samples", F.lit(20).alias("onset_in_segment"))
    return overlay_baseline(b, KEY, "trial_index").withColumn("rmp", F.round("rmp", 9))


@query("time_range_slice", sql("sig", """SELECT recording_id, sample_index, sample_index / 1000.0::DOUBLE AS t_s, round(v * 10.0, 6) AS v_display FROM sig
    WHERE sample_index >= 7 AND sample_index < 33"""))
def time_range_slice(spark, d):
    from clampspark.sources.tables import read_range
    from .views import BLOCK, sig_blocks
    r = read_range(sig_blocks(spark, d), KEY, 0.007, 0.0335, RATE, scale=10.0, block=BLOCK)
    return r.select("recording_id", "sample_index", "t_s", F.round("v_display", 6).alias("v_display"))


@query("concat_trials", sql("bs", """SELECT recording_id, trial_index, o + sample_index AS concat_index, v FROM bs JOIN
    (SELECT recording_id, trial_index, CAST(coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY trial_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
     FROM (SELECT recording_id, trial_index, count(*) AS n FROM bs GROUP BY 1, 2)) USING (recording_id, trial_index)"""))
def concat_trials(spark, d):
    from clampspark.sources.tables import concat_offsets
    t = concat_offsets(blk(spark, d), KEY)
    return t.select("recording_id", "trial_index", "concat_start", F.posexplode("samples").alias("p", "v")).select(
        "recording_id", "trial_index", (F.col("concat_start") + F.col("p")).alias("concat_index"), "v")


@query("baseline_window", sql("evt len", """SELECT l.recording_id, CAST(CASE WHEN a IS NULL THEN n_samples ELSE greatest(0, a - 1) END AS BIGINT) AS stop
    FROM len l LEFT JOIN (SELECT recording_id, min(sample_index) AS a FROM evt WHERE event_type = 'apply' AND stimulus_index = 2 GROUP BY 1) USING (recording_id)"""))
def baseline_window(spark, d):
    from clampspark.plans.qc import baseline_windows
    e = evt(spark, d).where("stimulus_index = 2")
    return baseline_windows(rec_lengths(spark, d), e, KEY).select("recording_id", F.col("end").alias("stop"))
