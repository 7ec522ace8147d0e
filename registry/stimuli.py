"""Planned stimuli: expected segments, timelines, trial segmentation."""

from pyspark.sql import functions as F

from clampspark.operators import stimulus as S
from . import query
from .views import KEY, RATE, sql, stim, stored, table

PIECES = {
    # One row per piece of the plan; ord sorts pieces within a trial.
    "b": """SELECT *, CAST(floor(pre_ms) AS BIGINT) AS pre, CAST(floor(post_ms) AS BIGINT) AS post, CAST(floor(gap_ms) AS BIGINT) AS gap,
        CAST(floor(CASE WHEN step_width_ms = 0 THEN 500 ELSE step_width_ms END) AS BIGINT) AS width,
        CASE WHEN staircase_repeats = 0 THEN 1 ELSE staircase_repeats END AS reps FROM stim""",
    "amp": """SELECT stimulus_index, unnest(range(0, CAST(floor((max_pa - min_pa + 1e-9) / step_pa) AS BIGINT) + 1)) AS i FROM stim""",
    "rep": "SELECT stimulus_index, unnest(range(0, reps)) AS r FROM b",
    "pieces": """SELECT stimulus_index, 0 AS ord, pre AS len, 0.0::DOUBLE AS volts FROM b
        UNION ALL SELECT stimulus_index, 1, 40, pulse_pa / 400 FROM b WHERE pulse_ms IS NOT NULL AND type <> 'baseline' AND clamp_mode = 'current_clamp'
        UNION ALL SELECT stimulus_index, 2, gap, 0.0 FROM b WHERE pulse_ms IS NOT NULL AND type <> 'baseline' AND clamp_mode = 'current_clamp'
        UNION ALL SELECT b.stimulus_index, 10 + (r * 1000 + i) * 2, width, (min_pa + i * step_pa) / 400 FROM b JOIN amp USING (stimulus_index) JOIN rep USING (stimulus_index)
            WHERE type <> 'baseline' AND clamp_mode = 'current_clamp'
        UNION ALL SELECT b.stimulus_index, 11 + (r * 1000 + i) * 2, gap, 0.0 FROM b JOIN amp USING (stimulus_index) JOIN rep USING (stimulus_index)
            WHERE type <> 'baseline' AND clamp_mode = 'current_clamp'
        UNION ALL SELECT stimulus_index, 10, CAST(CASE WHEN duration_ms = 0 THEN 500 ELSE duration_ms END AS BIGINT), step_mv / mv_per_volt FROM b WHERE type <> 'baseline' AND clamp_mode = 'voltage_clamp'
        UNION ALL SELECT stimulus_index, 1000000000, post, 0.0 FROM b""",
    "seg": """SELECT stimulus_index, CAST(sum(len) OVER w AS BIGINT) - len AS seg_start, CAST(sum(len) OVER w AS BIGINT) AS seg_end, volts FROM pieces
        WINDOW w AS (PARTITION BY stimulus_index ORDER BY ord)""",
}


def segments(spark, d, used=None):
    """Expected segments of all stimuli, or of those in ``used(stimulus_index)``: one that no trial has is not laid out."""
    s = stim(spark, d)
    return S.expected_segments(s if used is None else s.join(used, "stimulus_index", "left_semi"), ["stimulus_index"], RATE)


@query("expected_segments", sql("stim", "SELECT stimulus_index, seg_start, seg_end, round(volts, 9) AS volts FROM seg WHERE seg_end > seg_start", **PIECES))
def expected_segments(spark, d):
    return segments(spark, d).select("stimulus_index", "seg_start", "seg_end", F.round("volts", 9).alias("volts"))


TRIAL = {
    **PIECES,
    "wl": "SELECT stimulus_index, max(seg_end) AS n FROM seg GROUP BY 1",
    "tr": """SELECT o_orderkey AS recording_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey, l_extendedprice, l_linenumber, l_suppkey, l_quantity) - 1 AS BIGINT) AS trial_pos,
        l_partkey AS stimulus_index FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "tl": """SELECT recording_id, trial_pos, tr.stimulus_index, s.name, s.type, wl.n, CASE WHEN s.type = 'baseline' THEN 0 ELSE wl.n END AS w FROM tr
        JOIN stim s USING (stimulus_index) JOIN wl USING (stimulus_index)""",
    "plan": """SELECT *, 100 + 20 + CAST(coalesce(sum(100 + 20 + 30 + w) OVER (PARTITION BY recording_id ORDER BY trial_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS apply_offset FROM tl""",
}


def trials(spark, d):
    return stored(spark, d, "trials", lambda: _trials(spark, d))


def _trials(spark, d):
    """Trial order of a run: the order's items; every trial carries its planned waveform length."""
    from clampspark.operators.ordered import running_by_size
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("recording_id"), F.col("l_partkey").alias("stimulus_index"),
        "l_extendedprice", "l_linenumber", "l_suppkey", "l_quantity")
    t = running_by_size(li, KEY, ["stimulus_index", "l_extendedprice", "l_linenumber", "l_suppkey", "l_quantity"], F.floor(F.col("stimulus_index") / 1024),
                        {"trial_pos": ("sum", F.lit(1).cast("bigint"))}, inclusive=False).select("recording_id", "trial_pos", "stimulus_index")
    s = stim(spark, d).select("stimulus_index", "name", "type", "pre_ms", "post_ms", "iti_ms", S.planned_samples(RATE).alias("n_samples"))
    return t.join(s, "stimulus_index").withColumn(
        "waveform_samples", F.when(F.col("type") == "baseline", 0).otherwise(F.col("n_samples")).cast("bigint"))


@query("trial_stimuli", sql("stim", "SELECT recording_id, trial_pos, stimulus_index, name, type FROM tl", **TRIAL))
def trial_stimuli(spark, d):
    return trials(spark, d).select("recording_id", "trial_pos", "stimulus_index", "name", "type")


@query("planned_timeline", sql("stim", "SELECT recording_id, trial_pos, apply_offset, CAST(apply_offset + w + 30 AS BIGINT) AS clear_offset FROM plan", **TRIAL))
def planned_timeline(spark, d):
    return S.planned_timeline(trials(spark, d), KEY, RATE).select("recording_id", "trial_pos", "apply_offset", "clear_offset")


@query("event_quantise", sql("stim", """SELECT recording_id, trial_pos, CAST(1000 + greatest(200, ((apply_offset + 199) // 200) * 200) AS BIGINT) AS logged,
    CAST(greatest(200, ((apply_offset + 199) // 200) * 200) - apply_offset AS BIGINT) AS residual FROM plan""", **TRIAL))
def event_quantise(spark, d):
    t = S.planned_timeline(trials(spark, d), KEY, RATE)
    at = S.logged_index(F.col("apply_offset"), F.lit(1000).cast("bigint"))
    return t.select("recording_id", "trial_pos", at.alias("logged"), (at - 1000 - F.col("apply_offset")).alias("residual"))


def _up(x: str, c: int = 50) -> str:
    return f"greatest({c}, (({x} + {c - 1}) // {c}) * {c})"


@query("trial_segment", sql("stim", f"""SELECT recording_id, trial_pos, CAST({_up('100')} + coalesce(sum(span) OVER (PARTITION BY recording_id ORDER BY trial_pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_start, n AS n_saved FROM (
    SELECT *, {_up('100')} + {_up('20')} + {_up('(n - 20)')} AS span FROM tl)""", **TRIAL))
def trial_segment(spark, d):
    t = trials(spark, d)
    return S.trial_bounds(t, KEY, RATE, chunk=50).select("recording_id", "trial_pos", "data_start", "n_saved")


@query("sweeps_by_stimulus", sql("stim", "SELECT name, count(*) AS n_sweeps, count(DISTINCT recording_id) AS n_recordings FROM tl GROUP BY 1", **TRIAL))
def sweeps_by_stimulus(spark, d):
    return S.sweeps_by_stimulus(trials(spark, d))


@query("first_per_stimulus", sql("stim", "SELECT recording_id, name, min(trial_pos) AS trial_pos FROM tl GROUP BY 1, 2", **TRIAL))
def first_per_stimulus(spark, d):
    return trials(spark, d).groupBy("recording_id", "name").agg(F.min("trial_pos").alias("trial_pos"))


@query("distinct_amplitudes", sql("pulse", "SELECT DISTINCT amplitude FROM pulse"))
def distinct_amplitudes(spark, d):
    from .views import pulse
    return pulse(spark, d).select("amplitude").distinct()


@query("step_count_consistency", sql("pulse", """SELECT grp, count(*) AS n_repeats, min(n) AS min_steps, max(n) AS max_steps, count(DISTINCT n) > 1 AS varies,
    count(*) FILTER (WHERE n <> 4) AS n_off FROM (SELECT recording_id, recording_id % 100 AS grp, count(*) AS n FROM pulse GROUP BY 1) GROUP BY 1"""))
def step_count_consistency(spark, d):
    from .views import pulse
    found = pulse(spark, d).groupBy("recording_id").agg(F.count(F.lit(1)).alias("found_steps"))
    s = found.select((F.col("recording_id") % 100).alias("grp"), "found_steps", F.lit(4).alias("expected_steps"))
    return S.step_count_consistency(s, ["grp"])
