"""Interval, as-of and positional joins."""

from pyspark.sql import functions as F

from clampspark.operators import align, intervals as I, pulses as P, stimulus as S
from . import query
from .views import BLOCK, KEY, RATE, evt, proto, rec_lengths, sig_blocks, sql, stored

APPLY = dict(
    nx="SELECT *, lead(sample_index) OVER (PARTITION BY recording_id ORDER BY event_seq) AS nxt FROM evt",
    win="""SELECT recording_id, event_seq, stimulus_name, stimulus_index, sample_index AS start, coalesce(nxt, n_samples) AS stop
        FROM nx JOIN len USING (recording_id) WHERE event_type = 'apply' AND coalesce(nxt, n_samples) > sample_index""",
)
PAIRED = dict(
    px="""SELECT *, lead(sample_index) OVER w AS nxt, lead(event_type) OVER w AS nxt_type FROM evt
        WINDOW w AS (PARTITION BY recording_id, stimulus_index ORDER BY event_seq)""",
    pw="""SELECT recording_id, stimulus_index, sample_index AS start, coalesce(nxt, n_samples) AS stop, nxt IS NULL AS is_open
        FROM px JOIN len USING (recording_id) WHERE event_type = 'apply' AND (nxt_type = 'clear' OR nxt_type IS NULL) AND coalesce(nxt, n_samples) > sample_index""",
)
FRAMES = dict(
    ed="SELECT recording_id, sample_index, v, lag(v >= 60, 1, false) OVER (PARTITION BY recording_id ORDER BY sample_index) AS prev FROM sig",
    fr="""SELECT recording_id, sample_index, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY sample_index) - 1 AS BIGINT) AS frame_no
        FROM ed WHERE v >= 60 AND NOT prev""",
)


def frames(spark, d):
    return stored(spark, d, "frames", lambda: align.frame_samples(sig_blocks(spark, d), KEY, 60.0))


@query("apply_windows", sql("evt len", "SELECT recording_id, stimulus_name, stimulus_index, start, stop FROM win", **APPLY))
def apply_windows(spark, d):
    w = S.apply_windows(evt(spark, d), rec_lengths(spark, d), KEY)
    return w.select("recording_id", "stimulus_name", "stimulus_index", "start", F.col("end").alias("stop"))


@query("paired_windows", sql("evt len", "SELECT * FROM pw", **PAIRED))
def paired_windows(spark, d):
    w = S.paired_windows(evt(spark, d), rec_lengths(spark, d), KEY)
    return w.select("recording_id", "stimulus_index", "start", F.col("end").alias("stop"), F.col("open").alias("is_open"))


AMPS = "len(list_filter(range(0, CAST(floor((10.0 + k + 10.0 + k % 50 + 1e-9) / {s}) AS BIGINT) + 1), lambda x: abs(-10.0 - k % 50 + x * {s}) >= 10))"


@query("asof_protocol", sql("evt proto", f"""SELECT e.recording_id, e.sample_index, e.stimulus_index, CAST(p.start_sample AS DOUBLE) AS start_sample, CAST(p.has_pulse AS DOUBLE) AS has_pulse,
    CAST(CASE WHEN p.k IS NULL THEN NULL WHEN e.stimulus_index = 0 THEN {AMPS.format(s='5.0')} WHEN e.stimulus_index = 1 THEN {AMPS.format(s='10.0')} END
      * CASE WHEN p.k % 3 = 0 THEN 1 ELSE p.k % 3 END AS DOUBLE) AS expected_steps
    FROM evt e ASOF LEFT JOIN proto p ON e.recording_id = p.recording_id AND e.sample_index >= p.start_sample WHERE e.event_type = 'apply'"""))
def asof_protocol(spark, d):
    from clampspark.functions.scalar import expected_pulses
    a = evt(spark, d).where("event_type = 'apply'")
    j = S.with_protocol(a, proto(spark, d), KEY, "sample_index", ["start_sample", "has_pulse", "stimuli"])
    s = F.get("stimuli", F.col("stimulus_index"))
    steps = expected_pulses(s["type"], s["min_pA"], s["max_pA"], s["step_pA"], s["staircase_repeats"])
    return j.select("recording_id", "sample_index", "stimulus_index", F.col("start_sample").cast("double"), F.col("has_pulse").cast("double"),
                    steps.cast("double").alias("expected_steps"))


@query("interval_mask", sql("sig evt len", """SELECT s.recording_id, count(*) AS n_active, round(sum(s.v), 4) AS total FROM sig s
    WHERE EXISTS (SELECT 1 FROM pw WHERE pw.recording_id = s.recording_id AND s.sample_index >= pw.start AND s.sample_index < pw.stop) GROUP BY 1""", **PAIRED))
def interval_mask(spark, d):
    w = S.paired_windows(evt(spark, d), rec_lengths(spark, d), KEY)
    m = I.merge_overlaps(w, KEY)
    s = I.slices(sig_blocks(spark, d), m, KEY, BLOCK)
    total = F.aggregate("part", F.lit(0.0), lambda a, x: a + x)
    return s.groupBy("recording_id").agg(F.sum(F.size("part")).cast("bigint").alias("n_active"), F.round(F.sum(total), 4).alias("total"))


@query("step_segments", sql("sig len", """SELECT p.recording_id, p.onset, s.sample_index - p.onset AS rel, round((s.sample_index - p.onset) / 1000.0 * 1000.0, 6) AS time_ms, s.v
    FROM p JOIN sig s ON s.recording_id = p.recording_id AND s.sample_index >= p.onset - 3 AND s.sample_index < p.stop + 3""",
    isl="SELECT recording_id, sample_index, sample_index - row_number() OVER (PARTITION BY recording_id ORDER BY sample_index) AS g FROM sig WHERE abs(v) >= 60",
    p="SELECT recording_id, min(sample_index) AS onset, max(sample_index) + 1 AS stop FROM isl GROUP BY recording_id, g HAVING count(*) >= 2"))
def step_segments(spark, d):
    b = sig_blocks(spark, d)
    p = P.command_runs(b, KEY, 60.0).where(F.col("offset") - F.col("onset") >= 2)
    w = p.select("recording_id", "onset", F.greatest(F.col("onset") - 3, F.lit(0)).alias("start"), (F.col("offset") + 3).alias("end"))
    s = I.samples_in(b, w, KEY, BLOCK)
    rel = F.col("sample_index") - F.col("onset")
    return s.select("recording_id", "onset", rel.alias("rel"), F.round(rel / RATE * 1000.0, 6).alias("time_ms"), "v")


@query("frame_align", sql("sig", """SELECT f.recording_id, f.frame_no, f.sample_index, c.ts_ms FROM fr f JOIN c USING (recording_id, frame_no)""", **FRAMES,
    c="""SELECT user_id AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_no,
        CAST(epoch_us(ts) AS BIGINT) AS ts_ms FROM events WHERE event_type = 'click'"""))
def frame_align(spark, d):
    from clampspark.operators.ordered import ordinal
    from .views import table
    e = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("recording_id"), "ts", "event_id")
    video = ordinal(e, KEY, ["ts", "event_id"], F.date_trunc("minute", "ts"), "frame_no")
    video = video.select("recording_id", "frame_no", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return align.pair_frames(frames(spark, d), video, KEY).select("recording_id", "frame_no", "sample_index", "ts_ms")


@query("nearest_frame", sql("sig evt", """SELECT e.recording_id, e.sample_index, coalesce(f.frame_no, l.last_frame) AS frame_no FROM evt e
    JOIN (SELECT recording_id, max(frame_no) AS last_frame FROM fr GROUP BY 1) l ON l.recording_id = e.recording_id
    ASOF LEFT JOIN fr f ON f.recording_id = e.recording_id AND f.sample_index >= e.sample_index""", **FRAMES))
def nearest_frame(spark, d):
    p = evt(spark, d).select("recording_id", F.col("sample_index").alias("click"))
    n = align.nearest_frame(p, frames(spark, d), KEY, "click")
    return n.select("recording_id", F.col("click").alias("sample_index"), "frame_no")


@query("region_to_frames", sql("sig evt len", """SELECT recording_id, event_seq, s AS start_frame, greatest(s + 1, least(e, n)) AS end_frame FROM (
    SELECT recording_id, event_seq, greatest(0, least(s0, n - 1)) AS s, e0 AS e, n FROM q)""", **APPLY, **FRAMES,
    q="""SELECT w.recording_id, w.event_seq, (SELECT count(*) FROM fr f WHERE f.recording_id = w.recording_id AND f.sample_index < w.start) AS s0,
        (SELECT count(*) FROM fr f WHERE f.recording_id = w.recording_id AND f.sample_index < w.stop) AS e0, n
        FROM win w JOIN (SELECT recording_id, count(*) AS n FROM fr GROUP BY 1) USING (recording_id)"""))
def region_to_frames(spark, d):
    w = S.apply_windows(evt(spark, d), rec_lengths(spark, d), KEY)
    r = w.select("recording_id", "event_seq", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"))
    return align.regions_to_frames(r, frames(spark, d), KEY, "event_seq")


@query("frame_window", sql("sig", """SELECT f.recording_id, f.frame_no, count(s.v) AS n, min(s.v) AS lo, max(s.v) AS hi FROM fr f LEFT JOIN sig s
    ON s.recording_id = f.recording_id AND s.sample_index >= f.sample_index - 5 AND s.sample_index < f.sample_index + 5 GROUP BY 1, 2""", **FRAMES))
def frame_window(spark, d):
    s = align.frame_windows(sig_blocks(spark, d), frames(spark, d), KEY, 5, BLOCK)
    return s.groupBy("recording_id", "frame_no").agg(
        F.sum(F.coalesce(F.size("part"), F.lit(0))).cast("bigint").alias("n"), F.min(F.array_min("part")).alias("lo"), F.max(F.array_max("part")).alias("hi"))
