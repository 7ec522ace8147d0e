"""Quality checks."""

from pyspark.sql import functions as F

from clampspark.config import SIGNAL_CHANNELS
from clampspark.operators import align
from clampspark.plans import qc
from clampspark.session import materialise
from . import query
from .intervals import PAIRED
from .scalars import CHANNELS_SQL, channels
from .sequences import ADAPTIVE
from .stimuli import PIECES, segments
from .views import BLOCK, CH, KEY, RATE, TRIAL, dealt_store, evt, rec, rec_lengths, sig, sig_blocks, sig_store, sql, table, trial_store

NAMED = """SELECT recording_id, sample_index, v / 40 AS v, k % 5 AS channel_index, name FROM sig
    JOIN ch ON ch.channel_index = sig.k % 5 AND ch.clamp_mode = 'current_clamp'"""


def channel_samples(spark, d):
    """Samples dealt to five channels by ``k``; volts are ``v / 40``."""
    return sig(spark, d, "k").select("recording_id", (F.col("k") % 5).alias("channel_index"), "sample_index", (F.col("v") / 40).alias("v"))


def cc(spark):
    return channels(spark).where("clamp_mode = 'current_clamp'")


@query("qc_sample_count", """SELECT recording_id, n_samples, off_b + off_c + off_t AS n_issues, CASE WHEN off_b + off_c + off_t > 0 THEN 'fail' ELSE 'pass' END AS status FROM (
    SELECT recording_id, n_samples, CASE WHEN recording_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS off_b, CASE WHEN recording_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS off_c,
      CASE WHEN recording_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS off_t FROM (SELECT user_id AS recording_id, count(*) AS n_samples FROM events GROUP BY 1))""")
def qc_sample_count(spark, d):
    i, n = F.col("recording_id"), F.col("n_samples")
    c = rec_lengths(spark, d).select(
        "recording_id", "n_samples", F.lit(5).alias("n_channels"), F.lit(RATE).alias("rate"),
        (n * 40 + F.when(i % 3 == 0, 8).otherwise(0)).alias("bin_bytes"),
        (n + F.when(i % 5 == 0, 1).otherwise(0)).alias("sidecar_samples"),
        ((n + F.when(i % 7 == 0, 2).otherwise(0)) / RATE).alias("sidecar_seconds"))
    return qc.sample_count(c).select("recording_id", "n_samples", "n_issues", "status")


@query("qc_finite", sql("sig", """SELECT recording_id, count(*) FILTER (WHERE k % 50 = 7) AS n_nonfinite, count(*) AS n_samples_total,
    CASE WHEN count(*) FILTER (WHERE k % 50 = 7) > 0 THEN 'fail' ELSE 'pass' END AS status FROM sig GROUP BY 1"""))
def qc_finite(spark, d):
    s = sig(spark, d, "k").select("recording_id", F.when(F.col("k") == 7, float("nan")).when(F.col("k") == 57, float("-inf")).otherwise(F.col("v")).alias("v"))
    return qc.finite(qc.channel_stats(s, KEY), KEY).select("recording_id", "n_nonfinite", "n_samples_total", "status")


SAT = dict(ch=CHANNELS_SQL, nm=NAMED, st="""SELECT recording_id, channel_index, name, min(v) AS min_v, max(v) AS max_v, count(*) FILTER (WHERE v >= 9.95 OR v <= -9.95) AS near_rail,
    count(*) FILTER (WHERE v >= 9.95 OR v <= -9.95) / count(*) AS frac FROM nm GROUP BY 1, 2, 3""",
    sx="SELECT *, CASE WHEN frac >= 1e-3 THEN 'fail' WHEN frac >= 1e-4 THEN 'warn' ELSE 'pass' END AS status FROM st")


def saturation(spark, d):
    s = qc.channel_stats(channel_samples(spark, d), CH).join(cc(spark).select("channel_index", "name"), "channel_index")
    return qc.saturation(s)


@query("qc_saturation", sql("sig", "SELECT recording_id, name, round(min_v, 6) AS min_v, round(max_v, 6) AS max_v, near_rail, round(frac, 9) AS frac, status FROM sx", **SAT))
def qc_saturation(spark, d):
    return saturation(spark, d).select("recording_id", "name", F.round("min_v", 6).alias("min_v"), F.round("max_v", 6).alias("max_v"),
                                       "near_rail", F.round("saturated_fraction", 9).alias("frac"), "status")


@query("qc_first_offender", sql("sig", """SELECT recording_id, status, CASE WHEN status <> 'pass' THEN name END AS channel, round(CASE WHEN status <> 'pass' THEN frac END, 9) AS value FROM sx
    QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, channel_index) = 1""", **SAT))
def qc_first_offender(spark, d):
    return qc.first_offender(saturation(spark, d), KEY, "channel_index", "name", "saturated_fraction").withColumn("value", F.round("value", 9))


@query("qc_dc_offset", sql("sig", """SELECT recording_id, name, round(avg(v), 6) AS mean_v, round(avg(v) * max(display_scale), 6) AS mean_display FROM nm JOIN (SELECT name AS nn, display_scale FROM ch WHERE clamp_mode = 'current_clamp') ON nn = name GROUP BY 1, 2""",
    ch=CHANNELS_SQL, nm=NAMED))
def qc_dc_offset(spark, d):
    s = qc.dc_offset(qc.channel_stats(channel_samples(spark, d), CH), cc(spark))
    return s.select("recording_id", "name", F.round("mean_v", 6).alias("mean_v"), F.round("mean_display", 6).alias("mean_display"))


@query("qc_baseline_rms", sql("sig evt len", """SELECT recording_id, name, round(CASE WHEN stop >= 3 THEN rms END, 6) AS rms_v, CASE WHEN stop >= 3 THEN 'pass' ELSE 'skip' END AS status FROM (
    SELECT nm.recording_id, name, stop, stddev_pop(v) FILTER (WHERE sample_index < stop) AS rms FROM nm JOIN bw USING (recording_id) WHERE name IN ('ScAmpOut', 'RawAmpOut') GROUP BY 1, 2, 3)""",
    ch=CHANNELS_SQL, nm=NAMED, bw="""SELECT l.recording_id, CASE WHEN a IS NULL THEN n_samples ELSE greatest(0, a - 1) END AS stop FROM len l
        LEFT JOIN (SELECT recording_id, min(sample_index) AS a FROM evt WHERE event_type = 'apply' GROUP BY 1) USING (recording_id)"""))
def qc_baseline_rms(spark, d):
    w = qc.baseline_windows(rec_lengths(spark, d), evt(spark, d), KEY)
    store = dealt_store(spark, d)
    # Channels are told by the nodes: a recording lacks a row for a channel without samples.
    there = store.zones().where("n_good > 0").select(*CH).distinct().join(cc(spark).where(F.col("name").isin(SIGNAL_CHANNELS)).select("channel_index", "name"), "channel_index")
    r = qc.baseline_rms(store.blocks, there.join(w, KEY), CH, ["recording_id", "name"], BLOCK, least=3)
    return r.select("recording_id", "name", F.round("rms_v", 6).alias("rms_v"), "status")


@query("qc_drift", sql("sig len", """SELECT recording_id, round(slope, 6) AS slope_v_per_s, round(slope * n / 50.0, 6) AS total_change_v, CASE WHEN n >= 50 THEN round(sqrt(greatest(0, syy - slope * sxy) / n), 6) END AS residual_std_v FROM (
    SELECT recording_id, n_samples AS n, regr_slope(v, sample_index / 50.0::DOUBLE) AS slope, regr_syy(v, sample_index / 50.0::DOUBLE) AS syy, regr_sxy(v, sample_index / 50.0::DOUBLE) AS sxy
    FROM (SELECT recording_id, n_samples, sample_index, CASE WHEN n_samples >= 50 THEN v END AS v FROM sig JOIN len USING (recording_id)) GROUP BY 1, 2)"""))
def qc_drift(spark, d):
    r = qc.drift(sig(spark, d), KEY, 50)
    return r.select("recording_id", *[F.round(c, 6).alias(c) for c in ("slope_v_per_s", "total_change_v", "residual_std_v")])


# Welch's method at a rate of 32: segments of 32 samples, 16 apart, periodic Hann; scale factors cancel in the share.
LINE = dict(
    hs="SELECT * FROM (SELECT recording_id, v, sample_index, unnest([sample_index // 16, sample_index // 16 - 1]) AS s FROM sig) WHERE s >= 0",
    hm="SELECT recording_id, s, avg(v) AS m FROM hs GROUP BY 1, 2 HAVING count(*) = 32",
    hw="SELECT recording_id, s, sample_index - s * 16 AS j, (v - m) * (0.5 - 0.5 * cos(2 * pi() * (sample_index - s * 16) / 32)) AS x FROM hs JOIN hm USING (recording_id, s)",
    hk="SELECT unnest(range(0, 17)) AS b",
    hp="""SELECT recording_id, s, b, (pow(sum(x * cos(2 * pi() * b * j / 32)), 2) + pow(sum(x * sin(2 * pi() * b * j / 32)), 2)) * CASE WHEN b IN (0, 16) THEN 1 ELSE 2 END AS p
        FROM hw CROSS JOIN hk GROUP BY 1, 2, 3""",
    hf="""SELECT recording_id, sum(p * CASE WHEN b IN (8, 12) THEN 1 WHEN b IN (7, 9, 11, 13) THEN 0.5 ELSE 0 END) / nullif(sum(p * CASE WHEN b IN (0, 16) THEN 0.5 ELSE 1 END), 0) AS line
        FROM hp GROUP BY 1""",
)


@query("qc_line_noise", sql("sig len", """SELECT recording_id, round(line, 6) AS line_fraction, CASE WHEN line IS NULL THEN 'skip' WHEN line >= 0.3 THEN 'fail' WHEN line >= 0.1 THEN 'warn' ELSE 'pass' END AS status
    FROM len LEFT JOIN hf USING (recording_id)""", **LINE))
def qc_line_noise(spark, d):
    """Spectral check at a rate of 32, lines at 8 and 12."""
    return qc.line_noise(sig_blocks(spark, d), KEY, 32, freqs=(8.0, 12.0), band=1.0).select("recording_id", F.round("line_fraction", 6).alias("line_fraction"), "status")


@query("qc_events", sql("evt len", """SELECT recording_id, n_events, n_backward, n_outside, n_double, n_orphan, coalesce(u, '') AS unclosed, array_to_string(msgs[1:3], '; ') AS message,
      CASE WHEN n_events = 0 THEN 'skip' WHEN len(msgs) > 0 THEN 'warn' ELSE 'pass' END AS status FROM (
    SELECT g.*, u, list_concat(list_concat(CASE WHEN n_backward > 0 THEN ['sample indices go back'] ELSE [] END, CASE WHEN n_outside > 0 THEN [n_outside || ' events beyond the ' || n_samples || ' samples'] ELSE [] END), coalesce(p, [])) AS msgs
    FROM (SELECT recording_id, max(n_samples) AS n_samples, count(event_seq) AS n_events, count(*) FILTER (WHERE prev > idx) AS n_backward, count(*) FILTER (WHERE idx < 0 OR idx >= n_samples) AS n_outside,
        count(*) FILTER (WHERE event_type = 'apply' AND pt = 'apply') AS n_double, count(*) FILTER (WHERE event_type = 'clear' AND (pt IS NULL OR pt <> 'apply')) AS n_orphan FROM (SELECT recording_id FROM len) LEFT JOIN e2 USING (recording_id) GROUP BY 1) g
    LEFT JOIN (SELECT recording_id, list(CASE WHEN event_type = 'apply' THEN 'stimulus ' || stimulus_index || ' started again while on' ELSE 'stimulus ' || stimulus_index || ' ended while off' END ORDER BY event_seq) AS p
        FROM e2 WHERE (event_type = 'apply' AND pt = 'apply') OR (event_type = 'clear' AND (pt IS NULL OR pt <> 'apply')) GROUP BY 1) USING (recording_id)
    LEFT JOIN (SELECT recording_id, string_agg(stimulus_index::VARCHAR, ',' ORDER BY stimulus_index) AS u FROM (SELECT recording_id, stimulus_index, arg_max(event_type, event_seq) AS t FROM evt GROUP BY 1, 2) WHERE t = 'apply' GROUP BY 1) USING (recording_id))""",
    e1="SELECT evt.*, n_samples, CASE WHEN event_seq % 17 = 0 THEN event_seq + 20 ELSE event_seq END AS idx FROM evt JOIN len USING (recording_id)",
    e2="""SELECT *, lag(idx) OVER (PARTITION BY recording_id ORDER BY event_seq) AS prev, lag(event_type) OVER (PARTITION BY recording_id, stimulus_index ORDER BY event_seq) AS pt FROM e1"""))
def qc_events(spark, d):
    e = evt(spark, d).withColumn("sample_index", F.when(F.col("event_seq") % 17 == 0, F.col("event_seq") + 20).otherwise(F.col("event_seq")))
    r = qc.events(e, rec_lengths(spark, d), KEY)
    return r.select("recording_id", "n_events", "n_backward", "n_outside", "n_double", "n_orphan", F.array_join("unclosed", ",").alias("unclosed"), "message", "status")


TRIALS = dict(
    t="""SELECT l_orderkey AS recording_id, l_linenumber - 1 AS trial_index, CASE WHEN min(l_quantity) < 2 THEN 4 ELSE 5 END AS n_channels FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    x="SELECT o_orderkey AS recording_id, o_orderkey % 6 + 1 AS n_expected FROM orders",
    ms="""SELECT recording_id, i, row_number() OVER (PARTITION BY recording_id ORDER BY i) AS rk FROM (SELECT recording_id, unnest(range(0, n_expected)) AS i FROM x) w
        WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.recording_id = w.recording_id AND t.trial_index = w.i)""",
)


def trial_rows(spark, d):
    li = table(spark, d, "lineitem")
    t = li.groupBy(F.col("l_orderkey").alias("recording_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("trial_index")).agg(
        F.when(F.min("l_quantity") < 2, 4).otherwise(5).alias("n_channels"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), (F.col("o_orderkey") % 6 + 1).alias("n_expected"))
    return t, x


@query("missing_trials", sql("", "SELECT recording_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS missing FROM ms WHERE rk <= 5 GROUP BY 1", **TRIALS))
def missing_trials(spark, d):
    t, x = trial_rows(spark, d)
    return qc.missing_trials(x, t, KEY).select("recording_id", F.array_join("missing", ",").alias("missing"))


@query("qc_trials", sql("", """SELECT x.recording_id, x.n_expected, coalesce(n, 0) AS observed, coalesce(lo = 0 AND hi = n - 1, false) AS contiguous, coalesce(m, '') AS missing,
    CASE WHEN n IS NULL OR n <> n_expected OR NOT (lo = 0 AND hi = n - 1) OR c > 1 THEN 'fail' ELSE 'pass' END AS status FROM x
    LEFT JOIN (SELECT recording_id, count(*) AS n, min(trial_index) AS lo, max(trial_index) AS hi, count(DISTINCT n_channels) AS c FROM t GROUP BY 1) USING (recording_id)
    LEFT JOIN (SELECT recording_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS m FROM ms WHERE rk <= 5 GROUP BY 1) USING (recording_id)""", **TRIALS))
def qc_trials(spark, d):
    t, x = trial_rows(spark, d)
    return qc.trial_table(x, t, KEY).withColumn("missing", F.array_join("missing", ","))


@query("qc_ttl_frames", sql("sig", """SELECT e.recording_id, n_edges, coalesce(f, 0) AS n_frames, n_edges - coalesce(f, 0) AS drift, CASE WHEN u > 0 THEN 'warn' WHEN n_edges = coalesce(f, 0) THEN 'pass' WHEN abs(n_edges - coalesce(f, 0)) <= 1 THEN 'warn' ELSE 'fail' END AS status
    FROM (SELECT r.recording_id, coalesce(count(*) FILTER (WHERE h AND NOT p), 0) AS n_edges FROM r LEFT JOIN h USING (recording_id) GROUP BY 1) e
    JOIN (SELECT user_id AS recording_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS f, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS u FROM events GROUP BY 1, 3) v USING (recording_id)""", **ADAPTIVE))
def qc_ttl_frames(spark, d):
    e = align.adaptive_edge_counts(sig_store(spark, d), 200.0)
    ev = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), "event_type")
    v = ev.groupBy("recording_id").agg(F.count_if(F.col("event_type") == "click").alias("frame_count"))
    broken = v.where("recording_id % 10 = 0").select("recording_id", F.lit(None).cast("bigint").alias("frame_count"))
    r = qc.frame_counts(e, v.unionByName(broken), KEY)
    return r.select("recording_id", "n_edges", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), "drift", "status")


LINES = dict(ln="SELECT doc_id AS recording_id, unnest(string_split(text, chr(10))) AS line FROM documents")


def log_lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), F.explode(F.split("text", "\n")).alias("line"))


@query("qc_log", sql("", """SELECT recording_id, count(*) AS log_lines, count(*) FILTER (WHERE contains(line, 'WARN')) AS warnings, count(*) FILTER (WHERE contains(line, 'ERROR')) AS errors,
    CASE WHEN count(*) FILTER (WHERE contains(line, 'ERROR')) > 0 THEN 'fail' WHEN count(*) FILTER (WHERE contains(line, 'WARN')) > 0 THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT recording_id, replace(replace(line, ' and ', ' WARN '), ' the ', ' ERROR ') AS line FROM ln WHERE trim(line, ' ') <> '') GROUP BY 1""", **LINES))
def qc_log(spark, d):
    l = log_lines(spark, d).withColumn("line", F.replace(F.replace("line", F.lit(" and "), F.lit(" WARN ")), F.lit(" the "), F.lit(" ERROR ")))
    return qc.acquisition_log(l, KEY)


@query("qc_cmd_continuous", sql("sig evt len", """SELECT recording_id, n_windows, round(a, 6) AS active_rms_v, round(q, 6) AS inactive_rms_v, CASE WHEN n_windows = 0 THEN 'skip' WHEN q > 0.25 THEN 'warn' WHEN a < 0.01 THEN 'warn' ELSE 'pass' END AS status FROM (
    SELECT s.recording_id, coalesce(sqrt(avg(v * v) FILTER (WHERE act)), 0) AS a, coalesce(sqrt(avg(v * v) FILTER (WHERE NOT act)), 0) AS q FROM (
      SELECT s.recording_id, v, EXISTS (SELECT 1 FROM pw WHERE pw.recording_id = s.recording_id AND s.sample_index >= pw.start AND s.sample_index < pw.stop) AS act FROM sig s) s GROUP BY 1)
    JOIN (SELECT l.recording_id, count(pw.start) AS n_windows FROM len l LEFT JOIN pw USING (recording_id) GROUP BY 1) USING (recording_id)""", **PAIRED))
def qc_cmd_continuous(spark, d):
    from clampspark.operators.stimulus import paired_windows
    n = rec_lengths(spark, d)
    r = qc.command_activity(sig_blocks(spark, d), paired_windows(evt(spark, d), n, KEY), n, KEY, BLOCK)
    return r.select("recording_id", "n_windows", F.round("active_rms_v", 6).alias("active_rms_v"), F.round("inactive_rms_v", 6).alias("inactive_rms_v"), "status")


CMD = dict(**PIECES, pr="""SELECT bs.recording_id, bs.trial_index, sample_index, v, volts FROM bs JOIN seg ON seg.stimulus_index = bs.vec_id AND sample_index >= seg_start AND sample_index < seg_end""")


def trial_pairs(spark, d):
    """Recorded trials of 64 samples and the segments of the stimulus numbered like their vector."""
    trials = trial_store(spark, d).blocks
    named = trials.select(F.col("vec_id").alias("stimulus_index"), *TRIAL)
    seg = segments(spark, d, named.select("stimulus_index")).join(named, "stimulus_index")
    return trials.drop("vec_id"), seg


@query("cmd_vs_rec", sql("stim bs", "SELECT recording_id, trial_index, count(*) AS n, round(sum((v - volts) * (v - volts)), 6) AS sq FROM pr GROUP BY 1, 2", **CMD))
def cmd_vs_rec(spark, d):
    from clampspark.operators.intervals import samples_in
    t, seg = trial_pairs(spark, d)
    s = samples_in(t, seg.drop("stimulus_index"), ["recording_id", "trial_index"], BLOCK, "seg_start", "seg_end")
    e = F.col("v") - F.col("volts")
    return s.groupBy("recording_id", "trial_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(e * e), 6).alias("sq"))


XC = """l AS (SELECT recording_id, trial_index, max(n) OVER (PARTITION BY recording_id, trial_index) AS n, lag_ FROM (SELECT recording_id, trial_index, count(*) AS n FROM pr GROUP BY 1, 2) CROSS JOIN (SELECT unnest(range(-63, 64)) AS lag_))"""
CMD_LAG = dict(
    **CMD,
    mm="SELECT recording_id, trial_index, count(*) AS n, avg(v) AS mv, avg(volts) AS me, max(abs(v)) AS mx FROM pr GROUP BY 1, 2",
    z="SELECT pr.recording_id, pr.trial_index, sample_index, v - mv AS r, volts - me AS e FROM pr JOIN mm USING (recording_id, trial_index)",
    fl="SELECT recording_id, trial_index, max(abs(r)) < 1e-9 OR max(abs(e)) < 1e-9 AS flat FROM z GROUP BY 1, 2",
    xc="""SELECT a.recording_id, a.trial_index, a.sample_index - b.sample_index AS lag_, abs(sum(a.r * b.e)) AS c FROM z a JOIN z b USING (recording_id, trial_index) GROUP BY 1, 2, 3""",
    bl="SELECT recording_id, trial_index, arg_max(lag_, c) AS lag_ FROM xc GROUP BY 1, 2",
    lg="SELECT recording_id, trial_index, CASE WHEN flat THEN 0 ELSE lag_ END AS lag_ FROM bl JOIN fl USING (recording_id, trial_index)",
)


@query("qc_cmd_trial", sql("stim bs", """SELECT recording_id, trial_index, n AS n_samples, round(peak, 6) AS peak_cmd_v, round(rmse, 6) AS rmse_v, round(pe, 6) AS peak_error_v, round(lag_ / 1000.0::DOUBLE * 1000, 6) AS timing_offset_ms,
    CASE WHEN rmse > greatest(peak * 0.5, 0.25) OR abs(lag_) > 5 THEN 'fail' WHEN rmse > greatest(peak * 0.05, 0.05) OR abs(lag_) > 1 THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT recording_id, trial_index, count(*) AS n, max(abs(volts)) AS peak, sqrt(avg((v - volts) * (v - volts))) AS rmse, max(abs(v - volts)) AS pe FROM pr GROUP BY 1, 2) JOIN lg USING (recording_id, trial_index)""", **CMD_LAG))
def qc_cmd_trial(spark, d):
    t, seg = trial_pairs(spark, d)
    r = qc.command_error(t, seg.drop("stimulus_index"), ["recording_id", "trial_index"], BLOCK, RATE)
    return r.select("recording_id", "trial_index", "n_samples", *[F.round(c, 6).alias(c) for c in ("peak_cmd_v", "rmse_v", "peak_error_v", "timing_offset_ms")], "status")


def result_rows(spark, d):
    """Check results of every recording: finite, saturation, offset, counts, events, log order."""
    n = rec_lengths(spark, d)
    # One pass over the samples serves three checks.
    stats = materialise(qc.channel_stats(channel_samples(spark, d), CH), "channel-stats")
    sat = qc.first_offender(qc.saturation(stats).join(cc(spark).select("channel_index", "name"), "channel_index"), KEY, "channel_index", "name", "saturated_fraction")
    fin = qc.finite(stats, KEY)
    off = stats.groupBy("recording_id").agg(F.avg("mean_v").alias("mean_v")).withColumn("status", F.lit("pass"))
    return qc.run_checks({
        "finite values": lambda: qc.as_result(fin, KEY, "Acquisition", "finite values", F.lit(""), {"n_nonfinite": "n_nonfinite"}),
        "events": lambda: qc.as_result(qc.events(evt(spark, d), n, KEY), KEY, "Acquisition", "events", F.col("message"), {"n_events": "n_events"}),
    }, n, KEY, "Acquisition").unionByName(qc.run_checks({
        "saturation": lambda: qc.as_result(sat, KEY, "Signal", "saturation", F.coalesce("channel", F.lit("all channels within limits")), {"value": "value"}),
        "offset": lambda: qc.as_result(off, KEY, "Signal", "offset", F.lit(""), {"mean_v": "mean_v"}),
    }, n, KEY, "Signal"))


CHECKS = dict(
    **SAT,
    ev2="SELECT *, lag(event_type) OVER (PARTITION BY recording_id, stimulus_index ORDER BY event_seq) AS pt FROM evt",
    c1="SELECT recording_id, 'Acquisition' AS section, 1 AS sev FROM len",
    c2="""SELECT recording_id, 'Acquisition' AS section, max(CASE WHEN event_type IS NULL THEN 0 WHEN (event_type = 'apply' AND pt = 'apply') OR (event_type = 'clear' AND (pt IS NULL OR pt <> 'apply')) THEN 2 ELSE 1 END) AS sev
        FROM (SELECT recording_id FROM len) LEFT JOIN ev2 USING (recording_id) GROUP BY 1""",
    c3="SELECT recording_id, 'Signal' AS section, max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS sev FROM sx GROUP BY 1",
    c4="SELECT recording_id, 'Signal' AS section, 1 AS sev FROM len",
    al="SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4",
)


@query("qc_worst", sql("sig evt len", """SELECT recording_id, coalesce(section, 'overall') AS section, ['pass', 'warn', 'fail'][max(sev)] AS status, count(*) AS n_checks FROM al GROUP BY ROLLUP (recording_id, section) HAVING recording_id IS NOT NULL""", **CHECKS))
def qc_worst(spark, d):
    r = qc.roll_up(result_rows(spark, d), KEY)
    return r.select("recording_id", F.coalesce("section", F.lit("overall")).alias("section"), "status", "n_checks")


@query("qc_report", sql("sig evt len", "SELECT recording_id, 'continuous' AS mode, ['pass', 'warn', 'fail'][max(sev)] AS status, CAST(2 AS BIGINT) AS n_sections, count(*) AS n_checks FROM al GROUP BY 1", **CHECKS))
def qc_report(spark, d):
    """Report written as JSON, one row per recording, and read back."""
    from clampspark.session import scratch_path
    rep = qc.report(result_rows(spark, d), rec_lengths(spark, d).select("recording_id", F.lit("continuous").alias("mode")), KEY)
    path = scratch_path(spark, "qc-report")
    rep.write.json(path)
    back = spark.read.schema(rep.schema).json(path)
    n = F.aggregate("sections", F.lit(0).cast("bigint"), lambda a, s: a + F.size(s["checks"]))
    return back.select("recording_id", "mode", "status", F.size("sections").cast("bigint").alias("n_sections"), n.alias("n_checks"))


META = dict(
    a="SELECT recording_id, 20000 AS rate, genotype AS names, CAST(start_time AS DATE)::VARCHAR || 'T00:00:00.25' AS st FROM rec",
    b="""SELECT recording_id, CASE WHEN recording_id % 11 = 0 THEN 10000 ELSE 20000 END AS rate, CASE WHEN recording_id % 13 = 0 THEN genotype || 'x' ELSE genotype END AS names,
        CASE WHEN recording_id % 17 = 0 THEN CAST(start_time AS DATE)::VARCHAR || 'T00:00:01.50' ELSE CAST(start_time AS DATE)::VARCHAR || 'T00:00:00.75' END AS st FROM rec WHERE recording_id % 7 <> 0""",
)


@query("metadata_agree", sql("rec", """SELECT a.recording_id, coalesce(a.rate <> b.rate, false) AS rate_differs, coalesce(a.names <> b.names, false) AS names_differ,
    coalesce(split_part(a.st, '.', 1) <> split_part(b.st, '.', 1), false) AS start_differs,
    CASE WHEN b.recording_id IS NULL THEN 'skip' WHEN a.rate <> b.rate OR a.names <> b.names OR split_part(a.st, '.', 1) <> split_part(b.st, '.', 1) THEN 'warn' ELSE 'pass' END AS status
    FROM a LEFT JOIN b USING (recording_id)""", **META))
def metadata_agree(spark, d):
    i = F.col("recording_id")
    day = F.col("start_time").cast("date").cast("string")
    r = rec(spark, d).select("recording_id", "genotype", day.alias("day"))
    store = r.select("recording_id", F.lit(20000).alias("rate"), F.array("genotype").alias("channel_names"), F.concat("day", F.lit("T00:00:00.25")).alias("start_time"))
    side = r.where(i % 7 != 0).select(
        "recording_id", F.when(i % 11 == 0, 10000).otherwise(20000).alias("rate"),
        F.array(F.when(i % 13 == 0, F.concat("genotype", F.lit("x"))).otherwise(F.col("genotype"))).alias("channel_names"),
        F.concat("day", F.when(i % 17 == 0, "T00:00:01.50").otherwise("T00:00:00.75")).alias("start_time"))
    return qc.metadata_agreement(store, side, KEY)
