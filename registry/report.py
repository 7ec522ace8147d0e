"""The whole quality report: every check of every recording, by recording mode."""

from pyspark.sql import functions as F

from clampspark.config import SIGNAL_CHANNELS
from clampspark.operators import align
from clampspark.operators.blocks import pack
from clampspark.operators.catalog import assemble, recording_mode
from clampspark.operators.stimulus import paired_windows, timing_residuals
from clampspark.plans import qc
from clampspark.session import materialise, scratch_path
from . import query
from .intervals import PAIRED
from .quality import CMD_LAG, LINE, SAT, cc, channel_samples, log_lines
from .scalars import channels
from .stimuli import segments
from .views import BLOCK, CH, HALO, KEY, RATE, TRIAL, block_store, dealt_store, evt, rec_lengths, sig, sig_store, sql, stim, table, trial_store

CUT = 40   # samples per trial of a trial recording
LINES = ["recording_id", "trial_index", "channel_index"]
SECTIONS = ("Acquisition", "Signal", "Command")


def recordings(spark, d):
    """Even recordings have trials, odd ones and every tenth continuous data."""
    i = F.col("recording_id")
    r = rec_lengths(spark, d).select("recording_id", "n_samples", (i % 2 == 0).alias("has_trials"), ((i % 2 == 1) | (i % 10 == 0)).alias("has_continuous"), F.lit(None).cast("string").alias("start_time"))
    return recording_mode(r).select("recording_id", "n_samples", "mode")


MODES = dict(rm="SELECT recording_id, n_samples, CASE WHEN recording_id % 2 = 0 AND recording_id % 10 <> 0 THEN 'trial' ELSE 'continuous' END AS mode FROM len")


# ---- trigger lines --------------------------------------------------------------------------

def lines(spark, d):
    """Channel 4 is the loopback (the signal), channel 3 the camera (``k``); some recordings lack one or both."""
    i = F.col("recording_id")
    have = F.array_compact(F.array(F.when(i % 3 != 0, F.struct(F.lit(4).alias("channel_index"), F.lit("TTLLoopback").alias("name"))),
                                   F.when(i % 9 != 0, F.struct(F.lit(3).alias("channel_index"), F.lit("Camera").alias("name")))))
    return recordings(spark, d).select("recording_id", F.explode(have).alias("c")).select("recording_id", "c.*")


def line_store(spark, d):
    """Both lines, per trial of trial recordings (trial -1: the whole of a continuous one)."""
    def build():
        s = sig(spark, d, "k").join(recordings(spark, d).select("recording_id", "mode"), "recording_id")
        trial = F.when(F.col("mode") == "trial", F.floor(F.col("sample_index") / CUT)).otherwise(F.lit(-1)).cast("bigint")
        s = s.withColumn("trial_index", trial).withColumn("sample_index", F.col("sample_index") - F.greatest(F.col("trial_index"), F.lit(0)) * CUT)
        both = F.explode(F.array(F.struct(F.lit(4).alias("channel_index"), F.col("v").alias("v")), F.struct(F.lit(3).alias("channel_index"), F.col("k").cast("double").alias("v"))))
        s = s.select("recording_id", "trial_index", "sample_index", both.alias("c")).select("recording_id", "trial_index", "sample_index", "c.*")
        return pack(s.join(lines(spark, d).select("recording_id", "channel_index"), ["recording_id", "channel_index"]), LINES, BLOCK, HALO)
    return block_store(spark, d, "line-blocks", build, LINES)


LINE_SQL = dict(
    **MODES,
    lc="SELECT recording_id, CASE WHEN recording_id % 3 <> 0 THEN 4 ELSE 3 END AS channel_index, CASE WHEN recording_id % 3 <> 0 THEN 'TTLLoopback' ELSE 'Camera' END AS name FROM len WHERE recording_id % 9 <> 0",
    lv="""SELECT s.recording_id, CASE WHEN mode = 'trial' THEN sample_index // 40 ELSE -1 END AS t, sample_index, CASE WHEN channel_index = 4 THEN v ELSE k::DOUBLE END AS v
        FROM sig s JOIN rm USING (recording_id) JOIN lc USING (recording_id)""",
    lr="SELECT recording_id, t, min(v) AS lo, max(v) AS hi, count(*) AS n FROM lv GROUP BY 1, 2",
    lh="""SELECT recording_id, t, v > 0.5 * (lo + hi) AS h, lag(v > 0.5 * (lo + hi)) OVER (PARTITION BY recording_id, t ORDER BY sample_index) AS p FROM lv JOIN lr USING (recording_id, t) WHERE hi - lo >= 50 AND n >= 2""",
    le="SELECT recording_id, sum(c) AS n_edges FROM (SELECT lr.recording_id, lr.t, coalesce(count(*) FILTER (WHERE h AND NOT p), 0) AS c FROM lr LEFT JOIN lh USING (recording_id, t) GROUP BY 1, 2) GROUP BY 1",
    vd="""SELECT user_id AS recording_id, count(*) FILTER (WHERE event_type = 'click') AS f, user_id % 10 = 3 AS bad FROM events WHERE user_id % 13 <> 0 GROUP BY user_id""",
    tf="""SELECT recording_id, CAST(n_edges AS BIGINT) AS n_edges, f AS n_frames, CASE WHEN bad THEN 'warn' WHEN n_edges = f THEN 'pass' WHEN abs(n_edges - f) <= 1 THEN 'warn' ELSE 'fail' END AS status FROM le JOIN vd USING (recording_id)""",
)


def line_frames(spark, d):
    e = materialise(align.adaptive_edge_counts(line_store(spark, d), 50.0), "line-edges")
    ev = table(spark, d, "events").where("user_id % 13 <> 0").select(F.col("user_id").alias("recording_id"), "event_type")
    v = ev.groupBy("recording_id").agg(F.count_if(F.col("event_type") == "click").alias("frame_count"))
    broken = v.where("recording_id % 10 = 3").select("recording_id", F.lit(None).cast("bigint").alias("frame_count"))
    return qc.trial_frame_counts(e, lines(spark, d), v.unionByName(broken), KEY)


@query("trigger_line", sql("len", "SELECT recording_id, channel_index, name FROM lc", lc=LINE_SQL["lc"]))
def trigger_line(spark, d):
    """The loopback where there is one, else the camera."""
    return qc.trigger_channel(lines(spark, d), KEY).select("recording_id", "channel_index", "name")


@query("qc_line_frames", sql("sig len", "SELECT recording_id, n_edges, n_frames, status FROM tf", **LINE_SQL))
def qc_line_frames(spark, d):
    """Trigger edges of the chosen line, summed over trials, against video frames."""
    return line_frames(spark, d).where("n_videos IS NOT NULL").select("recording_id", "n_edges", "n_frames", "status")


# ---- commands by stimulus name ----------------------------------------------------------------

NAMES = dict(
    **{k: v for k, v in CMD_LAG.items() if k in ("b", "amp", "rep", "pieces", "seg")},
    df="SELECT 'part ' || (stimulus_index % 37) AS name, max(stimulus_index) AS stimulus_index FROM stim GROUP BY 1",
    tn="SELECT recording_id, trial_index, 'part ' || (vec_id % 41) AS name FROM blk",
    ts="SELECT tn.*, df.stimulus_index FROM tn LEFT JOIN df USING (name)",
    pr="""SELECT bs.recording_id, bs.trial_index, sample_index, v, volts FROM bs JOIN ts USING (recording_id, trial_index) JOIN seg ON seg.stimulus_index = ts.stimulus_index AND sample_index >= seg_start AND sample_index < seg_end""",
    **{k: v for k, v in CMD_LAG.items() if k in ("mm", "z", "fl", "xc", "bl", "lg")},
    pt="""SELECT recording_id, trial_index, rmse, lag_, CASE WHEN rmse > greatest(peak * 0.5, 0.25) OR abs(lag_) > 5 THEN 3 WHEN rmse > greatest(peak * 0.05, 0.05) OR abs(lag_) > 1 THEN 2 ELSE 1 END AS sev
        FROM (SELECT recording_id, trial_index, max(abs(volts)) AS peak, sqrt(avg((v - volts) * (v - volts))) AS rmse FROM pr GROUP BY 1, 2) JOIN lg USING (recording_id, trial_index)""",
    cv="""SELECT recording_id, count(*) AS n_trials, count(*) FILTER (WHERE sev IS NULL) AS n_skipped, coalesce(max(sev), 1) AS sev, CASE WHEN max(sev) > 1 THEN arg_min(trial_index, -sev * 1000000 + trial_index) FILTER (WHERE sev IS NOT NULL) END AS worst_trial
        FROM tn LEFT JOIN pt USING (recording_id, trial_index) GROUP BY 1""",
)


def named_trials(spark, d):
    """Trials name their stimulus; 37 names are defined several times each, four names are not defined."""
    t = trial_store(spark, d).blocks.select(*TRIAL, F.concat(F.lit("part "), F.col("vec_id") % 41).alias("name"))
    defs = stim(spark, d).select(F.concat(F.lit("part "), F.col("stimulus_index") % 37).alias("name"), "stimulus_index")
    return qc.stimulus_by_name(t, defs, [])


def commands(spark, d):
    t = materialise(named_trials(spark, d), "named-trials")
    named = t.where("found").select(*TRIAL, "stimulus_index")
    seg = segments(spark, d, named.select("stimulus_index")).join(named, "stimulus_index").drop("stimulus_index")
    e = qc.command_error(trial_store(spark, d).blocks.drop("vec_id"), seg, TRIAL, BLOCK, RATE)
    return qc.command_verdict(t, e, KEY)


@query("stimulus_by_name", sql("blk stim", "SELECT recording_id, trial_index, name, coalesce(stimulus_index, -1) AS stimulus_index, stimulus_index IS NOT NULL AS found FROM ts", df=NAMES["df"], tn=NAMES["tn"], ts=NAMES["ts"]))
def stimulus_by_name(spark, d):
    """The definition each trial's stimulus name stands for; -1 where there is none."""
    return named_trials(spark, d).select("recording_id", "trial_index", "name", F.coalesce("stimulus_index", F.lit(-1)).alias("stimulus_index"), "found")


@query("cmd_verdict", sql("stim bs", "SELECT recording_id, n_trials, n_skipped, ['pass', 'warn', 'fail'][sev] AS status, worst_trial FROM cv", **NAMES))
def cmd_verdict(spark, d):
    """Verdict per recording over its trials; trials without a definition are skipped."""
    return commands(spark, d).select("recording_id", "n_trials", "n_skipped", "status", "worst_trial")


# ---- the baseline of trial recordings --------------------------------------------------------

def trial_lengths(spark, d):
    n = recordings(spark, d).where("mode = 'trial'")
    t = n.select("recording_id", "n_samples", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_samples") - 1) / CUT).cast("bigint"))).alias("trial_index"))
    return t.select("recording_id", "trial_index", F.least(F.lit(CUT), F.col("n_samples") - F.col("trial_index") * CUT).alias("n_samples"))


def baselines(spark, d):
    """Before the first stimulus, or the first tenth of the first trial."""
    r = recordings(spark, d)
    continuous = qc.baseline_windows(r.where("mode = 'continuous'").select("recording_id", "n_samples"), evt(spark, d), KEY)
    return continuous.unionByName(qc.trial_baseline_windows(trial_lengths(spark, d), KEY))


BASE = dict(**MODES, bw="""SELECT recording_id, CAST(CASE WHEN mode = 'trial' THEN greatest(1, floor(least(40, n_samples) * 0.1)) WHEN a IS NULL THEN n_samples ELSE greatest(0, a - 1) END AS BIGINT) AS stop FROM rm
    LEFT JOIN (SELECT recording_id, min(sample_index) AS a FROM evt WHERE event_type = 'apply' GROUP BY 1) USING (recording_id)""")


@query("baseline_by_mode", sql("evt len", "SELECT rm.recording_id, mode, stop FROM bw JOIN rm USING (recording_id)", **BASE))
def baseline_by_mode(spark, d):
    return baselines(spark, d).join(recordings(spark, d), "recording_id").select("recording_id", "mode", F.col("end").alias("stop"))


# ---- recordings put together, and the log against the plan ------------------------------------

@query("recording_assembly", sql("len blk evt", """SELECT rm.recording_id, mode, '' AS start_time, CASE WHEN rm.recording_id % 3 = 0 THEN 'I_mem,V_pip,AmpCmd,Camera,TTLLoopback' ELSE 'ScAmpOut,RawAmpOut,AmpCmd,Camera,TTLLoopback' END AS names,
    CASE WHEN mode = 'trial' THEN coalesce(n, 0) ELSE 0 END AS n_trials, CASE WHEN mode = 'trial' THEN coalesce(d, 0) ELSE 0 END AS n_unnumbered, CASE WHEN mode = 'trial' THEN coalesce(u, 0) ELSE 0 END AS n_unnamed,
    CASE WHEN mode = 'continuous' THEN coalesce(e, 0) ELSE 0 END AS n_events, rm.recording_id % 7 <> 0 AS has_sidecar FROM rm
    LEFT JOIN (SELECT recording_id, count(*) AS n, count(*) FILTER (WHERE vec_id % 7 = 0) AS d, count(*) FILTER (WHERE vec_id % 3 = 0) AS u FROM blk GROUP BY 1) USING (recording_id)
    LEFT JOIN (SELECT recording_id, count(*) AS e FROM evt GROUP BY 1) USING (recording_id)""", **MODES))
def recording_assembly(spark, d):
    i, v = F.col("recording_id"), F.col("vec_id")
    r = rec_lengths(spark, d).select("recording_id", (i % 2 == 0).alias("has_trials"), ((i % 2 == 1) | (i % 10 == 0)).alias("has_continuous"), F.lit(None).cast("string").alias("start_time"))
    ch = r.select("recording_id", F.when(i % 3 == 0, "voltage_clamp").otherwise("current_clamp").alias("clamp_mode")).join(channels(spark), "clamp_mode")
    t = trial_store(spark, d).blocks.select(
        "recording_id", F.when(v % 7 != 0, F.col("trial_index")).alias("trial_index"), F.lit(None).cast("bigint").alias("stimulus_index"),
        F.when(v % 3 != 0, F.concat(F.lit("part "), v)).alias("stimulus_name"), F.lit(None).cast("string").alias("onset_time"))
    out, trials, _ = assemble(r, ch, t, evt(spark, d), r.where(i % 7 != 0), KEY)
    n = trials.groupBy("recording_id").agg(F.count_if((F.col("trial_index") == -1) & (F.col("stimulus_index") == -1)).alias("n_unnumbered"), F.count_if((F.col("stimulus_name") == "") & (F.col("onset_time") == "")).alias("n_unnamed"))
    zero = F.lit(0).cast("bigint")
    return out.join(n, "recording_id", "left").select(
        "recording_id", "mode", "start_time", F.array_join("channel_names", ",").alias("names"), "n_trials", F.coalesce("n_unnumbered", zero).alias("n_unnumbered"), F.coalesce("n_unnamed", zero).alias("n_unnamed"),
        "n_events", "has_sidecar")


@query("event_residual", sql("evt len", """SELECT p.recording_id, p.event_type, p.place, p.planned_index, coalesce(g.sample_index - p.planned_index, -1000000) AS residual
    FROM (SELECT recording_id, CASE WHEN q % 2 = 0 THEN 'apply' ELSE 'clear' END AS event_type, q // 2 AS place, 3 + greatest(4, CAST(ceil((q * 9 + recording_id % 3) / 4.0) * 4 AS BIGINT)) AS planned_index
        FROM len CROSS JOIN (SELECT unnest(range(0, 6)) AS q)) p
    LEFT JOIN (SELECT recording_id, event_type, sample_index, row_number() OVER (PARTITION BY recording_id, event_type ORDER BY event_seq) - 1 AS place FROM evt) g USING (recording_id, event_type, place)"""))
def event_residual(spark, d):
    """Six planned events per recording against the logged ones; -1000000 where the log has none."""
    q = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("q")
    plan = rec_lengths(spark, d).select("recording_id", q).select(
        "recording_id", F.when(F.col("q") % 2 == 0, "apply").otherwise("clear").alias("event_type"), (F.col("q") * 9 + F.col("recording_id") % 3).alias("offset"), F.lit(3).cast("bigint").alias("run_start"))
    r = timing_residuals(plan, evt(spark, d), KEY, 4)
    return r.select("recording_id", "event_type", "place", "planned_index", F.coalesce("residual", F.lit(-1000000)).alias("residual"))


# ---- the report ------------------------------------------------------------------------------

def checks(spark, d) -> list[qc.Check]:
    i, n = F.col("recording_id"), F.col("n_samples")
    length = rec_lengths(spark, d)
    r = recordings(spark, d)

    def counts():
        c = length.select("recording_id", "n_samples", F.lit(5).alias("n_channels"), F.lit(RATE).alias("rate"), (n * 40 + F.when(i % 3 == 0, 8).otherwise(0)).alias("bin_bytes"),
                          (n + F.when(i % 5 == 0, 1).otherwise(0)).alias("sidecar_samples"), ((n + F.when(i % 7 == 0, 2).otherwise(0)) / RATE).alias("sidecar_seconds"))
        return qc.sample_count(c)

    def metadata():
        store = length.select("recording_id", F.lit(RATE).alias("rate"), F.array(F.lit("a"), F.lit("b")).alias("channel_names"), F.lit("2024-01-01T00:00:00.25").alias("start_time"))
        side = length.where(i % 7 != 0).select(
            "recording_id", F.when(i % 11 == 0, RATE // 2).otherwise(RATE).alias("rate"), F.when(i % 13 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("channel_names"),
            F.when(i % 17 == 0, "2024-01-01T00:00:01.00").otherwise("2024-01-01T00:00:00.75").alias("start_time"))
        return qc.metadata_agreement(store, side, KEY)

    def finite():
        s = sig(spark, d, "k").select("recording_id", F.when(F.col("k") == 7, float("nan")).when(F.col("k") == 57, float("-inf")).otherwise(F.col("v")).alias("v"))
        return qc.finite(qc.channel_stats(s, KEY), KEY)

    def trials():
        t = trial_lengths(spark, d)
        x = t.groupBy("recording_id").agg((F.count(F.lit(1)) + F.max(F.when(i % 4 == 0, 1).otherwise(0))).alias("n_expected"))
        return qc.trial_table(x, t.select("recording_id", "trial_index", F.lit(5).alias("n_channels")), KEY)

    def log():
        lines_ = log_lines(spark, d).withColumn("line", F.replace(F.replace("line", F.lit(" and "), F.lit(" WARN ")), F.lit(" the "), F.lit(" ERROR ")))
        return qc.acquisition_log(lines_.join(r.select("recording_id"), "recording_id", "left_semi"), KEY)

    stats = materialise(qc.channel_stats(channel_samples(spark, d), CH), "channel-stats")  # one pass serves two checks

    def saturation():
        s = qc.saturation(stats).join(cc(spark).select("channel_index", "name"), "channel_index")
        return qc.first_offender(s, KEY, "channel_index", "name", "saturated_fraction").withColumn("message", F.col("channel"))

    def offset():
        return stats.groupBy("recording_id").agg(F.avg("mean_v").alias("mean_v")).select("recording_id", F.lit("pass").alias("status"), F.create_map(F.lit("mean_v"), "mean_v").alias("metrics"))

    def rms():
        store = dealt_store(spark, d)
        there = store.zones().where("n_good > 0").select(*CH).distinct().join(cc(spark).where(F.col("name").isin(SIGNAL_CHANNELS)).select("channel_index", "name"), "channel_index")
        return qc.baseline_rms(store.blocks, there.join(baselines(spark, d), KEY), CH, ["recording_id", "name"], BLOCK, least=3).groupBy("recording_id").agg(qc.worst("status").alias("status"))

    def noise():
        return qc.line_noise(sig_store(spark, d).blocks, KEY, 32, freqs=(8.0, 12.0), band=1.0)

    def drift():
        return qc.drift(sig(spark, d), KEY, 50).select("recording_id", F.when(F.col("slope_v_per_s").isNotNull(), "pass").otherwise("skip").alias("status"))

    def active():
        return qc.command_activity(sig_store(spark, d).blocks, paired_windows(evt(spark, d), length, KEY), length, KEY, BLOCK)

    a, s, c = SECTIONS
    return [
        qc.Check(a, "sample counts", counts), qc.Check(a, "metadata", metadata), qc.Check(a, "finite values", finite),
        qc.Check(a, "events", lambda: qc.events(evt(spark, d), length, KEY), ("continuous",)), qc.Check(a, "trials", trials, ("trial",)),
        qc.Check(a, "trigger and frames", lambda: line_frames(spark, d)), qc.Check(a, "log", log),
        qc.Check(s, "saturation", saturation), qc.Check(s, "offset", offset), qc.Check(s, "baseline noise", rms), qc.Check(s, "line noise", noise), qc.Check(s, "drift", drift),
        qc.Check(c, "trial commands", lambda: commands(spark, d), ("trial",)), qc.Check(c, "continuous commands", active, ("continuous",)),
    ]


def _row(section: int, name: str, body: str) -> str:
    return f"SELECT recording_id, '{SECTIONS[section]}' AS section, '{name}' AS name, sev FROM ({body})"


ALL = " UNION ALL ".join([
    _row(0, "sample counts", "SELECT recording_id, CASE WHEN recording_id % 3 = 0 OR recording_id % 5 = 0 OR recording_id % 7 = 0 THEN 3 ELSE 1 END AS sev FROM rm"),
    _row(0, "metadata", "SELECT recording_id, CASE WHEN recording_id % 7 = 0 THEN 0 WHEN recording_id % 11 = 0 OR recording_id % 13 = 0 OR recording_id % 17 = 0 THEN 2 ELSE 1 END AS sev FROM rm"),
    _row(0, "finite values", "SELECT recording_id, CASE WHEN count(*) FILTER (WHERE k IN (7, 57)) > 0 THEN 3 ELSE 1 END AS sev FROM sig GROUP BY 1"),
    _row(0, "events", """SELECT recording_id, max(CASE WHEN event_type IS NULL THEN 0 WHEN (event_type = 'apply' AND pt = 'apply') OR (event_type = 'clear' AND (pt IS NULL OR pt <> 'apply')) THEN 2 ELSE 1 END) AS sev
        FROM rm LEFT JOIN ev2 USING (recording_id) WHERE mode = 'continuous' GROUP BY 1"""),
    _row(0, "trials", "SELECT recording_id, CASE WHEN recording_id % 4 = 0 THEN 3 ELSE 1 END AS sev FROM rm WHERE mode = 'trial'"),
    _row(0, "trigger and frames", "SELECT rm.recording_id, coalesce(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 END, 0) AS sev FROM rm LEFT JOIN tf USING (recording_id)"),
    _row(0, "log", "SELECT rm.recording_id, CASE WHEN e > 0 THEN 3 WHEN w > 0 THEN 2 WHEN e IS NULL THEN 0 ELSE 1 END AS sev FROM rm LEFT JOIN lg2 USING (recording_id)"),
    _row(1, "saturation", "SELECT rm.recording_id, coalesce(max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END), 0) AS sev FROM rm LEFT JOIN sx USING (recording_id) GROUP BY 1"),
    _row(1, "offset", "SELECT recording_id, 1 AS sev FROM rm"),
    _row(1, "baseline noise", "SELECT rm.recording_id, max(CASE WHEN name IN ('ScAmpOut', 'RawAmpOut') AND stop >= 3 THEN 1 ELSE 0 END) AS sev FROM rm JOIN bw USING (recording_id) LEFT JOIN (SELECT DISTINCT recording_id, name FROM nm) USING (recording_id) GROUP BY 1"),
    _row(1, "line noise", "SELECT rm.recording_id, CASE WHEN line IS NULL THEN 0 WHEN line >= 0.3 THEN 3 WHEN line >= 0.1 THEN 2 ELSE 1 END AS sev FROM rm LEFT JOIN hf USING (recording_id)"),
    _row(1, "drift", "SELECT recording_id, CASE WHEN n_samples >= 50 THEN 1 ELSE 0 END AS sev FROM rm"),
    _row(2, "trial commands", "SELECT rm.recording_id, coalesce(cv.sev, 0) AS sev FROM rm LEFT JOIN cv USING (recording_id) WHERE mode = 'trial'"),
    _row(2, "continuous commands", """SELECT recording_id, CASE WHEN nw = 0 THEN 0 WHEN q > 0.25 OR a < 0.01 THEN 2 ELSE 1 END AS sev FROM (
        SELECT recording_id, coalesce(sqrt(avg(v * v) FILTER (WHERE act)), 0) AS a, coalesce(sqrt(avg(v * v) FILTER (WHERE NOT act)), 0) AS q FROM (
          SELECT s.recording_id, v, EXISTS (SELECT 1 FROM pw WHERE pw.recording_id = s.recording_id AND s.sample_index >= pw.start AND s.sample_index < pw.stop) AS act FROM sig s) GROUP BY 1)
        JOIN (SELECT l.recording_id, count(pw.start) AS nw FROM len l LEFT JOIN pw USING (recording_id) GROUP BY 1) USING (recording_id) JOIN rm USING (recording_id) WHERE mode = 'continuous'"""),
])

REPORT = {
    **LINE_SQL, **PAIRED, **SAT, **LINE, **NAMES, **{k: v for k, v in BASE.items() if k == "bw"},
    "ev2": "SELECT *, lag(event_type) OVER (PARTITION BY recording_id, stimulus_index ORDER BY event_seq) AS pt FROM evt",
    "lg2": """SELECT recording_id, count(*) FILTER (WHERE contains(line, 'WARN')) AS w, count(*) FILTER (WHERE contains(line, 'ERROR')) AS e FROM (
        SELECT doc_id AS recording_id, replace(replace(unnest(string_split(text, chr(10))), ' and ', ' WARN '), ' the ', ' ERROR ') AS line FROM documents) WHERE trim(line, ' ') <> '' GROUP BY 1""",
    "al": ALL,
}


@query("qc_full_report", sql("sig evt len stim bs", """SELECT recording_id, mode, ['skip', 'pass', 'warn', 'fail'][max(sev) + 1] AS status, count(DISTINCT section) AS n_sections, count(*) AS n_checks,
    string_agg(section || '/' || name || ':' || ['skip', 'pass', 'warn', 'fail'][sev + 1], ';' ORDER BY section, name) AS checks FROM al JOIN rm USING (recording_id) GROUP BY 1, 2""", **REPORT))
def qc_full_report(spark, d):
    """All checks of all recordings in three sections, by mode, written as JSON and read back."""
    r = recordings(spark, d).select("recording_id", "mode")
    rows = materialise(qc.dispatch(checks(spark, d), r, KEY), "check-rows")
    rep = qc.report(rows, r, KEY)
    path = scratch_path(spark, "qc-full-report")
    rep.write.json(path)
    back = spark.read.schema(rep.schema).json(path)
    n = F.aggregate("sections", F.lit(0).cast("bigint"), lambda a, s: a + F.size(s["checks"]))
    listed = F.flatten(F.transform("sections", lambda s: F.transform(s["checks"], lambda c: F.concat(s["section"], F.lit("/"), c["name"], F.lit(":"), c["status"]))))
    return back.select("recording_id", "mode", "status", F.size("sections").cast("bigint").alias("n_sections"), n.alias("n_checks"), F.array_join(F.sort_array(listed), ";").alias("checks"))
