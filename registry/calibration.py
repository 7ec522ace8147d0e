"""Calibration statistics."""

from pyspark.sql import functions as F

from clampspark.operators import align, calibration as C, kernels
from clampspark.plans import qc
from . import query
from .quality import LINE
from .sequences import ADAPTIVE
from .views import KEY, RATE, blk, sig_blocks, sig_store, sql, sweep_store, table

TR = ["recording_id", "trial_index"]


@query("xcorr_lag", sql("bs", """SELECT recording_id, trial_index, arg_max(lag_, c) AS lag_samples FROM xc GROUP BY 1, 2""",
    m="SELECT recording_id, trial_index, avg(v) AS me, avg(CASE WHEN sample_index % 7 < 3 THEN v * 2 ELSE v + 0.1 END) AS mr FROM bs GROUP BY 1, 2",
    z="SELECT recording_id, trial_index, sample_index, v - me AS e, CASE WHEN sample_index % 7 < 3 THEN v * 2 ELSE v + 0.1 END - mr AS r FROM bs JOIN m USING (recording_id, trial_index)",
    xc="SELECT a.recording_id, a.trial_index, a.sample_index - b.sample_index AS lag_, abs(sum(a.r * b.e)) AS c FROM z a JOIN z b USING (recording_id, trial_index) GROUP BY 1, 2, 3"))
def xcorr_lag(spark, d):
    b = blk(spark, d)
    rec = F.transform("samples", lambda x, i: F.when(i % 7 < 3, x * 2).otherwise(x + 0.1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    b = b.withColumn("rec", rec)
    lag = kernels.xcorr_lag(F.col("samples"), F.col("rec"), mean("samples"), mean("rec"), F.lit(False))
    return b.select("recording_id", "trial_index", lag.alias("lag_samples"))


@query("loopback_latency", sql("bs", """SELECT recording_id, trial_index, lag_ / 1000.0::DOUBLE * 1000 AS lag_ms, CASE WHEN abs(lag_) > 2 THEN 'fail' WHEN abs(lag_) > 0.5 THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT recording_id, trial_index, arg_max(lag_, c) AS lag_ FROM xc GROUP BY 1, 2)""",
    m="SELECT recording_id, trial_index, avg(v) AS mr, avg(CASE WHEN sample_index // 10 % 2 = 0 THEN 0.5 ELSE -0.5 END) AS me FROM bs GROUP BY 1, 2",
    z="SELECT recording_id, trial_index, sample_index, v - mr AS r, CASE WHEN sample_index // 10 % 2 = 0 THEN 0.5 ELSE -0.5 END - me AS e FROM bs JOIN m USING (recording_id, trial_index)",
    xc="SELECT a.recording_id, a.trial_index, a.sample_index - b.sample_index AS lag_, abs(sum(a.r * b.e)) AS c FROM z a JOIN z b USING (recording_id, trial_index) GROUP BY 1, 2, 3"))
def loopback_latency(spark, d):
    """Square-wave command against the recorded sweep."""
    square = F.transform("samples", lambda x, i: F.when(F.floor(i / 10) % 2 == 0, 0.5).otherwise(-0.5))
    b = blk(spark, d).select("recording_id", "trial_index", square.alias("exp"), F.col("samples").alias("rec"))
    return C.loopback_latency(b, TR, RATE).select("recording_id", "trial_index", "lag_ms", "status")


@query("ttl_stability", sql("sig", """SELECT r.recording_id, coalesce(ne, 0) AS n_edges, round(1 / mp, 6) AS observed_rate_hz, round(sp / mp, 6) AS jitter_frac,
    CASE WHEN hi - lo < 200 OR coalesce(ne, 0) < 3 THEN 'fail' WHEN abs(1 / mp - 200) / 200 > 0.005 OR sp / mp > 1e-3 THEN 'warn' ELSE 'pass' END AS status
    FROM r LEFT JOIN (SELECT recording_id, count(*) AS ne, avg(per) AS mp, stddev_pop(per) AS sp FROM (
        SELECT recording_id, (sample_index - lag(sample_index) OVER (PARTITION BY recording_id ORDER BY sample_index)) / 1000.0::DOUBLE AS per FROM h WHERE h AND NOT p) GROUP BY 1) USING (recording_id)""", **ADAPTIVE))
def ttl_stability(spark, d):
    s = sig_store(spark, d)
    r = C.period_stability(align.adaptive_edges(s, 200.0), align.thresholds(s, 200.0), KEY, RATE, 200.0)
    return r.select("recording_id", "n_edges", F.round("observed_rate_hz", 6).alias("observed_rate_hz"), F.round("jitter_frac", 6).alias("jitter_frac"), "status")


@query("narrowband_rms", sql("sig len", """SELECT recording_id, round(dr, 6) AS drive_rms, round(bg, 6) AS background_rms, round(cp, 6) AS coupled_rms, CASE WHEN cp > 0.05 THEN 'fail' WHEN cp > 0.01 THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT *, sqrt(greatest(0, dr * dr - bg * bg)) AS cp FROM (SELECT recording_id, sqrt(2) * sqrt(c1 * c1 + s1 * s1) / sw AS dr, sqrt(2) * sqrt(c2 * c2 + s2 * s2) / sw AS bg FROM (
      SELECT recording_id, sum(w) AS sw, sum(v * w * cos(2 * pi() * 137 * i / 1000)) AS c1, sum(v * w * sin(2 * pi() * 137 * i / 1000)) AS s1, sum(v * w * cos(2 * pi() * 147 * i / 1000)) AS c2, sum(v * w * sin(2 * pi() * 147 * i / 1000)) AS s2
      FROM (SELECT recording_id, v, sample_index AS i, 0.5 - 0.5 * cos(2 * pi() * sample_index / (n_samples - 1)) AS w FROM sig JOIN len USING (recording_id)) GROUP BY 1)))"""))
def narrowband_rms(spark, d):
    r = C.crosstalk(sig_store(spark, d), 137.0, 147.0, RATE)
    return r.select("recording_id", *[F.round(c, 6).alias(c) for c in ("drive_rms", "background_rms", "coupled_rms")], "status")


@query("resting_baseline", """SELECT user_id AS recording_id, round(median(value) * 0.1, 6) AS resting, CASE WHEN abs(median(value) * 0.1) > 4 THEN 'warn' ELSE 'pass' END AS status FROM events GROUP BY 1""")
def resting_baseline(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("value").alias("v"))
    return C.resting_baseline(s, KEY, 0.1, 4.0).withColumn("resting", F.round("resting", 6))


@query("noise_floor", sql("sig", """SELECT recording_id, round(rms, 6) AS rms_display, round(coalesce(line, 0), 6) AS line_fraction, CASE WHEN line > 0.3 THEN 'fail' WHEN line > 0.1 THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT recording_id, stddev_pop(v) * 0.1 AS rms FROM sig GROUP BY 1) LEFT JOIN hf USING (recording_id)""", **LINE))
def noise_floor(spark, d):
    """RMS and line share at a rate of 32."""
    r = qc.noise_floor(sig_blocks(spark, d), KEY, 32, 0.1, freqs=(8.0, 12.0), band=1.0)
    return r.select("recording_id", F.round("rms_display", 6).alias("rms_display"), F.round("line_fraction", 6).alias("line_fraction"), "status")


AMPS = [-30.0, -20.0, -10.0, 10.0]
STEP_CTE = dict(
    sw="SELECT recording_id, trial_index, sample_index AS i, v, sample_index // 16 AS s FROM bs",
    bl="SELECT recording_id, trial_index, (i + 4) // 16 AS s, median(v) AS base FROM sw WHERE i >= 12 AND (i + 4) % 16 < 4 AND i < 60 GROUP BY 1, 2, 3",
    pt="SELECT recording_id, trial_index, s, median(v) AS plat FROM sw WHERE i % 16 >= 4 AND i % 16 < 8 GROUP BY 1, 2, 3",
    stp="SELECT recording_id, trial_index, s, [-30.0, -20.0, -10.0, 10.0][s + 1]::DOUBLE AS amp, base, plat, plat - base AS delta FROM bl JOIN pt USING (recording_id, trial_index, s)",
)


def steps(spark, d):
    """Sweeps of four steps, 8 samples wide and 8 apart, with a 4-sample baseline."""
    b = blk(spark, d).withColumn("steps", F.array(*[F.lit(a) for a in AMPS]))
    return C.step_medians(b, TR, 8, 8, 4)


@query("cc_linearity", sql("bs", """SELECT recording_id, trial_index, n_steps, round(sl, 6) AS slope_mohm, round(ic, 6) AS intercept_mv, round(r2, 6) AS r_squared, round(wd, 6) AS worst_deviation,
    CASE WHEN n_steps < 2 THEN 'fail' WHEN abs(sl - 500) / 500 > 0.05 OR r2 < 0.999 OR wd > 0.05 THEN 'warn' ELSE 'pass' END AS status FROM (
    SELECT recording_id, trial_index, count(*) AS n_steps, regr_slope(delta, amp) * 1000 AS sl, regr_intercept(delta, amp) AS ic, regr_r2(delta, amp) AS r2, max(abs(delta / amp * 1000 - 500) / 500) AS wd FROM stp GROUP BY 1, 2)""", **STEP_CTE))
def cc_linearity(spark, d):
    r = C.current_linearity(steps(spark, d), TR, 500.0)
    return r.select(*TR, "n_steps", F.round("slope_MOhm", 6).alias("slope_mohm"), F.round("intercept_mV", 6).alias("intercept_mv"),
                    F.round("r_squared", 6).alias("r_squared"), F.round("worst_deviation", 6).alias("worst_deviation"), "status")


@query("vc_scaling", sql("bs", """SELECT recording_id, trial_index, n_steps, round(sl, 9) AS slope, round(1000 / sl, 3) AS implied_r, round(wd, 6) AS worst_deviation, CASE WHEN wd > 0.05 THEN 'warn' ELSE 'pass' END AS status FROM (
    SELECT recording_id, trial_index, count(*) AS n_steps, regr_slope(delta, amp) AS sl, max(abs(CASE WHEN delta <> 0 THEN amp / delta * 1000 END - 500) / 500) AS wd FROM stp GROUP BY 1, 2)""", **STEP_CTE))
def vc_scaling(spark, d):
    r = C.voltage_scaling(steps(spark, d), TR, 500.0)
    return r.select(*TR, "n_steps", F.round("slope", 9).alias("slope"), F.round("implied_R_from_slope", 3).alias("implied_r"),
                    F.round("worst_deviation", 6).alias("worst_deviation"), "status")


# The best tau is where the pull of its normal equation changes sign: 60 bisections of its logarithm.
TAU = dict(
    y="SELECT recording_id, trial_index, list_reverse_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS y FROM blk",
    r="""SELECT recording_id, trial_index, y, 0 AS k, ln(0.01::DOUBLE) AS lo, ln(100000.0::DOUBLE) AS hi FROM y
        UNION ALL SELECT recording_id, trial_index, y, k + 1, CASE WHEN pull > 0 THEN mid ELSE lo END, CASE WHEN pull > 0 THEN hi ELSE mid END FROM (
            SELECT *, d * list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - (sy - d * se) / len(y) - d * e[i]) * e[i] * (i - 1))) AS pull FROM (
                SELECT *, (len(y) * sye - se * sy) / (len(y) * see - se * se) AS d FROM (
                    SELECT *, list_sum(e) AS se, list_sum(list_transform(e, lambda x: x * x)) AS see, list_sum(y) AS sy, list_dot_product(e, y) AS sye FROM (
                        SELECT *, (lo + hi) / 2 AS mid, list_transform(range(0, len(y)), lambda i: exp(-i / exp((lo + hi) / 2))) AS e FROM r WHERE k < 60))))""",
    f="""SELECT recording_id, trial_index, y, exp((lo + hi) / 2) AS tau, list_transform(range(0, len(y)), lambda i: exp(-i / exp((lo + hi) / 2))) AS e FROM r WHERE k = 60""",
    g="SELECT *, (len(y) * list_dot_product(e, y) - list_sum(e) * list_sum(y)) / (len(y) * list_dot_product(e, e) - list_sum(e) * list_sum(e)) AS d FROM f",
    h="SELECT *, (list_sum(y) - d * list_sum(e)) / len(y) AS c FROM g",
)


@query("tau_fit", sql("blk", """SELECT recording_id, trial_index, round(tau, 4) AS tau_ms, round(c, 6) AS i_ss, round(d, 6) AS d_i,
    round(sqrt(list_sum(list_transform(range(1, len(y) + 1), lambda i: pow(y[i] - c - d * e[i], 2))) / len(y)), 6) AS rmse, true AS at_rest, 'pass' AS status FROM h""", **TAU).replace("WITH blk", "WITH RECURSIVE blk", 1))
def tau_fit(spark, d):
    """Decay of each recorded vector's magnitudes in falling order, one sample per millisecond."""
    r = C.capacitance_fits(sweep_store(spark, d), RATE)
    return r.select(*TR, F.round("tau_ms", 4).alias("tau_ms"), F.round("i_ss", 6).alias("i_ss"), F.round("d_i", 6).alias("d_i"), F.round("rmse", 6).alias("rmse"), (F.col("gradient") < 1e-7).alias("at_rest"), "status")


HIST = dict(
    o="SELECT s_suppkey AS run_id, s_acctbal AS old_metric FROM supplier WHERE s_suppkey % 2 = 0",
    n="""SELECT s_suppkey AS run_id, CASE WHEN s_acctbal < 0 THEN 'fail' WHEN s_acctbal < 2000 THEN 'warn' ELSE 'pass' END AS a_status, s_acctbal / 10 AS lag_ms,
        CASE WHEN s_nationkey % 5 = 0 THEN 'warn' ELSE 'pass' END AS b_status, s_nationkey::DOUBLE AS tau_ms FROM supplier WHERE s_suppkey % 2 = 1""",
)


@query("history_append", sql("", """SELECT run_id, NULL::VARCHAR AS overall_status, NULL::VARCHAR AS "AO_loopback_latency__status", NULL::DOUBLE AS "AO_loopback_latency__lag_ms", NULL::VARCHAR AS "Capacitance_tau_VC_step__status",
      NULL::DOUBLE AS "Capacitance_tau_VC_step__tau_ms", old_metric FROM o
    UNION ALL SELECT run_id, CASE WHEN a_status = 'fail' THEN 'fail' WHEN a_status = 'warn' OR b_status = 'warn' THEN 'warn' ELSE 'pass' END, a_status, round(lag_ms, 6), b_status, tau_ms, NULL FROM n""", **HIST))
def history_append(spark, d):
    from clampspark.functions.scalar import history_key
    s = table(spark, d, "supplier")
    i, bal = F.col("s_suppkey"), F.col("s_acctbal")
    old = s.where(i % 2 == 0).select(i.alias("run_id"), bal.alias("old_metric"))
    a = s.where(i % 2 == 1).select(
        i.alias("run_id"), F.lit("AO loopback latency").alias("name"), F.when(bal < 0, "fail").when(bal < 2000, "warn").otherwise("pass").alias("status"),
        F.create_map(F.lit("lag_ms"), F.round(bal / 10, 6)).alias("metrics"))
    b = s.where(i % 2 == 1).select(
        i.alias("run_id"), F.lit("Capacitance tau (VC step)").alias("name"), F.when(F.col("s_nationkey") % 5 == 0, "warn").otherwise("pass").alias("status"),
        F.create_map(F.lit("tau_ms"), F.col("s_nationkey").cast("double")).alias("metrics"))
    checks = a.unionByName(b).withColumn("check_key", history_key("name"))
    wide = C.history_rows(checks, ["run_id"], ["AO_loopback_latency", "Capacitance_tau_VC_step"], ["lag_ms", "tau_ms"])
    return C.append_history(old, wide.drop("AO_loopback_latency__tau_ms", "Capacitance_tau_VC_step__lag_ms"))
