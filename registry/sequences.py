"""Edges, runs, running medians, decimation: operators on the order of samples."""

from pyspark.sql import functions as F

from clampspark.operators import align, blocks as B, decimate, pulses as P
from clampspark.session import materialise
from . import query
from .views import BLOCK, CH, HALO, KEY, sig, sig_blocks, sig_store, sql

EDGE = """SELECT *, lag(v >= 60, 1, false) OVER (PARTITION BY recording_id ORDER BY sample_index) AS prev FROM sig"""
ISLANDS = """SELECT recording_id, sample_index, v, sample_index - row_number() OVER (PARTITION BY recording_id ORDER BY sample_index) AS g
    FROM sig WHERE abs(v) >= 60"""
PULSES = """SELECT recording_id, min(sample_index) AS onset, max(sample_index) + 1 AS stop, median(v) AS amplitude
    FROM isl GROUP BY recording_id, g HAVING count(*) >= 2"""


@query("edges_fixed", sql("sig", "SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY sample_index) - 1 AS BIGINT) AS frame_no, sample_index FROM e WHERE v >= 60 AND NOT prev", e=EDGE))
def edges_fixed(spark, d):
    return align.frame_samples(sig_blocks(spark, d), KEY, 60.0).select("recording_id", "frame_no", "sample_index")


ADAPTIVE = dict(
    r="SELECT recording_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM sig GROUP BY 1",
    h="""SELECT s.recording_id, sample_index, v > 0.5 * (lo + hi) AS h, lag(v > 0.5 * (lo + hi)) OVER (PARTITION BY s.recording_id ORDER BY sample_index) AS p
        FROM sig s JOIN r USING (recording_id) WHERE hi - lo >= 200 AND n >= 2""",
)


@query("edges_adaptive", sql("sig", """SELECT r.recording_id, coalesce(count(*) FILTER (WHERE h AND NOT p), 0) AS n_edges,
    CASE WHEN n >= 2 AND hi - lo >= 200 THEN round(0.5 * (lo + hi), 6) END AS threshold
    FROM r LEFT JOIN h USING (recording_id) GROUP BY r.recording_id, n, lo, hi""", **ADAPTIVE))
def edges_adaptive(spark, d):
    return align.adaptive_edge_counts(sig_store(spark, d), 200.0).withColumn("threshold", F.round("threshold", 6))


@query("pulse_detect", sql("sig", "SELECT recording_id, onset, stop, round(amplitude, 6) AS amplitude FROM p", isl=ISLANDS, p=PULSES))
def pulse_detect(spark, d):
    p = P.find_pulses(sig_blocks(spark, d), KEY, 2, 60.0, BLOCK)
    return p.select("recording_id", "onset", F.col("offset").alias("stop"), F.round("amplitude", 6).alias("amplitude"))


STAIRS = dict(
    isl=ISLANDS, p=PULSES,
    f="SELECT *, CASE WHEN onset - lag(stop) OVER (PARTITION BY recording_id ORDER BY onset) > 5 THEN 1 ELSE 0 END AS fresh FROM p",
    st="SELECT *, CAST(sum(fresh) OVER (PARTITION BY recording_id ORDER BY onset) AS BIGINT) AS staircase_index FROM f",
)


@query("staircase_group", sql("sig", """SELECT recording_id, staircase_index, count(*) AS found_steps, min(onset) AS apply_sample, max(stop) AS clear_sample
    FROM st GROUP BY 1, 2""", **STAIRS))
def staircase_group(spark, d):
    p = P.command_runs(sig_blocks(spark, d), KEY, 60.0).where(F.col("offset") - F.col("onset") >= 2)
    s = P.staircases(materialise(P.start_by_gap(p, KEY, 5), "staircase-pulses"), KEY)
    return s.select("recording_id", "staircase_index", "found_steps", "apply_sample", "clear_sample")


@query("hyperpol_split", sql("pulse", """SELECT recording_id, pulse_seq, amplitude, pulse_seq = 0 AND amplitude < 0 AND
    (recording_id % 2 = 0 OR count(*) OVER (PARTITION BY recording_id) > 1) AS is_leading FROM pulse"""))
def hyperpol_split(spark, d):
    from .views import pulse
    p = pulse(spark, d)
    return P.split_leading_pulse(p, KEY, F.col("recording_id") % 2 == 0).select("recording_id", "pulse_seq", "amplitude", "is_leading")


@query("running_median", sql("sig len", """SELECT recording_id, sample_index, round(m, 6) AS v FROM
    (SELECT recording_id, i AS sample_index, n_samples, median(v) OVER (PARTITION BY recording_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM x)
    WHERE sample_index BETWEEN 0 AND n_samples - 1""",
    x="""SELECT recording_id, sample_index AS i, v, n_samples FROM sig JOIN len USING (recording_id)
        UNION ALL SELECT recording_id, -1 - sample_index, v, n_samples FROM sig JOIN len USING (recording_id) WHERE sample_index < 10
        UNION ALL SELECT recording_id, 2 * n_samples - 1 - sample_index, v, n_samples FROM sig JOIN len USING (recording_id) WHERE sample_index >= n_samples - 10"""))
def running_median(spark, d):
    s = B.running_median(sig_blocks(spark, d), 21, HALO)
    return B.unpack(s, KEY).withColumn("v", F.round("v", 6))


@query("minmax_decimate", sql("sig len", """SELECT recording_id, sample_index, v FROM (
    SELECT recording_id, sample_index, v FROM sig JOIN len USING (recording_id) WHERE n_samples <= 60
    UNION ALL SELECT recording_id, lo_i, lo FROM g UNION ALL SELECT recording_id, hi_i, hi FROM g)""",
    b="SELECT s.*, least(sample_index // (n_samples // 30), 29) AS bin FROM sig s JOIN len USING (recording_id) WHERE n_samples > 60",
    g="""SELECT recording_id, bin, min(v) AS lo, max(v) AS hi, arg_min(sample_index, (v, sample_index)) AS lo_i, arg_min(sample_index, (-v, sample_index)) AS hi_i
        FROM b GROUP BY 1, 2"""))
def minmax_decimate(spark, d):
    return decimate.minmax_decimate(sig_store(spark, d), 60)


@query("minmax_envelope", sql("sig len", """SELECT l.recording_id, c AS column_no, min(v) AS col_min, max(v) AS col_max FROM len l
    CROSS JOIN (SELECT CAST(unnest(range(0, 40)) AS BIGINT) AS c) LEFT JOIN sig s ON s.recording_id = l.recording_id
    AND sample_index >= floor(c * (n_samples / 40)) AND sample_index < CASE WHEN c = 39 THEN n_samples ELSE least(ceil((c + 1) * (n_samples / 40)), n_samples) END
    GROUP BY 1, 2"""))
def minmax_envelope(spark, d):
    return decimate.minmax_envelope(sig_store(spark, d), 40)


@query("stride_decimate", sql("sig", "SELECT recording_id, sample_index, v FROM sig WHERE sample_index % 4 = 0"))
def stride_decimate(spark, d):
    return decimate.stride(sig(spark, d), 4)


@query("range_pad", sql("", """SELECT user_id AS recording_id, round(min(value) - (max(value) - min(value)) * 0.08, 6) AS y_lo,
    round(max(value) + (max(value) - min(value)) * 0.08, 6) AS y_hi FROM events GROUP BY 1"""))
def range_pad(spark, d):
    from .views import table
    s = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("value").alias("v"))
    r = decimate.padded_range(s, KEY)
    return r.select("recording_id", F.round("y_lo", 6).alias("y_lo"), F.round("y_hi", 6).alias("y_hi"))
