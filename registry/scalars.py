"""Scalar expressions over whole tables."""

from pyspark.sql import functions as F

from clampspark import config
from clampspark.functions import scalar as X
from . import query
from .views import rec, sig, sql, stim, table

CHANNEL_VALUES = ", ".join(
    f"('{m}', {i}, '{n}', '{a}', '{t}', {s}::DOUBLE, '{u}')" for m, i, n, a, t, s, u in config.CHANNELS)
CHANNELS_SQL = f"SELECT * FROM (VALUES {CHANNEL_VALUES}) AS t(clamp_mode, channel_index, name, ni_channel, terminal_config, display_scale, units)"


def channels(spark):
    """The fixed channel definitions: ten rows, so always safe to broadcast."""
    return F.broadcast(spark.createDataFrame(config.CHANNELS, config.CHANNEL_SCHEMA))


@query("scale_display", sql("sig", """SELECT recording_id, sample_index, name, round(v * display_scale, 6) AS v_display, units FROM sig
    JOIN ch ON ch.channel_index = sig.k % 5 AND ch.clamp_mode = 'current_clamp'""", ch=CHANNELS_SQL))
def scale_display(spark, d):
    ch = channels(spark).where("clamp_mode = 'current_clamp'")
    s = sig(spark, d, "k").withColumn("channel_index", F.col("k") % 5).join(ch, "channel_index")
    return s.select("recording_id", "sample_index", "name", F.round(X.to_display("v", "display_scale"), 6).alias("v_display"), "units")


@query("clamp_relabel", sql("rec", """SELECT recording_id, rec.clamp_mode, ch.channel_index, ch.name, ch.units, round(acctbal / 1000 * display_scale, 6) AS v_display
    FROM rec JOIN ch ON ch.clamp_mode = rec.clamp_mode""", ch=CHANNELS_SQL))
def clamp_relabel(spark, d):
    j = rec(spark, d).join(channels(spark), "clamp_mode")
    return j.select("recording_id", "clamp_mode", "channel_index", "name", "units",
                    F.round(X.to_display(F.col("acctbal") / 1000, "display_scale"), 6).alias("v_display"))


@query("ms_to_samples", sql("", """SELECT o_orderkey AS recording_id, greatest(0, CAST(trunc((o_totalprice - 100000) / 1000.0 * 20000) AS BIGINT)) AS n FROM orders"""))
def ms_to_samples(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("recording_id"), X.ms_to_samples(F.col("o_totalprice") - 100000).alias("n"))


@query("cmd_to_volts", sql("stim", """SELECT stimulus_index, clamp_mode, round(CASE WHEN clamp_mode = 'voltage_clamp' THEN step_mv / mv_per_volt ELSE max_pa / 400.0 END, 9) AS volts FROM stim"""))
def cmd_to_volts(spark, d):
    amp = F.when(F.col("clamp_mode") == "voltage_clamp", F.col("step_mV")).otherwise(F.col("max_pA"))
    return stim(spark, d).select("stimulus_index", "clamp_mode", F.round(X.command_to_volts(amp, "clamp_mode", "mv_per_volt"), 9).alias("volts"))


@query("actual_frame_rate", sql("", """SELECT p_partkey, 20000 / greatest(1, CAST(trunc(20000 / (p_retailprice / 10)) AS BIGINT)) AS rate FROM part"""))
def actual_frame_rate(spark, d):
    return table(spark, d, "part").select("p_partkey", X.achievable_rate(F.col("p_retailprice") / 10).alias("rate"))


STEP_SQL = "SELECT stimulus_index, step_pa, unnest(list_transform(range(0, CAST(floor((max_pa - min_pa + 1e-9) / step_pa) AS BIGINT) + 1), lambda x: round(min_pa + x * step_pa, 6))) AS amplitude FROM stim"


@query("step_amplitudes", sql("stim", "SELECT stimulus_index, amplitude FROM a", a=STEP_SQL))
def step_amplitudes(spark, d):
    return stim(spark, d).select("stimulus_index", F.explode(X.step_amplitudes("min_pA", "max_pA", "step_pA")).alias("amplitude"))


@query("expected_steps", sql("stim", """SELECT s.stimulus_index, CASE WHEN type = 'staircase' THEN
    CAST(coalesce((SELECT count(*) FROM a WHERE a.stimulus_index = s.stimulus_index AND abs(amplitude) >= 10), 0)
      * CASE WHEN staircase_repeats = 0 THEN 1 ELSE staircase_repeats END AS DOUBLE) END AS expected FROM stim s""", a=STEP_SQL))
def expected_steps(spark, d):
    return stim(spark, d).select("stimulus_index", X.expected_pulses("type", "min_pA", "max_pA", "step_pA", "staircase_repeats").cast("double").alias("expected"))


DURATION = """SELECT protocol, stimulus_index, pre_ms, post_ms, iti_ms, CASE type WHEN 'staircase' THEN
    coalesce(pulse_ms + gap_ms, 0) + greatest(1, round_even((max_pa - min_pa) / step_pa, 0) + 1) * (step_width_ms + gap_ms)
      * CASE WHEN staircase_repeats = 0 THEN 1 ELSE staircase_repeats END WHEN 'voltage_step' THEN duration_ms ELSE 0 END::DOUBLE AS ms FROM stim"""


def duration():
    return X.stimulus_ms("type", "min_pA", "max_pA", "step_pA", "step_width_ms", "gap_ms", "staircase_repeats", "duration_ms", "pulse_ms")


@query("stim_duration", sql("stim", "SELECT stimulus_index, round(ms, 6) AS ms FROM dur", dur=DURATION))
def stim_duration(spark, d):
    return stim(spark, d).select("stimulus_index", F.round(duration(), 6).alias("ms"))


@query("protocol_duration", sql("stim", """SELECT protocol, round(count(*) * 3 * (avg(pre_ms + ms + post_ms) + max(iti_ms)) / 1000.0, 6) AS seconds
    FROM dur GROUP BY protocol""", dur=DURATION))
def protocol_duration(spark, d):
    from clampspark.operators.protocols import run_seconds
    s = stim(spark, d).withColumn("stim_ms", duration()).withColumn("repeats_per_stimulus", F.lit(3))
    return run_seconds(s, ["protocol"]).withColumn("seconds", F.round("seconds", 6))


@query("subject_normalise", sql("rec", """SELECT recording_id, CASE WHEN trim(expt_id) = '' THEN 'expt_xx' ELSE trim(expt_id) END AS expt_id, genotype,
    CASE WHEN drug_applied THEN trim(owner) ELSE '' END AS drug_name, CASE WHEN drug_applied THEN cell_type ELSE '' END AS drug_concentration,
    CASE WHEN has_video THEN 'true' ELSE '' END AS flag FROM rec"""))
def subject_normalise(spark, d):
    expt = F.trim("expt_id")
    return rec(spark, d).select(
        "recording_id", F.when(expt == "", "expt_xx").otherwise(expt).alias("expt_id"), X.blank_if_falsy("genotype").alias("genotype"),
        X.when_drug("drug_applied", "owner").alias("drug_name"), X.when_drug("drug_applied", "cell_type").alias("drug_concentration"),
        X.blank_if_falsy("has_video").alias("flag"))


@query("missing_metadata", sql("rec", """SELECT recording_id, concat_ws(',', CASE WHEN g = '' THEN 'Genotype' END, CASE WHEN a = '' THEN 'Age' END) AS missing FROM
    (SELECT recording_id, CASE WHEN drug_applied THEN ' ' ELSE genotype END AS g, CASE WHEN has_video THEN '' ELSE owner END AS a FROM rec) t
    WHERE trim(g) = '' OR trim(a) = '' """.replace("CASE WHEN g = ''", "CASE WHEN trim(g) = ''")))
def missing_metadata(spark, d):
    r = rec(spark, d).select("recording_id", "expt_id", "cell_type",
                             F.when(F.col("drug_applied"), " ").otherwise(F.col("genotype")).alias("genotype"),
                             F.when(F.col("has_video"), "").otherwise(F.col("owner")).alias("age"))
    m = X.missing_fields({"Experiment ID": "expt_id", "Genotype": "genotype", "Age": "age", "Target cell type": "cell_type"})
    return r.select("recording_id", m.alias("m")).where("size(m) > 0").select("recording_id", F.array_join("m", ",").alias("missing"))


@query("percentile_stretch", sql("", """SELECT recording_id, round(least(5, greatest(0.1, a)), 6) AS alpha, round(least(255, greatest(-255, -a * lo)), 6) AS beta FROM (
    SELECT recording_id, lo, 255.0 / (hi - lo) AS a FROM (SELECT user_id AS recording_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
    FROM events GROUP BY 1) WHERE hi - lo >= 1)"""))
def percentile_stretch(spark, d):
    from clampspark.operators.quantiles import exact_quantiles
    e = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), "value")
    q = exact_quantiles(e, ["recording_id"], "value", {"lo": 0.01, "hi": 0.99}).where("hi - lo >= 1")
    a = F.lit(255.0) / (F.col("hi") - F.col("lo"))
    clip = lambda x, lo, hi: F.round(F.least(F.lit(hi), F.greatest(F.lit(lo), x)), 6)
    return q.select("recording_id", clip(a, 0.1, 5.0).alias("alpha"), clip(-a * F.col("lo"), -255.0, 255.0).alias("beta"))
