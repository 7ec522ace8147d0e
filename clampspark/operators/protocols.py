"""Protocol decoding and whole-protocol figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_STIM = [
    ("type", T.StringType(), "staircase"), ("name", T.StringType(), "Unnamed stimulus"),
    ("min_pA", T.DoubleType(), -50.0), ("max_pA", T.DoubleType(), 50.0), ("step_pA", T.DoubleType(), 10.0),
    ("step_width_ms", T.DoubleType(), 500.0), ("gap_ms", T.DoubleType(), 500.0),
    ("staircase_repeats", T.IntegerType(), 1), ("step_mV", T.DoubleType(), -40.0), ("duration_ms", T.DoubleType(), 500.0),
]
_PROTO = [
    ("name", T.StringType(), "Unnamed protocol"), ("clamp_mode", T.StringType(), "current_clamp"),
    ("pre_ms", T.DoubleType(), 1000.0), ("post_ms", T.DoubleType(), 1000.0), ("iti_ms", T.DoubleType(), 2000.0),
    ("repeats_per_stimulus", T.IntegerType(), 5), ("ao_mv_per_volt", T.DoubleType(), 20.0),
]
_PULSE = [("amplitude_pA", T.DoubleType(), -50.0), ("duration_ms", T.DoubleType(), 100.0)]

STIMULUS_TYPE = T.StructType([T.StructField(n, t) for n, t, _ in _STIM])
PULSE_TYPE = T.StructType([T.StructField(n, t) for n, t, _ in _PULSE])
PROTOCOL_TYPE = T.StructType(
    [T.StructField(n, t) for n, t, _ in _PROTO]
    + [T.StructField("hyperpolarization", PULSE_TYPE), T.StructField("stimuli", T.ArrayType(STIMULUS_TYPE))]
)


def _with_defaults(x: Column, fields) -> list[Column]:
    return [F.coalesce(x.getField(n), F.lit(v).cast(t)).alias(n) for n, t, v in fields]


def decode(json: Column) -> Column:
    """Protocol JSON as a struct with the class defaults filled in; null where it is no JSON.

    A protocol without a ``hyperpolarization`` object has none. Absent numeric fields take their
    defaults; the version tag is not kept.
    """
    p = F.from_json(json, PROTOCOL_TYPE)
    pulse = p.getField("hyperpolarization")
    stimuli = F.transform(F.coalesce(p.getField("stimuli"), F.array().cast(T.ArrayType(STIMULUS_TYPE))),
                          lambda s: F.struct(*_with_defaults(s, _STIM)))
    full = F.struct(
        *_with_defaults(p, _PROTO),
        F.when(pulse.isNotNull(), F.struct(*_with_defaults(pulse, _PULSE))).alias("hyperpolarization"),
        stimuli.alias("stimuli"),
    )
    return F.when(p.isNotNull() & F.get_json_object(json, "$").isNotNull(), full)


def unknown_keys(json: Column) -> Column:
    """Top-level keys no protocol field carries; a strict reader rejects rows that have any."""
    known = [n for n, _, _ in _PROTO] + ["hyperpolarization", "stimuli", "version"]
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in known]))


def run_seconds(stimuli: DataFrame, keys: list[str]) -> DataFrame:
    """Planned run time of each protocol from its stimuli: ``pre_ms, stim_ms, post_ms, iti_ms,
    repeats_per_stimulus``. Trials take the mean stimulus length."""
    trial = F.col("pre_ms") + F.col("stim_ms") + F.col("post_ms")
    g = stimuli.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(trial).alias("_avg"), F.max("iti_ms").alias("_iti"),
        F.max("repeats_per_stimulus").alias("_rep"))
    return g.select(*keys, (F.col("_n") * F.col("_rep") * (F.col("_avg") + F.col("_iti")) / 1000.0).alias("seconds"))
