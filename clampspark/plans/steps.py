"""Step analysis over all recordings: windows, pulses, staircases, resting level, resistance."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import (BASELINE_MARGIN_MS, BLOCK_SAMPLES, HALO_SAMPLES, MAX_GAP_MS, MIN_AMP_PA, MIN_STEP_MS, SAMPLE_RATE)
from ..functions.scalar import ms_count
from ..operators.blocks import running_median
from ..operators.intervals import latest_before
from ..operators.ordered import ordinal, segment_of
from ..operators.pulses import clip_runs, command_runs, start_by_gap
from ..operators.quantiles import window_medians
from ..operators.stimulus import apply_windows
from ..session import materialise, mounted_path, small_files, write_lines


@dataclass(frozen=True)
class StepSettings:
    rate: int = SAMPLE_RATE
    block: int = BLOCK_SAMPLES
    halo: int = HALO_SAMPLES
    min_amp: float = MIN_AMP_PA
    min_step_ms: float = MIN_STEP_MS
    max_gap_ms: float = MAX_GAP_MS
    margin_ms: float = BASELINE_MARGIN_MS

    @property
    def kernel(self) -> int:
        return max(3, ms_count(1.0, self.rate) | 1)


def smooth_command(command: DataFrame, s: StepSettings) -> DataFrame:
    """Command blocks after the 1 ms running median."""
    return running_median(command, s.kernel, s.halo)


def detect(command: DataFrame, events: DataFrame, lengths: DataFrame, keys: list[str], s: StepSettings) -> DataFrame:
    """Pulse windows of every staircase, event windows first.

    A recording whose events give no pulse falls back to grouping its pulses by silence. Rows:
    ``keys, apply_sample, stimulus_name, stimulus_index, onset, offset``.
    """
    min_samples = ms_count(s.min_step_ms, s.rate)
    found = command_runs(command, keys, s.min_amp)
    windows = apply_windows(events, lengths, keys).withColumn("apply_sample", F.col("start"))
    by_event = clip_runs(found, windows.drop("event_seq"), keys, min_samples, s.block).drop("start", "end")
    by_event = materialise(by_event, "event-pulses")
    long_runs = found.where(F.col("offset") - F.col("onset") >= min_samples)
    rest = long_runs.join(by_event.select(*keys).distinct(), keys, "left_anti")
    grouped = start_by_gap(rest, keys, ms_count(s.max_gap_ms, s.rate))
    by_gap = grouped.select(
        *keys, F.lit("unknown").alias("stimulus_name"), F.lit(-1).alias("stimulus_index"), "apply_sample", "onset", "offset")
    return by_event.select(by_gap.columns).unionByName(by_gap)


def intrinsics(command: DataFrame, response: DataFrame, events: DataFrame, lengths: DataFrame,
               protocol_runs: DataFrame, keys: list[str], s: StepSettings = StepSettings()) -> DataFrame:
    """One row per staircase, unrounded: times, steps, amplitude range, resting level, resistance.

    ``command`` and ``response`` are stored block tables in display units (pA, mV); ``protocol_runs`` has
    ``run_seq, start_sample, has_pulse``. Medians come from two interval
    joins: pulses on the command, baselines and the last half of leading pulses on the response.
    """
    smooth = smooth_command(command, s)
    pulses = detect(smooth, events, lengths, keys, s)
    stair = [*keys, "apply_sample"]
    pulses = materialise(pulses, "pulses")
    first = pulses.groupBy(*stair).agg(F.min_by("offset", "onset").alias("offset"), F.min("onset").alias("onset"))
    margin = ms_count(s.margin_ms, s.rate)

    def window(df: DataFrame, kind: str, start, end) -> DataFrame:
        return df.select(*keys, "apply_sample", F.lit(kind).alias("_kind"), "onset", start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    on, off = F.col("onset"), F.col("offset")
    sides = materialise(window(first, "base", F.col("apply_sample"), F.greatest(F.col("apply_sample"), on - margin))
                        .unionByName(window(first, "steady", on + F.floor((off - on) / 2), off)), "side-windows")
    # The command is smoothed after its blocks have met their windows: they stay where they are stored.
    amps = window_medians(command, window(pulses, "amp", on, off), keys, [*stair, "onset"], "amplitude", s.block, prepare=lambda b: smooth_command(b, s))
    sides = materialise(window_medians(response, sides, keys, [*stair, "_kind"], "_m", s.block), "medians").groupBy(*stair).agg(
        F.max(F.when(F.col("_kind") == "base", F.col("_m"))).alias("rmp_mV"),
        F.max(F.when(F.col("_kind") == "steady", F.col("_m"))).alias("_steady"))
    amps = materialise(amps, "amplitudes")

    p = pulses.join(amps, [*stair, "onset"]).join(first.select(*stair, F.col("onset").alias("_on0")), stair)
    lead = F.col("onset") == F.col("_on0")
    g = p.groupBy(*stair, "stimulus_name", "stimulus_index").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(lead, F.col("amplitude"))).alias("_a0"),
        F.min("onset").alias("_on_all"), F.max("offset").alias("_off_all"),
        F.min(F.when(~lead, F.col("onset"))).alias("_on_rest"), F.max(F.when(~lead, F.col("offset"))).alias("_off_rest"),
        F.min("amplitude").alias("_min_all"), F.max("amplitude").alias("_max_all"),
        F.min(F.when(~lead, F.col("amplitude"))).alias("_min_rest"), F.max(F.when(~lead, F.col("amplitude"))).alias("_max_rest"),
    )
    starts = latest_before(first.select(*stair), protocol_runs, keys, "apply_sample", "start_sample", F.col("run_seq"), ["has_pulse"])
    ranks = ordinal(first.select(*stair), keys, ["apply_sample"], segment_of("apply_sample"), "staircase_index")
    g = g.join(starts, stair).join(ranks, stair)
    has_lead = (F.col("_a0") < 0) & (F.coalesce("has_pulse", F.lit(False)) | (F.col("_n") > 1))
    g = g.withColumn("_lead", has_lead).join(sides, stair, "left")
    rest = F.col("_lead") & (F.col("_n") > 1)

    def choose(a: str, b: str):
        return F.when(rest, F.col(a)).otherwise(F.col(b))

    drive = F.col("_a0") / 1000.0
    resistance = F.when(F.col("_lead") & (F.abs("_a0") >= 1e-9), (F.col("_steady") - F.col("rmp_mV")) / drive)
    return g.select(
        *keys, "staircase_index", "stimulus_name", "apply_sample",
        (choose("_on_rest", "_on_all") / s.rate).alias("t_start_s"), (choose("_off_rest", "_off_all") / s.rate).alias("t_end_s"),
        (F.col("_n") - F.when(F.col("_lead"), 1).otherwise(0)).cast("bigint").alias("n_steps"),
        choose("_min_rest", "_min_all").alias("min_amp_pA"), choose("_max_rest", "_max_all").alias("max_amp_pA"),
        "rmp_mV", resistance.alias("input_resistance_MOhm"),
    )


INTRINSICS_COLUMNS = ["staircase_index", "stimulus_name", "t_start_s", "t_end_s", "n_steps", "min_amp_pA",
                      "max_amp_pA", "rmp_mV", "input_resistance_MOhm"]
INTRINSICS_SCHEMA = ("staircase_index bigint, stimulus_name string, t_start_s double, t_end_s double, n_steps bigint, min_amp_pA double, "
                     "max_amp_pA double, rmp_mV double, input_resistance_MOhm double")


CSV_ROWS = 1 << 16


def rounded(df: DataFrame) -> DataFrame:
    """The report precision: two decimals for times, one for the rest, half to even."""
    places = {"t_start_s": 2, "t_end_s": 2, "min_amp_pA": 1, "max_amp_pA": 1, "rmp_mV": 1, "input_resistance_MOhm": 1}
    return df.select(*[F.bround(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, keys: list[str], path: str) -> bool:
    """Nine-column CSV per recording folder, in one file per ``CSV_ROWS`` staircases; an empty result writes no file. Tells whether there is any.

    The recordings' folders lie in as many folders as each of these holds recordings, so they are listed by few tasks.
    """
    folders = [f"{k}_part" for k in keys]
    out = materialise(rounded(df).select(*INTRINSICS_COLUMNS, *[F.col(k).alias(f) for k, f in zip(keys, folders)]), "staircases")
    part = F.floor(F.col("staircase_index") / CSV_ROWS)
    n = out.select(*folders, part).distinct().count()
    out = out.withColumn("folder", F.pmod(F.hash(*folders), F.lit(max(1, math.isqrt(n)))))
    mounted = mounted_path(df.sparkSession, path)
    if mounted:
        write_lines(out.withColumn("_part", part), ["folder", *folders], n, "_part", ["staircase_index"], F.to_csv(F.struct(*INTRINSICS_COLUMNS)),
                    ",".join(INTRINSICS_COLUMNS), mounted)
    else:
        files, n = small_files(out, [*[F.col(f) for f in folders], part])
        files.partitionBy("folder", *folders).option("header", True).csv(path)
    return n > 0


def read_csv(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The files of :func:`write_csv` with their integer ``keys``.

    A key is read from each file's path: as partitions, the folders would be parsed by the driver one after another. Files are read whole
    (``multiLine``), which opens each of them at half the cost, and line ends inside a name stay.
    """
    r = spark.read.schema(INTRINSICS_SCHEMA).option("header", True).option("multiLine", True).option("recursiveFileLookup", True).csv(path)
    return r.select(*INTRINSICS_COLUMNS, *[F.regexp_extract("_metadata.file_path", f"/{k}_part=([^/]*)/", 1).try_cast("bigint").alias(k) for k in keys])
