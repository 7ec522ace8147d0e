"""Pulse detection on a command channel and grouping into staircases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BLOCK_SAMPLES, MIN_AMP_PA
from ..session import materialise
from .blocks import runs
from .ordered import neighbour, ordinal, running, segment_of
from .quantiles import window_medians


def command_runs(blocks: DataFrame, keys: list[str], min_amp: float = MIN_AMP_PA) -> DataFrame:
    """Runs of ``abs(v) >= min_amp``; a sign change inside a run does not end it."""
    return runs(blocks, keys, lambda x: F.abs(x) >= min_amp)


def find_pulses(blocks: DataFrame, keys: list[str], min_samples: int, min_amp: float = MIN_AMP_PA,
                size: int = BLOCK_SAMPLES) -> DataFrame:
    """Runs of at least ``min_samples`` with their median as ``amplitude``."""
    r = command_runs(blocks, keys, min_amp).where(F.col("offset") - F.col("onset") >= min_samples)
    r = materialise(r, "runs")
    return window_medians(blocks, r, keys, [*keys, "onset", "offset"], "amplitude", size, "onset", "offset")


def start_by_gap(pulses: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """Add ``apply_sample``: the onset of the first pulse of the group that no silence longer than
    ``max_gap`` interrupts."""
    seg = segment_of("onset")
    p = neighbour(pulses, keys, ["onset"], seg, {"offset": "_prev"}, ahead=False)
    joins = F.coalesce(F.col("onset") - F.col("_prev") <= max_gap, F.lit(False))
    p = running(p, keys, ["onset"], seg, {"apply_sample": ("last", F.when(~joins, F.col("onset")))})
    return p.drop("_prev")


def staircases(pulses: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with its extent, numbered in order: ``found_steps, apply_sample,
    clear_sample, staircase_index``."""
    g = pulses.groupBy(*keys, "apply_sample").agg(F.count(F.lit(1)).alias("found_steps"), F.max("offset").alias("clear_sample"))
    return ordinal(g, keys, ["apply_sample"], segment_of("apply_sample"), "staircase_index")


def number_pulses(pulses: DataFrame, group: list[str]) -> DataFrame:
    """Add ``pulse_seq``, the zero-based order within the group."""
    return ordinal(pulses, group, ["onset"], segment_of("onset"), "pulse_seq")


def split_leading_pulse(pulses: DataFrame, group: list[str], expected: Column) -> DataFrame:
    """Mark the leading test pulse of each group as ``is_leading``.

    It is the first pulse when negative and either announced (``expected``) or followed by others.
    """
    p = pulses if "pulse_seq" in pulses.columns else number_pulses(pulses, group)
    n = p.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pulses"))
    p = p.join(n, group)
    lead = (F.col("pulse_seq") == 0) & (F.col("amplitude") < 0) & (F.coalesce(expected, F.lit(False)) | (F.col("n_pulses") > 1))
    return p.withColumn("is_leading", lead)


def clip_runs(runs_df: DataFrame, windows: DataFrame, keys: list[str], min_samples: int, span: int) -> DataFrame:
    """Runs cut to the windows they overlap; ``span`` is the grid of the interval join. Keeps
    pieces of at least ``min_samples``."""
    def grid(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / span).cast("bigint"), F.floor((F.col(b) - 1) / span).cast("bigint")))

    r = runs_df.withColumn("_g", grid("onset", "offset"))
    w = windows.where("end > start").withColumn("_g", grid("start", "end"))
    j = r.join(w, [*keys, "_g"]).where("onset < end AND offset > start")
    lo, hi = F.greatest("onset", "start"), F.least("offset", "end")
    # The pair meets in every cell both touch; keep the one where the overlap begins.
    j = j.where(F.floor(lo / span) == F.col("_g"))
    rest = [c for c in windows.columns if c not in keys]
    return j.select(*keys, *rest, lo.alias("onset"), hi.alias("offset")).where(F.col("offset") - F.col("onset") >= min_samples)
