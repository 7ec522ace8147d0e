"""Stimulus events, windows, protocols and planned timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CHUNK_SIZE, MV_PER_VOLT, PA_PER_VOLT, SAMPLE_RATE
from ..functions.scalar import ms_to_samples
from .intervals import latest_before
from .ordered import neighbour, ordinal, running_by_size, segment_of


def apply_windows(events: DataFrame, lengths: DataFrame, keys: list[str], order: str = "event_seq",
                  segment: Column | None = None) -> DataFrame:
    """Window from each apply to the next event of any kind, or to the end of the recording,
    clipped to the recording; empty windows are dropped. ``lengths`` holds ``keys, n_samples``."""
    seg = segment if segment is not None else segment_of(order)
    e = neighbour(events, keys, [order], seg, {"sample_index": "_next"}, ahead=True)
    e = e.where("event_type = 'apply'").join(lengths, keys)
    n = F.col("n_samples")
    start = F.greatest(F.lit(0), F.least(F.col("sample_index"), n))
    stop = F.greatest(start, F.least(F.coalesce(F.col("_next"), n), n))
    return e.select(*keys, order, "stimulus_name", "stimulus_index", start.alias("start"), stop.alias("end")).where("end > start")


def paired_windows(events: DataFrame, lengths: DataFrame, keys: list[str], order: str = "event_seq",
                   segment: Column | None = None) -> DataFrame:
    """Window from each apply to the clear of the same stimulus. A second apply replaces the
    first, a clear without an apply is ignored, an apply left open runs to the end; empty windows are dropped."""
    seg = segment if segment is not None else segment_of(order)
    e = neighbour(events, [*keys, "stimulus_index"], [order], seg,
                  {"sample_index": "_next", "event_type": "_next_type"}, ahead=True)
    e = e.where("event_type = 'apply' AND (_next_type = 'clear' OR _next_type IS NULL)").join(lengths, keys)
    stop = F.least(F.coalesce(F.col("_next"), F.col("n_samples")), F.col("n_samples"))
    return e.select(
        *keys, "stimulus_index", F.col("sample_index").alias("start"), stop.alias("end"),
        F.col("_next_type").isNull().alias("open"),
    ).where("end > start")


def with_protocol(events: DataFrame, protocol_runs: DataFrame, keys: list[str], at: str,
                  keep: list[str]) -> DataFrame:
    """Latest protocol run that began at or before the event; the first listed wins a tie."""
    return latest_before(events, protocol_runs, keys, at, "start_sample", F.col("run_seq"), keep)


def _plan(rate: int) -> dict[str, Column]:
    """Sample counts of a trial's phases. In staircase fields zero counts as absent."""
    def given(c: str, default: float) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(default))

    zero = F.lit(0).cast("bigint")
    lo, hi, step = given("min_pA", 0.0), given("max_pA", 0.0), given("step_pA", 1.0)
    n = F.when((step > 0) & (hi - lo + 1e-9 >= 0), F.floor((hi - lo + 1e-9) / step).cast("bigint") + 1).otherwise(zero)
    quiet, volt = F.col("type") == "baseline", F.col("clamp_mode") == "voltage_clamp"
    stairs = ~quiet & ~volt
    lead = stairs & F.col("pulse_ms").isNotNull()
    width = F.greatest(F.lit(1).cast("bigint"), ms_to_samples(given("step_width_ms", 500.0), rate))
    gap = ms_to_samples(given("gap_ms", 0.0), rate)
    pre, post = ms_to_samples("pre_ms", rate), ms_to_samples("post_ms", rate)
    pulse = F.when(lead, ms_to_samples("pulse_ms", rate)).otherwise(zero)
    base = pre + pulse + F.when(lead, gap).otherwise(zero)
    steps = F.when(stairs, n * given("staircase_repeats", 1).cast("bigint")).otherwise(zero)
    hold = F.when(~quiet & volt, ms_to_samples(given("duration_ms", 500.0), rate)).otherwise(zero)
    end = base + steps * (width + gap) + hold
    return dict(lo=lo, step=step, n=n, stairs=stairs, width=width, gap=gap, pre=pre, pulse=pulse, base=base, steps=steps, hold=hold, end=end, total=end + post)


def planned_samples(rate: int = SAMPLE_RATE) -> Column:
    """Length of the whole trial waveform, pre and post parts included."""
    return _plan(rate)["total"]


def expected_segments(stimuli: DataFrame, keys: list[str], rate: int = SAMPLE_RATE) -> DataFrame:
    """Commanded voltage of a trial as ``(keys, seg_start, seg_end, volts)``.

    ``stimuli`` needs ``type, clamp_mode, pre_ms, post_ms, mv_per_volt, pulse_pA, pulse_ms, min_pA,
    max_pA, step_pA, step_width_ms, gap_ms, staircase_repeats, step_mV, duration_ms``; ``pulse_ms``
    is null without a leading pulse. Starts follow from the step number, so nothing is shuffled.
    """
    parts = _plan(rate)
    s = stimuli.select("*", *[c.alias(f"_{k}") for k, c in parts.items()])

    def piece(start: Column, length: Column, volts: Column) -> Column:
        return F.struct(start.cast("bigint").alias("a"), (start + length).cast("bigint").alias("b"), volts.cast("double").alias("v"))

    c = {k: F.col(f"_{k}") for k in parts}
    period = c["width"] + c["gap"]
    grid = F.sequence(F.lit(0).cast("bigint"), F.greatest(c["steps"] - 1, F.lit(0)))
    at = lambda k: c["base"] + k * period
    on = F.transform(grid, lambda k: piece(at(k), F.when(c["steps"] > 0, c["width"]).otherwise(F.lit(0)),
                                           F.round(c["lo"] + F.pmod(k, F.greatest(c["n"], F.lit(1))) * c["step"], 6) / PA_PER_VOLT))
    off = F.transform(grid, lambda k: piece(at(k) + c["width"], F.when(c["steps"] > 0, c["gap"]).otherwise(F.lit(0)), F.lit(0.0)))
    zero = F.lit(0.0)
    rest = F.array(
        piece(F.lit(0), c["pre"], zero), piece(c["pre"], c["pulse"], F.coalesce(F.col("pulse_pA"), zero) / PA_PER_VOLT),
        piece(c["pre"] + c["pulse"], c["base"] - c["pre"] - c["pulse"], zero),
        piece(c["base"], c["hold"], F.coalesce(F.col("step_mV"), zero) / F.coalesce(F.col("mv_per_volt"), F.lit(MV_PER_VOLT))),
        piece(c["end"], c["total"] - c["end"], zero))
    s = s.select(*keys, F.explode(F.concat(rest, on, off)).alias("_s"))
    return s.select(*keys, F.col("_s.a").alias("seg_start"), F.col("_s.b").alias("seg_end"), F.col("_s.v").alias("volts")).where("seg_end > seg_start")


def planned_timeline(trials: DataFrame, keys: list[str], rate: int = SAMPLE_RATE) -> DataFrame:
    """Apply and clear offsets of a run, in trial order.

    ``trials`` needs ``trial_pos, pre_ms, post_ms, iti_ms, waveform_samples`` (0 for baseline).
    A run starts with one interval; the waveform already holds its own pre and post parts, which
    this timeline adds again, as the recorder does.
    """
    pre, post, iti = (ms_to_samples(c, rate) for c in ("pre_ms", "post_ms", "iti_ms"))
    length = pre + F.col("waveform_samples") + post + iti
    t = running_by_size(trials, keys, ["trial_pos"], segment_of("trial_pos", 4096), {"_before": ("sum", length)}, inclusive=False)
    t = t.withColumn("apply_offset", iti + F.col("_before") + pre).drop("_before")
    return t.withColumn("clear_offset", F.col("apply_offset") + F.col("waveform_samples") + post)


def logged_index(offset: Column, run_start: Column, chunk: int = CHUNK_SIZE) -> Column:
    """Sample count at which a planned event is logged: the first chunk end at or after it."""
    c = F.lit(chunk).cast("bigint")
    return run_start + F.greatest(c, (F.ceil(offset / chunk) * chunk).cast("bigint"))


def timing_residuals(planned: DataFrame, log: DataFrame, keys: list[str], chunk: int = CHUNK_SIZE) -> DataFrame:
    """Logged against planned events, the k-th with the k-th of its kind: ``keys, event_type, place, planned_index, sample_index, residual``.

    ``planned`` has ``keys, event_type, offset, run_start``, ``log`` ``keys, event_type, sample_index, event_seq``. An event that was planned and not
    logged has no residual; one that was logged and not planned is left out.
    """
    by = [*keys, "event_type"]
    p = planned.withColumn("planned_index", logged_index(F.col("offset"), F.col("run_start"), chunk))
    p = ordinal(p, by, ["offset"], segment_of("offset", 1 << 20), "place")
    g = ordinal(log.select(*by, "sample_index", "event_seq"), by, ["event_seq"], segment_of("event_seq"), "place")
    j = p.select(*by, "place", "planned_index").join(g.select(*by, "place", "sample_index"), [*by, "place"], "left")
    return j.withColumn("residual", F.col("sample_index") - F.col("planned_index"))


def trial_bounds(trials: DataFrame, keys: list[str], rate: int = SAMPLE_RATE, chunk: int = CHUNK_SIZE) -> DataFrame:
    """Where each trial's data lies in the chunk stream: ``data_start`` and ``n_saved``.

    Samples are counted in whole chunks: each of the interval, pre and stimulus phases ends at the
    first chunk end at or after its length, and the count restarts at zero. ``trials`` needs
    ``trial_pos, iti_ms, pre_ms, n_samples``; saving starts with the pre phase and is cut to the
    planned length.
    """
    def phase(n: Column) -> Column:
        c = F.lit(chunk).cast("bigint")
        return F.greatest(c, (F.ceil(n / chunk) * chunk).cast("bigint"))

    pre = ms_to_samples("pre_ms", rate)
    wait = phase(ms_to_samples("iti_ms", rate))
    hold = phase(pre) + phase(F.col("n_samples") - pre)
    t = running_by_size(trials, keys, ["trial_pos"], segment_of("trial_pos", 4096), {"_before": ("sum", wait + hold)}, inclusive=False)
    t = t.withColumn("data_start", wait + F.col("_before")).drop("_before")
    return t.withColumn("n_saved", F.least(F.col("n_samples"), hold))


def sweeps_by_stimulus(trials: DataFrame) -> DataFrame:
    """Sweeps and recordings per stimulus name; repeats collapse before the distinct count."""
    g = trials.groupBy("name", "recording_id").agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy("name").agg(F.sum("_n").alias("n_sweeps"), F.count(F.lit(1)).alias("n_recordings"))


def step_count_consistency(staircases: DataFrame, keys: list[str]) -> DataFrame:
    """Found against expected steps over the repeats of a stimulus."""
    return staircases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_repeats"), F.min("found_steps").alias("min_steps"), F.max("found_steps").alias("max_steps"),
        (F.max("found_steps") > F.min("found_steps")).alias("varies"),
        F.count_if(F.col("found_steps") != F.col("expected_steps")).alias("n_off"),
    )
