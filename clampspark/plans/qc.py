"""Quality checks over all recordings, and their roll-up.

A check yields ``(keys, section, check_name, status, message, metrics)``. Checks are lazy; a report
is their union, so every check of every recording runs in one job.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import RAIL_BAND_V, RAIL_V, SAMPLE_RATE
from ..functions.scalar import not_finite
from ..operators.correlate import lags
from ..operators.intervals import merge_overlaps, samples_in, slices
from ..operators.ordered import join_small, neighbour, null_safe_join, ordinal, segment_of
from ..operators.spectra import merged_power, piece_errors, spectra
from ..session import materialise


# ---- status ---------------------------------------------------------------------------------

def severity(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "fail", 3).when(s == "warn", 2).when(s == "pass", 1).otherwise(0)


def worst(status: str) -> Column:
    """Aggregate: the most severe status, ``skip`` when there is none."""
    return F.coalesce(F.max_by(F.col(status), severity(status)), F.lit("skip"))


def ladder(value: Column, warn: float, fail: float) -> Column:
    return F.when(value >= fail, "fail").when(value >= warn, "warn").otherwise("pass")


def first_offender(per_channel: DataFrame, keys: list[str], order: str, label: str, value: str) -> DataFrame:
    """Overall status with the first channel at that status: the first failing one, else the
    first warning one."""
    g = per_channel.groupBy(*keys).agg(
        F.min_by(F.struct("status", F.col(label).alias("channel"), F.col(value).alias("value")),
                 F.struct(-severity("status"), F.col(order))).alias("w"))
    bad = F.col("w.status").isin("warn", "fail")
    return g.select(*keys, F.col("w.status").alias("status"), F.when(bad, F.col("w.channel")).alias("channel"),
                    F.when(bad, F.col("w.value")).alias("value"))


def as_result(df: DataFrame, keys: list[str], section: str, name: str, message: Column, metrics: dict[str, str]) -> DataFrame:
    parts = [x for k, c in metrics.items() for x in (F.lit(k), F.col(c).cast("double"))]
    m = F.create_map(*parts) if parts else F.create_map().cast("map<string,double>")
    return df.select(*keys, F.lit(section).alias("section"), F.lit(name).alias("check_name"), "status",
                     message.cast("string").alias("message"), m.alias("metrics"))


def roll_up(results: DataFrame, keys: list[str]) -> DataFrame:
    """Status per section and per recording (section null), most severe first wins."""
    return results.rollup(*keys, "section").agg(worst("status").alias("status"), F.count(F.lit(1)).alias("n_checks")).where(
        " AND ".join(f"{k} IS NOT NULL" for k in keys))


def run_checks(checks: dict[str, Callable[[], DataFrame]], recordings: DataFrame, keys: list[str], section: str) -> DataFrame:
    """Union of one section's checks. A check that cannot even be planned becomes a failed result
    for every recording, so that it never hides the others."""
    out = None
    for name, make in checks.items():
        try:
            r = make()
        except Exception as exc:  # noqa: BLE001
            r = recordings.select(*keys, F.lit("fail").alias("status"))
            r = as_result(r, keys, section, name, F.lit(f"not carried out: {exc}"), {})
        out = r if out is None else out.unionByName(r)
    return out


@dataclass(frozen=True)
class Check:
    """One check of a report: its section, the recording modes it applies to, and how to make its rows.

    ``make()`` gives ``keys, status`` and, where there are any, ``message``, ``metrics`` (map of numbers) and ``error``.
    """
    section: str
    name: str
    make: Callable[[], DataFrame]
    modes: tuple[str, ...] = ("continuous", "trial")


def dispatch(checks: list[Check], recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Every check on every recording of its modes: rows as :func:`as_result` makes them.

    ``recordings`` has ``keys, mode``. A recording the check says nothing about is skipped; one on which a kernel raised fails this check and
    no other; a check that cannot be planned fails for its recordings.
    """
    out = None
    none = F.lit(None).cast("string")
    for c in checks:
        mine = recordings.where(F.col("mode").isin(*c.modes)).select(*keys)
        try:
            r = c.make()
            have = r.columns
            message = F.col("message").cast("string") if "message" in have else none
            error = F.col("error") if "error" in have else none
            metrics = F.col("metrics") if "metrics" in have else F.create_map().cast("map<string,double>")
            r = r.select(*keys, "status", message.alias("message"), error.alias("error"), metrics.alias("metrics"))
            r = null_safe_join(mine, r, keys, "left")
        except Exception as exc:  # noqa: BLE001
            r = mine.select(*keys, none.alias("status"), none.alias("message"), F.lit(f"{type(exc).__name__}: {exc}"[:500]).alias("error"), F.create_map().cast("map<string,double>").alias("metrics"))
        broken = F.col("error").isNotNull()
        r = r.select(
            *keys, F.lit(c.section).alias("section"), F.lit(c.name).alias("check_name"), F.when(broken, "fail").otherwise(F.coalesce("status", F.lit("skip"))).alias("status"),
            F.when(broken, F.concat(F.lit("not carried out: "), "error")).otherwise(F.coalesce("message", F.lit(""))).alias("message"),
            F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"))
        out = r if out is None else out.unionByName(r)
    return out


def report(results: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per recording: mode, overall status, and the sections with their checks. A
    recording has one row per check, a fixed small number, so its list is bounded."""
    s = results.groupBy(*keys, "section").agg(F.sort_array(F.collect_list(
        F.struct(F.col("check_name").alias("name"), "status", "message", F.map_entries("metrics").alias("metrics")))).alias("checks"))
    s = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("section", "checks"))).alias("sections"))
    o = results.groupBy(*keys).agg(worst("status").alias("status"))
    r = recordings.join(o, keys, "left").join(s, keys, "left")
    return r.withColumn("status", F.coalesce("status", F.lit("skip")))


# ---- integrity ------------------------------------------------------------------------------

def sample_count(counts: DataFrame) -> DataFrame:
    """Stored samples against raw bytes (exact), sidecar samples (exact) and seconds (one off is
    fine). Needs ``n_samples, n_channels, rate, bin_bytes, sidecar_samples, sidecar_seconds``;
    a missing source is null and not compared."""
    n = F.col("n_samples")
    off_bytes = F.coalesce(F.col("bin_bytes") != n * F.col("n_channels") * 8, F.lit(False))
    off_count = F.coalesce(F.col("sidecar_samples") != n, F.lit(False))
    implied = F.bround(F.col("sidecar_seconds") * F.col("rate")).cast("bigint")
    off_time = F.coalesce(F.abs(implied - n) > 1, F.lit(False))
    issues = sum((F.when(x, 1).otherwise(0) for x in (off_bytes, off_count, off_time)), F.lit(0)).cast("bigint")
    return counts.withColumn("n_issues", issues).withColumn("status", F.when(F.col("n_issues") > 0, "fail").otherwise("pass"))


def metadata_agreement(store: DataFrame, sidecar: DataFrame, keys: list[str]) -> DataFrame:
    """Stored metadata against the sidecar: rate, channel names, start time to the second. Both
    have ``rate, channel_names, start_time``; no sidecar means skip."""
    from ..functions.scalar import to_the_second
    a = store.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("rate", "channel_names", "start_time")])
    b = sidecar.select(*keys, F.lit(True).alias("_has"), *[F.col(c).alias(f"b_{c}") for c in ("rate", "channel_names", "start_time")])
    j = a.join(b, keys, "left")
    rate = F.coalesce(F.col("b_rate"), F.lit(-1)) != F.col("a_rate")
    names = F.coalesce(F.size("b_channel_names") > 0, F.lit(False)) & ~F.col("a_channel_names").eqNullSafe(F.col("b_channel_names"))
    sa, sb = F.coalesce("a_start_time", F.lit("")), F.coalesce("b_start_time", F.lit(""))
    start = (sa != "") & (sb != "") & (to_the_second(sa) != to_the_second(sb))
    return j.select(
        *keys, F.when(F.col("_has").isNull(), "skip").when(rate | names | start, "warn").otherwise("pass").alias("status"),
        *[F.coalesce(F.when(F.col("_has"), x), F.lit(False)).alias(c) for c, x in (("rate_differs", rate), ("names_differ", names), ("start_differs", start))])


def channel_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Everything the per-channel checks need from the samples, in one pass with map-side
    combining: count, extremes, mean, near-rail and non-finite counts."""
    v = F.col("v")
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"),
        F.count_if((v >= RAIL_V - RAIL_BAND_V) | (v <= RAIL_BAND_V - RAIL_V)).alias("near_rail"),
        F.count_if(not_finite("v")).alias("n_nonfinite"))


def finite(stats: DataFrame, keys: list[str]) -> DataFrame:
    g = stats.groupBy(*keys).agg(F.sum("n_nonfinite").alias("n_nonfinite"), F.sum("n").alias("n_samples_total"))
    return g.withColumn("status", F.when(F.col("n_nonfinite") > 0, "fail").otherwise("pass"))


def saturation(stats: DataFrame) -> DataFrame:
    s = stats.withColumn("saturated_fraction", F.col("near_rail") / F.col("n"))
    return s.withColumn("status", ladder(F.col("saturated_fraction"), 1e-4, 1e-3))


def dc_offset(stats: DataFrame, channels: DataFrame) -> DataFrame:
    return stats.join(channels, "channel_index").withColumn("mean_display", F.col("mean_v") * F.col("display_scale")).withColumn("status", F.lit("pass"))


def events(log: DataFrame, lengths: DataFrame, keys: list[str], order: str = "event_seq", segment: Column | None = None) -> DataFrame:
    """Event table check: order, range and apply/clear pairing, with the first three issues.

    Open applies are listed but do not change the status. Every recording of ``lengths`` has a row; one without events is skipped.
    """
    seg = segment if segment is not None else segment_of(order)
    at = F.col("sample_index")
    e = neighbour(log, keys, [order], seg, {"sample_index": "_prev"}, ahead=False)
    e = neighbour(e, [*keys, "stimulus_index"], [order], seg, {"event_type": "_prev_type"}, ahead=False)
    e = join_small(e, lengths, keys, F.col(order), how="left")
    was_open = F.coalesce(F.col("_prev_type") == "apply", F.lit(False))
    double = (F.col("event_type") == "apply") & was_open
    orphan = (F.col("event_type") == "clear") & ~was_open
    e = e.withColumn("_double", double).withColumn("_orphan", orphan)
    text = (F.when(F.col("_double"), F.concat(F.lit("stimulus "), F.col("stimulus_index"), F.lit(" started again while on")))
            .when(F.col("_orphan"), F.concat(F.lit("stimulus "), F.col("stimulus_index"), F.lit(" ended while off"))))
    e = materialise(e, "event-pairs")
    g = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(at).alias("min_index"), F.max(at).alias("max_index"),
        F.max(F.col("n_samples")).alias("n_samples"), F.count_if(F.col("_prev") > at).alias("n_backward"),
        F.count_if((at < 0) | (at >= F.col("n_samples"))).alias("n_outside"),
        F.count_if("_double").alias("n_double"), F.count_if("_orphan").alias("n_orphan"))
    # Only the first three pairing issues of a recording are ever gathered.
    named = ordinal(e.where("_double OR _orphan").withColumn("_text", text), keys, [order], seg, "_rank").where("_rank < 3")
    named = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_text"))), lambda s: s["_text"]).alias("_pair"))
    last = log.groupBy(*keys, "stimulus_index").agg(F.max_by("event_type", F.col(order)).alias("_t")).where("_t = 'apply'")
    last = last.groupBy(*keys).agg(F.sort_array(F.collect_list("stimulus_index")).alias("unclosed"))
    g = g.join(named, keys, "left").join(last, keys, "left")
    head = F.array(
        F.when(F.col("n_backward") > 0, F.lit("sample indices go back")),
        F.when(F.col("n_outside") > 0, F.concat(F.col("n_outside"), F.lit(" events beyond the "), F.col("n_samples"), F.lit(" samples"))))
    counts = ("n_events", "n_backward", "n_outside", "n_double", "n_orphan")
    g = lengths.select(*keys).join(g, keys, "full").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    issues = F.slice(F.concat(F.array_compact(head), F.coalesce("_pair", F.array().cast("array<string>"))), 1, 3)
    return g.withColumn("message", F.array_join(issues, "; ")).withColumn(
        "status", F.when(F.col("n_events") == 0, "skip").when(F.size(issues) > 0, "warn").otherwise("pass")).withColumn(
        "unclosed", F.coalesce("unclosed", F.array().cast("array<int>"))).drop("_pair")


def missing_trials(expected: DataFrame, trials: DataFrame, keys: list[str], first: int = 5) -> DataFrame:
    """Trial numbers below the expected count that were not recorded: the first few per key."""
    want = expected.where("n_expected > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_expected") - 1)).alias("trial_index"))
    gone = want.join(trials.select(*keys, F.col("trial_index").cast("bigint").alias("trial_index")), [*keys, "trial_index"], "left_anti")
    gone = ordinal(materialise(gone, "missing"), keys, ["trial_index"], segment_of("trial_index", 4096), "_rank").where(F.col("_rank") < first)
    return gone.groupBy(*keys).agg(F.sort_array(F.collect_list("trial_index")).alias("missing"))


def trial_table(expected: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    """Trial count, numbering and channel count per recording; ``trials`` has ``trial_index,
    n_channels``. Numbering is right exactly when the n distinct numbers span 0 to n - 1."""
    one = trials.groupBy(*keys, F.col("trial_index").cast("bigint").alias("trial_index")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("n_channels").alias("_c0"), F.max("n_channels").alias("_c1"))
    one = materialise(one, "trial-numbers")
    t = one.groupBy(*keys).agg(
        F.sum("_n").alias("observed"), F.min("trial_index").alias("_lo"), F.max("trial_index").alias("_hi"), F.max("_n").alias("_rep"),
        F.min("_c0").alias("_c0"), F.max("_c1").alias("_c1"))
    j = expected.join(t, keys, "left").join(missing_trials(expected, one, keys), keys, "left")
    contiguous = (F.col("_lo") == 0) & (F.col("_hi") == F.col("observed") - 1) & (F.col("_rep") == 1)
    bad = (F.col("observed") != F.col("n_expected")) | ~contiguous | (F.col("_c0") != F.col("_c1"))
    return j.select(
        *keys, "n_expected", F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"),
        F.coalesce(contiguous, F.lit(False)).alias("contiguous"),
        F.coalesce("missing", F.array().cast("array<bigint>")).alias("missing"),
        F.when(F.col("observed").isNull() | bad, "fail").otherwise("pass").alias("status"))


def trigger_channel(channels: DataFrame, keys: list[str]) -> DataFrame:
    """The trigger line of each recording: the loopback when present, else the camera line."""
    rank = F.when(F.col("name") == "TTLLoopback", 0).when(F.col("name") == "Camera", 1)
    return channels.where(rank.isNotNull()).groupBy(*keys).agg(
        F.min_by("channel_index", rank).alias("channel_index"), F.min_by("name", rank).alias("name"))


def frame_counts(edges: DataFrame, videos: DataFrame, keys: list[str]) -> DataFrame:
    """Trigger edges (summed over trials) against video frames (summed over files). ``videos`` has
    ``frame_count``, null where a file could not be read."""
    e = edges.groupBy(*keys).agg(F.sum("n_edges").alias("n_edges"), F.avg("threshold").alias("threshold"))
    v = videos.groupBy(*keys).agg(F.sum("frame_count").alias("n_frames"), F.count_if(F.col("frame_count").isNull()).alias("unreadable"), F.count(F.lit(1)).alias("n_videos"))
    j = e.join(v, keys, "left").withColumn("drift", F.col("n_edges") - F.coalesce("n_frames", F.lit(0)))
    status = (F.when(F.col("n_videos").isNull(), "skip").when(F.col("unreadable") > 0, "warn").when(F.col("drift") == 0, "pass")
              .when(F.abs("drift") <= 1, "warn").otherwise("fail"))
    return j.withColumn("status", status)


def acquisition_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings and errors per log; blank lines do not count."""
    l = lines.where(F.trim("line") != "")
    g = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("log_lines"), F.count_if(F.col("line").contains("WARN")).alias("warnings"),
                             F.count_if(F.col("line").contains("ERROR")).alias("errors"))
    return g.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


# ---- signal ---------------------------------------------------------------------------------

def baseline_windows(lengths: DataFrame, log: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """Pre-stimulus window ``[0, first apply - 1)``; without applies the whole recording, or its first ``cap`` samples."""
    first = log.where("event_type = 'apply'").groupBy(*keys).agg(F.min("sample_index").alias("_a"))
    j = lengths.join(first, keys, "left")
    whole = F.col("n_samples") if cap is None else F.least(F.col("n_samples"), F.lit(cap))
    stop = F.when(F.col("_a").isNull(), whole).otherwise(F.greatest(F.lit(0), F.col("_a") - 1))
    return j.select(*keys, F.lit(0).cast("bigint").alias("start"), stop.cast("bigint").alias("end"))


def trial_baseline_windows(trials: DataFrame, keys: list[str]) -> DataFrame:
    """The first tenth of each recording's first trial, at least one sample."""
    t = trials.groupBy(*keys).agg(F.min_by("n_samples", F.col("trial_index")).alias("_n"))
    return t.select(*keys, F.lit(0).cast("bigint").alias("start"), F.greatest(F.lit(1).cast("bigint"), (F.col("_n") * 0.1).cast("bigint")).alias("end"))


def baseline_rms(blocks: DataFrame, windows: DataFrame, keys: list[str], group: list[str], size: int, least: int = 1000) -> DataFrame:
    """Population standard deviation inside the baseline window; skipped below ``least`` samples.

    ``windows`` has ``keys, group, start, end``; the samples of their blocks are summed where they lie.
    """
    w = windows.select(*dict.fromkeys([*keys, *group]), "start", "end")
    g = samples_in(blocks, w.where(F.col("end") - F.col("start") >= least), keys, size).groupBy(*group).agg(F.stddev_pop("v").alias("rms_v"))
    n = w.groupBy(*group).agg(F.max(F.greatest(F.col("end") - F.col("start"), F.lit(0))).alias("n_window"))
    ok = F.col("n_window") >= least
    return null_safe_join(n, g, group, "left").withColumn("status", F.when(ok, "pass").otherwise("skip"))


def drift(samples: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Straight-line fit over all samples: slope, total change, residual; null below one second.

    One aggregation: only sums per key and task are shuffled, and the sample count comes with them."""
    x, v = F.col("sample_index") / rate, F.col("v")
    g = samples.groupBy(*keys).agg(
        F.regr_slope(v, x).alias("slope_v_per_s"), F.count(F.lit(1)).alias("n_samples"), F.regr_syy(v, x).alias("_syy"), F.regr_sxy(v, x).alias("_sxy"))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope_v_per_s") * F.col("_sxy")) / F.col("n_samples"))
    cols = {"slope_v_per_s": F.col("slope_v_per_s"), "total_change_v": F.col("slope_v_per_s") * F.col("n_samples") / rate, "residual_std_v": rest}
    return g.select(*keys, *[F.when(F.col("n_samples") >= rate, c).alias(n) for n, c in cols.items()])


def line_share(blocks: DataFrame, keys: list[str], rate: int, **bands) -> DataFrame:
    """Line-frequency share of whole recordings by Welch's method: ``keys, line_fraction, error``; null below one second, without
    any power, with a sample that is not finite, or where a block raised (``error``).

    Half-overlapping one-second segments inside a block are summed where the block lies. Of a segment that crosses blocks only its
    partial spectra travel: a few sums per block, which add up. No sample is shuffled.
    """
    parts = spectra(blocks, keys, rate, **bands)
    cut = parts.where("_seg IS NOT NULL").groupBy(*keys, "_seg").agg(F.collect_list("_part").alias("_p"), F.min("_good").alias("_good"))
    cut = cut.select(*keys, merged_power(F.col("_p"), rate, **bands).alias("_w"), "_good").select(*keys, F.col("_w.line").alias("_line"), F.col("_w.total").alias("_total"), "_good", F.lit(None).cast("string").alias("_error"))
    g = parts.where("_seg IS NULL").select(*keys, "_line", "_total", "_good", "_error").unionByName(cut).groupBy(*keys).agg(
        F.sum("_line").alias("_line"), F.sum("_total").alias("_total"), F.min("_good").alias("_good"), F.min("_error").alias("error"))
    ok = F.col("error").isNull() & F.col("_good") & (F.col("_total") > 0)
    return g.select(*keys, F.when(ok, F.col("_line") / F.nullif(F.col("_total"), F.lit(0.0))).alias("line_fraction"), "error")


def line_noise(blocks: DataFrame, keys: list[str], rate: int, **bands) -> DataFrame:
    """Line-frequency share of each recording, all of it."""
    s = line_share(blocks, keys, rate, **bands)
    status = F.when(F.col("line_fraction").isNull(), "skip").otherwise(ladder(F.col("line_fraction"), 0.10, 0.30))
    return s.withColumn("status", status)


def noise_floor(blocks: DataFrame, keys: list[str], rate: int, scale: float = 1.0, **bands) -> DataFrame:
    """RMS around the mean and line share of a quiet sweep."""
    from ..operators.calibration import status_by
    stats = blocks.select(*keys, F.explode("samples").alias("v")).groupBy(*keys).agg((F.stddev_pop("v") * scale).alias("rms_display"))
    j = null_safe_join(stats, line_share(blocks, keys, rate, **bands), keys).withColumn("line_fraction", F.coalesce("line_fraction", F.lit(0.0)))
    return j.withColumn("status", status_by(F.col("line_fraction"), 0.10, 0.30))


# ---- commanded against recorded -------------------------------------------------------------

def command_error(trials: DataFrame, segments: DataFrame, keys: list[str], size: int, rate: int, with_lag: bool = True, **lag_sizes) -> DataFrame:
    """Per trial: peak command, RMS error, peak error and lag over the overlap.

    ``trials`` is a block table keyed by ``keys`` (recording and trial); ``segments`` has the same
    keys with ``seg_start, seg_end, volts``. Errors are summed where the blocks lie; for the lag of trials that are not flat, the
    samples move once, in pieces (see ``correlate``).
    """
    seg = segments.select(*keys, "seg_start", "seg_end", "volts")
    p = piece_errors(slices(trials, seg, keys, size, "seg_start", "seg_end"), keys)
    # A trial of which a piece raised has its error and no figures of its own.
    g = p.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"), F.max(F.abs("volts")).alias("peak_cmd_v"), F.sum("sq").alias("_sq"), F.max("worst").alias("peak_error_v"),
        F.sum(F.col("volts") * F.col("n")).alias("_se"), F.sum("total").alias("_sr"), F.min("volts").alias("_e0"), F.max("volts").alias("_e1"),
        F.min("lo").alias("_r0"), F.max("hi").alias("_r1"), F.min("part_start").alias("_first"), F.max(F.col("part_start") + F.col("n")).alias("_stop"),
        F.min("_error").alias("error"))
    n = F.col("n_samples")
    g = g.withColumn("rmse_v", F.sqrt(F.col("_sq") / n)).withColumn("_me", F.col("_se") / n).withColumn("_mr", F.col("_sr") / n)
    reach = lambda lo, hi, m: F.greatest(F.abs(F.col(lo) - F.col(m)), F.abs(F.col(hi) - F.col(m)))
    g = g.withColumn("_flat", (reach("_e0", "_e1", "_me") < 1e-9) | (reach("_r0", "_r1", "_mr") < 1e-9))
    warn = F.greatest(F.col("peak_cmd_v") * 0.05, F.lit(0.05))
    fail = F.greatest(F.col("peak_cmd_v") * 0.5, F.lit(0.25))
    status = F.when(F.col("rmse_v") > fail, "fail").when(F.col("rmse_v") > warn, "warn").otherwise("pass")
    if not with_lag:
        return g.withColumn("status", status).drop(*[c for c in g.columns if c.startswith("_")])
    g = materialise(g, "command-errors")
    known = g.where("not _flat AND error IS NULL").select(*keys, "_first", (F.col("_stop") - F.col("_first")).alias("n"), F.col("_mr").alias("mean_r"), F.col("_me").alias("mean_e"))
    pieces = slices(trials, null_safe_join(seg, known, keys), keys, size, "seg_start", "seg_end").select(
        *keys, (F.col("part_start") - F.col("_first")).alias("at"), F.col("part").alias("rec"), F.col("volts").alias("level"), "n", "mean_r", "mean_e")
    j = null_safe_join(g, lags(pieces, keys, **lag_sizes), keys, "left").withColumn("timing_offset_ms", F.coalesce("lag", F.lit(0)) / rate * 1000.0).drop("lag")
    late = F.abs("timing_offset_ms")
    both = F.when((F.col("rmse_v") > fail) | (late > 5.0), "fail").when((F.col("rmse_v") > warn) | (late > 1.0), "warn").otherwise("pass")
    return j.withColumn("status", both).drop(*[c for c in j.columns if c.startswith("_")])


def stimulus_by_name(trials: DataFrame, definitions: DataFrame, keys: list[str], position: str = "stimulus_index") -> DataFrame:
    """Trials with the definition of their stimulus: ``trials`` and the columns of ``definitions`` but ``keys``, and ``found``.

    Both have ``keys`` (what a protocol belongs to) and ``name``; of several definitions of one name the last by ``position`` counts.
    """
    rest = [c for c in definitions.columns if c not in (*keys, "name")]
    last = definitions.groupBy(*keys, "name").agg(F.max_by(F.struct(*rest), position).alias("_d"))
    j = null_safe_join(trials, last, [*keys, "name"], "left")
    return j.select(*trials.columns, *[F.col(f"_d.{c}").alias(c) for c in rest], F.col("_d").isNotNull().alias("found"))


def command_verdict(trials: DataFrame, errors: DataFrame, keys: list[str], trial: str = "trial_index") -> DataFrame:
    """Verdict per recording over its trials: the worst, and the first trial at it.

    ``trials`` lists all trials; one without a row in ``errors`` (as :func:`command_error` gives them) had no stimulus of its name, or no samples, and is left out of the
    verdict. A recording whose trials are all left out passes; a trial that raised fails its recording's check.
    """
    j = null_safe_join(trials.select(*keys, trial), errors, [*keys, trial], "left")
    judged = F.when(F.col("error").isNotNull(), "fail").otherwise(F.col("status"))
    j = j.withColumn("_s", judged)
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col("_s").isNull()).alias("n_skipped"), F.min("error").alias("error"), F.avg("rmse_v").alias("mean_rmse_v"),
        F.min_by(F.struct("_s", F.col(trial).alias("trial"), "rmse_v", "timing_offset_ms"), F.struct(-severity("_s"), F.col(trial))).alias("_w"))
    status = F.coalesce("_w._s", F.lit("pass"))
    bad = status.isin("warn", "fail")
    text = F.when(bad, F.concat(F.lit("trial "), F.col("_w.trial"), F.lit(": error "), F.round(F.col("_w.rmse_v") * 1000, 1), F.lit(" mV, offset "), F.round("_w.timing_offset_ms", 1), F.lit(" ms"))).otherwise("")
    return g.select(*keys, status.alias("status"), text.alias("message"), "error", "n_trials", "n_skipped", F.when(bad, F.col("_w.trial")).alias("worst_trial"), "mean_rmse_v",
                    F.create_map(F.lit("n_trials"), F.col("n_trials").cast("double"), F.lit("n_skipped"), F.col("n_skipped").cast("double")).alias("metrics"))


def trial_frame_counts(edges: DataFrame, lines: DataFrame, videos: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`frame_counts` on the trigger line of each recording. ``edges`` has one row per line (and trial); a recording without a
    trigger line is skipped, like one without a video."""
    chosen = trigger_channel(lines, keys).select(*keys, "channel_index")
    return frame_counts(edges.join(chosen, [*keys, "channel_index"]), videos, keys)


def command_activity(command: DataFrame, windows: DataFrame, lengths: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Command RMS inside and outside the stimulus windows; a sample in several windows counts
    once. ``command`` is the command channel's block table in volts. A recording without windows is skipped."""
    square = F.aggregate("part", F.lit(0.0), lambda a, x: a + x * x)
    inside = slices(command, merge_overlaps(windows, keys), keys, size).groupBy(*keys).agg(
        F.sum(F.size("part")).alias("_na"), F.sum(square).alias("_sa"))
    every = command.groupBy(*keys).agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)).alias("_s"))
    nw = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
    j = every.join(lengths, keys).join(nw, keys, "left").join(inside, keys, "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0).cast("bigint")))
    na, sa = F.coalesce("_na", F.lit(0)), F.coalesce("_sa", F.lit(0.0))
    nq = F.col("n_samples") - na
    j = j.withColumn("active_rms_v", F.when(na > 0, F.sqrt(sa / na)).otherwise(F.lit(0.0)))
    j = j.withColumn("inactive_rms_v", F.when(nq > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("_s") - sa) / nq)).otherwise(F.lit(0.0)))
    status = F.when(F.col("n_windows") == 0, "skip").when(F.col("inactive_rms_v") > 0.25, "warn").when((F.col("active_rms_v") < 0.01), "warn").otherwise("pass")
    return j.select(*keys, "n_windows", "active_rms_v", "inactive_rms_v", status.alias("status"))
