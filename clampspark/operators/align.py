"""Camera triggers to video frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BLOCK_SAMPLES, MIN_SWING_V, TTL_THRESHOLD_V
from .blocks import edges
from .intervals import first_at_or_after, slices
from .ordered import ordinal, segment_of
from .store import Store, attach


def frame_samples(blocks: DataFrame, keys: list[str], threshold: float = TTL_THRESHOLD_V) -> DataFrame:
    """Sample of each frame trigger: rising edges at a fixed threshold, an initial high counts."""
    e = edges(blocks, keys, lambda x: x >= threshold).where("direction = 1").drop("direction")
    return ordinal(e, keys, ["sample_index"], segment_of("sample_index"), "frame_no")


def thresholds(store: Store, min_swing: float = MIN_SWING_V) -> DataFrame:
    """Midpoint of each key's lowest and highest value, from the store's nodes; null for flat keys."""
    live = (F.col("n_samples") >= 2) & (F.col("hi") - F.col("lo") >= min_swing)
    return store.swing().select(*store.keys, F.when(live, 0.5 * (F.col("lo") + F.col("hi"))).alias("threshold"))


def adaptive_edges(store: Store, min_swing: float = MIN_SWING_V) -> DataFrame:
    """Rising edges above each key's midpoint; flat keys have none and an initial high is no edge.

    Only blocks that, with the sample before them, lie on both sides of the threshold are opened; the threshold travels to them.
    """
    keys, t = store.keys, F.col("threshold")
    low, high = F.least("lo", F.when(~F.isnan("prior"), F.col("prior"))), F.greatest("hi", F.when(~F.isnan("prior"), F.col("prior")))
    # A NaN is above any number in comparisons, and a missing sample below: blocks with either are opened too.
    odd = (F.col("n_good") < F.col("n")) | F.isnan("prior")
    z = store.per_block(thresholds(store, min_swing).where(t.isNotNull()), [low.alias("_low"), high.alias("_high"), F.coalesce(odd, F.lit(False)).alias("_odd")])
    crossing = z.where(F.col("_odd") | ((F.col("_low") <= t) & (F.col("_high") > t))).select(*keys, "block_no", "threshold")
    b = attach(store.blocks, crossing, keys)
    # Centre on the threshold so that the level test is one constant comparison.
    centred = b.select(
        *keys, "block_no", "block_start",
        *[F.transform(c, lambda x: x - t).alias(c) for c in ("samples", "before", "after")],
    )
    e = edges(centred, keys, lambda x: x > 0, initial_high_counts=False).where("direction = 1")
    return e.select(*keys, "sample_index")


def adaptive_edge_counts(store: Store, min_swing: float = MIN_SWING_V) -> DataFrame:
    keys = store.keys
    n = adaptive_edges(store, min_swing).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    return thresholds(store, min_swing).join(n, keys, "left").select(
        *keys, F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges"), "threshold")


def pair_frames(triggers: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """k-th trigger with k-th video frame; the surplus of the longer side is left out."""
    return triggers.join(frames, [*keys, "frame_no"])


def nearest_frame(points: DataFrame, frames: DataFrame, keys: list[str], point: str) -> DataFrame:
    """First frame at or after each point, the last frame beyond the end. ``frames`` holds
    ``keys, frame_no, sample_index``."""
    marks = frames.select(*keys, F.col("sample_index").alias("_frame_sample"), "frame_no")
    hit = first_at_or_after(points, marks, keys, point, "_frame_sample", ["frame_no"])
    last = frames.groupBy(*keys).agg(F.max("frame_no").alias("_last"))
    return hit.join(last, keys).withColumn("frame_no", F.coalesce("frame_no", "_last")).drop("_last")


def regions_to_frames(regions: DataFrame, frames: DataFrame, keys: list[str], region: str) -> DataFrame:
    """Frame range of ``(keys, region, start_sample, end_sample)``: at least one frame, clamped."""
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    marks = frames.select(*keys, F.col("sample_index").alias("_frame_sample"), "frame_no")
    ends = regions.select(*keys, region, F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col("start_sample").alias("at")),
        F.struct(F.lit("e").alias("side"), F.col("end_sample").alias("at")))).alias("_x")).select(*keys, region, "_x.*")
    hit = first_at_or_after(ends, marks, keys, "at", "_frame_sample", ["frame_no"]).join(n, keys)
    pos = F.coalesce("frame_no", "n_frames")
    g = hit.withColumn("_pos", pos).groupBy(*keys, region, "n_frames").agg(
        F.max(F.when(F.col("side") == "s", F.col("_pos"))).alias("_s"),
        F.max(F.when(F.col("side") == "e", F.col("_pos"))).alias("_e"))
    first = F.greatest(F.lit(0), F.least("_s", F.col("n_frames") - 1))
    g = g.withColumn("start_frame", first)
    stop = F.greatest(F.col("start_frame") + 1, F.least("_e", "n_frames"))
    return g.select(*keys, region, "start_frame", stop.alias("end_frame"))


def frame_windows(blocks: DataFrame, frames: DataFrame, keys: list[str], half: int,
                  size: int = BLOCK_SAMPLES) -> DataFrame:
    """Slices of the trace within ``half`` samples of each frame. A frame outside the recording has one row whose
    ``part`` is null: its samples are missing."""
    w = frames.select(*keys, "frame_no", F.greatest(F.col("sample_index") - half, F.lit(0)).alias("start"),
                      (F.col("sample_index") + half).alias("end"))
    met = slices(blocks, w, keys, size)
    # Which blocks exist is told by their numbers alone; the samples are not read for it.
    touched = w.where("end > start").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    there = blocks.select(*keys, "block_no", (F.col("block_start") + F.size("samples")).alias("_end"), "block_start")
    seen = attach(there, touched, keys).where((F.col("start") < F.col("_end")) & (F.col("end") > F.col("block_start"))).select(*keys, "frame_no").distinct()
    gone = w.join(seen, [*keys, "frame_no"], "left_anti")
    none = F.lit(None)
    return met.unionByName(gone.withColumn("part_start", none.cast("bigint")).withColumn("part", none.cast(met.schema["part"].dataType)))
