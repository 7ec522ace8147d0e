"""Reads and writes of the block table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BLOCK_SAMPLES
from ..operators.blocks import unpack
from ..operators.ordered import running, segment_of


def write_blocks(blocks: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Write blocks clustered by ``(keys, block_start)``: row groups then carry tight bounds on
    both, and range reads skip the rest. Range partitioning splits a long recording over files."""
    order = [*keys, "block_start"]
    w = blocks.repartitionByRange(*order).sortWithinPartitions(*order).write
    (w.partitionBy(*partition_by) if partition_by else w).option("compression", "zstd").parquet(path)


def read_range(blocks: DataFrame, keys: list[str], start_s: float, end_s: float, rate: int, scale: float = 1.0, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Samples of ``[int(start_s * rate), int(end_s * rate))`` in display units with their time.

    No block is longer than ``block`` samples, so both bounds on ``block_start`` reach the scan; the sample predicate
    trims the edges.
    """
    lo, hi = max(0, int(start_s * rate)), int(end_s * rate)
    b = blocks.where((F.col("block_start") < hi) & (F.col("block_start") > lo - block))
    s = unpack(b, keys).where((F.col("sample_index") >= lo) & (F.col("sample_index") < hi))
    return s.select(*keys, "sample_index", (F.col("sample_index") / rate).alias("t_s"), (F.col("v") * scale).alias("v_display"))


def concat_offsets(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Place each trial on one common axis: ``concat_start`` is the sum of the earlier lengths.
    Only lengths are summed; the samples stay where they are."""
    n = trials.groupBy(*keys, "trial_index").agg(F.sum(F.size("samples")).cast("bigint").alias("_n"))
    n = running(n, keys, ["trial_index"], segment_of("trial_index", 4096), {"concat_start": ("sum", F.col("_n"))}, inclusive=False)
    return trials.join(n.drop("_n"), [*keys, "trial_index"])


def append_events(events: DataFrame, path: str) -> None:
    """Append logged stimulus events; ``event_seq`` keeps the order of the log."""
    cols = ["recording_id", "event_seq", "sample_index", "event_type", "stimulus_name", "stimulus_index"]
    events.select(*cols).write.mode("append").parquet(path)
