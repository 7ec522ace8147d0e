"""The block table: fixed-length runs of samples, one row per (keys, block).

Columns: the keys, ``block_no``, ``block_start``, ``samples`` and two halos, ``before`` and
``after``, holding the neighbouring samples on each side (0.1 % more data at the default sizes).
With the halo stored, edges, runs and running medians are map-only: samples are never shuffled
again after they have been packed.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import BLOCK_SAMPLES, HALO_SAMPLES
from ..session import materialise
from .ordered import neighbour, segment_of


def pack(samples: DataFrame, keys: list[str], size: int = BLOCK_SAMPLES, halo: int = HALO_SAMPLES,
         index: str = "sample_index", value: str = "v") -> DataFrame:
    """Long rows ``(keys, index, value)`` to blocks. One shuffle, groups of ``size + 2 halo`` rows.

    A value's place follows from its index: a missing sample is null, and an index given twice is an error.
    """
    i = F.col(index)
    first = F.greatest(F.floor((i - halo) / size), F.lit(0)).cast("bigint")
    last = F.floor((i + halo) / size).cast("bigint")
    rows = samples.select(
        *keys, i.alias("i"), F.col(value).alias("v"), F.explode(F.sequence(first, last)).alias("block_no")
    )
    b = rows.groupBy(*keys, "block_no").agg(F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))).alias("p"))
    start = F.col("block_no") * size
    b = b.withColumn("block_start", start)

    none = F.array().cast("array<double>")
    lo, hi = F.element_at("p", 1)["i"], F.element_at("p", -1)["i"]
    # Where the indices are not simply consecutive, the missing ones are added.
    given, wanted = F.col("p")["i"], F.sequence(lo, hi)
    gaps = F.array_except(wanted, given)
    filled = F.sort_array(F.concat("p", F.transform(gaps, lambda k: F.struct(k.alias("i"), F.lit(None).cast("double").alias("v")))))["v"]
    twice = F.raise_error(F.lit("a sample index is given twice")).cast("array<double>")
    b = b.withColumn("_lo", lo).withColumn("_hi", hi + 1).withColumn("_v", F.when(given == wanted, F.col("p")["v"]).when(
        F.size("p") + F.size(gaps) > hi - lo + 1, twice).otherwise(filled))

    def part(a: Column, z: Column) -> Column:
        a, z = F.greatest(a, F.col("_lo")), F.least(z, F.col("_hi"))
        return F.when(z > a, F.slice("_v", (a - F.col("_lo") + 1).cast("int"), (z - a).cast("int"))).otherwise(none)

    # A block whose first samples are missing still begins at its first index; one without any sample is left out.
    own = F.exists("p", lambda s: (s["i"] >= start) & (s["i"] < start + size))
    gap = F.greatest(F.lit(0), F.least(F.col("_lo"), start + size) - start).cast("int")
    b = b.select(
        *keys, "block_no", "block_start", "_lo",
        F.concat(F.array_repeat(F.lit(None).cast("double"), gap), part(start, start + size)).alias("samples"),
        part(F.lit(0), start).alias("before"),
        part(start + size, F.col("_hi")).alias("after"), own.alias("_own"),
    )
    return b.where("_own").drop("_lo", "_own")


def unpack(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """Blocks back to long rows ``(keep, sample_index, v)``; no shuffle."""
    return blocks.select(
        *keep, "block_start", F.posexplode("samples").alias("_p", "v")
    ).select(*keep, (F.col("block_start") + F.col("_p")).alias("sample_index"), "v")


def edges(blocks: DataFrame, keys: list[str], high: Callable[[Column], Column],
          initial_high_counts: bool = True, close_at_end: bool = False) -> DataFrame:
    """Level changes as rows ``(keys, sample_index, direction)``; direction is 1 up, -1 down.

    The edges are landed once: ordered operators read their input twice, and edges are few where
    samples are many.

    The level before a block comes from its halo; where the samples before it are missing, it is that of the
    block's own first sample. A recording that starts high has an edge at 0 only when ``initial_high_counts``. ``close_at_end`` adds a falling edge at ``n`` when the
    recording ends high.
    """
    def level(x: Column) -> Column:
        return F.when(high(x), F.lit(1)).otherwise(F.lit(0))

    first = F.lit(0) if initial_high_counts else level(F.element_at("samples", 1))
    prior = (F.when(F.size("before") > 0, level(F.element_at("before", -1))).when(F.col("block_start") == 0, first)
             .otherwise(level(F.element_at("samples", 1))))
    b = blocks.select(
        *keys, "block_start", F.size("samples").alias("_n"), F.size("after").alias("_after"),
        F.transform("samples", level).alias("_lv"), prior.alias("_prior"),
    )
    shifted = F.concat(F.array("_prior"), F.slice("_lv", F.lit(1), F.col("_n") - 1))
    steps = F.filter(
        F.transform(F.zip_with("_lv", shifted, lambda a, p: a - p),
                    lambda d, p: F.struct(d.alias("d"), p.alias("p"))),
        lambda s: s["d"] != 0,
    )
    if close_at_end:
        ends_high = (F.col("_after") == 0) & (F.element_at("_lv", -1) == 1)
        tail = F.array(F.struct(F.lit(-1).alias("d"), F.col("_n").alias("p")))
        steps = F.when(ends_high, F.concat(steps, tail)).otherwise(steps)
    found = b.select(*keys, "block_start", F.explode(steps).alias("_e")).select(
        *keys, (F.col("block_start") + F.col("_e.p")).alias("sample_index"),
        F.col("_e.d").alias("direction"),
    )
    return materialise(found, "edges")


def runs(blocks: DataFrame, keys: list[str], high: Callable[[Column], Column]) -> DataFrame:
    """Maximal runs of high samples as ``(keys, onset, offset)``, offset exclusive.

    Edges alternate, so the edge after each rising one closes the run. Only edges are shuffled.
    """
    e = edges(blocks, keys, high, close_at_end=True)
    e = neighbour(e, keys, ["sample_index"], segment_of("sample_index"), {"sample_index": "offset"}, ahead=True)
    return e.where("direction = 1").select(*keys, F.col("sample_index").alias("onset"), "offset")


def _median_same(x: np.ndarray, kernel: int) -> np.ndarray:
    h = kernel // 2
    padded = np.pad(x, h, mode="symmetric") if x.size else x
    if not x.size:
        return x
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, kernel), axis=1)


def running_median(blocks: DataFrame, kernel: int, halo: int = HALO_SAMPLES) -> DataFrame:
    """Centred running median of odd width ``kernel``; recording ends repeat their edge sample
    outwards. Needs ``halo >= kernel // 2 + 1``. Returns blocks with a narrower halo."""
    h = kernel // 2
    if kernel % 2 == 0 or halo < h + 1:
        raise ValueError("kernel must be odd and the halo at least kernel // 2 + 1")

    keep = [c for c in blocks.columns if c not in ("samples", "before", "after")]
    arrays = ["samples", "before", "after"]

    def smooth(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: list[list[np.ndarray]] = [[], [], []]
            for i in range(batch.num_rows):
                s, b, a = (col[c][i].values.to_numpy(zero_copy_only=False).astype(float) for c in arrays)
                y = _median_same(np.concatenate([b, s, a]), kernel)
                # A full halo means that the outermost values lack their own neighbours: drop them.
                lo = h if len(b) >= halo else 0
                hi = len(y) - (h if len(a) >= halo else 0)
                nb, ns = len(b), len(s)
                for o, part in zip(out, (y[nb:nb + ns], y[lo:nb], y[nb + ns:hi])):
                    o.append(part)
            yield pa.RecordBatch.from_arrays([*[col[c] for c in keep], *[pa.array(o, pa.list_(pa.float64())) for o in out]], names=[*keep, *arrays])

    # A step of its own, not a column expression: filters behind it must not pull it in front of a join.
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keep).schema)
    return blocks.select(*keep, *arrays).mapInArrow(smooth, f"{ddl}, samples array<double>, before array<double>, after array<double>")
