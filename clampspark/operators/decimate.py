"""Decimation for display: extremes are kept, volume is bounded by the column or bin count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .blocks import unpack
from .store import Store, attach, extremes


def minmax_decimate(store: Store, cap: int) -> DataFrame:
    """At most ``cap`` points per key: both extremes of each bin at their true index (of equal values the first; NaN counts as the highest).

    Keys with no more than ``cap`` samples pass unchanged. Otherwise ``cap // 2`` equal bins are
    used; the samples behind the last whole bin belong to it. Bins take whole nodes of the store and open only the blocks their borders cut.
    """
    keys, bins = store.keys, max(2, cap // 2)
    n = store.lengths()
    size = F.floor(F.col("n_samples") / bins).cast("bigint")
    wide = n.where(F.col("n_samples") > cap).select(*keys, "n_samples", size.alias("_w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    w = wide.select(*keys, "bin", "n_samples", (F.col("bin") * F.col("_w")).alias("start"),
                    F.when(F.col("bin") == bins - 1, F.col("n_samples")).otherwise((F.col("bin") + 1) * F.col("_w")).alias("end"))
    g = extremes(store, w, ["bin"])
    nan = F.lit(float("nan"))
    lo = F.struct(F.coalesce("lo_at", "nan_at").alias("sample_index"), F.when(F.col("lo").isNotNull(), F.col("lo")).otherwise(nan).alias("v"))
    hi = F.struct(F.coalesce("nan_at", "hi_at").alias("sample_index"), F.when(F.col("nan_at").isNotNull(), nan).otherwise(F.col("hi")).alias("v"))
    pairs = g.select(*keys, F.explode(F.array(lo, hi)).alias("_p")).where("_p.sample_index IS NOT NULL").select(*keys, "_p.sample_index", "_p.v")
    few = store.per_block(n.where(F.col("n_samples") <= cap).select(*keys))
    whole = attach(store.blocks.select(*keys, "block_no", "block_start", "samples"), few, keys)
    return unpack(whole, keys).unionByName(pairs)


def minmax_envelope(store: Store, columns: int) -> DataFrame:
    """Lowest and highest valid value in each of ``columns`` overlapping bins, null where none.

    Bin edges are ``n / columns`` apart; a bin reaches from the floor of its left edge to the
    ceiling of its right one, so a sample on a fractional edge counts in both neighbours.
    """
    c, n = F.col("column_no"), F.col("n_samples")
    grid = F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))
    full = store.lengths().select(*store.keys, "n_samples", F.explode(grid).alias("column_no"))
    # Edge c sits at c * (n / columns), multiplied in this order; the last edge is n itself.
    w = full.withColumn("start", F.floor(c * (n / columns))).withColumn("end", F.when(c == columns - 1, n).otherwise(F.least(F.ceil((c + 1) * (n / columns)), n)))
    g = extremes(store, w, ["column_no"]).select(*store.keys, "column_no", F.col("lo").alias("col_min"), F.col("hi").alias("col_max"))
    return full.drop("n_samples").join(g, [*store.keys, "column_no"], "left")


def stride(samples: DataFrame, k: int, limit: int | None = None) -> DataFrame:
    """Every ``k``-th sample, optionally only of the first ``limit``; both are plain predicates."""
    s = samples if limit is None else samples.where(F.col("sample_index") < limit)
    return s.where(F.col("sample_index") % k == 0)


def padded_range(samples: DataFrame, keys: list[str], pad: float = 0.08) -> DataFrame:
    """Value range with a margin on both sides, NaN ignored."""
    valid = F.when(~F.isnan("v"), F.col("v"))
    g = samples.groupBy(*keys).agg(F.min(valid).alias("lo"), F.max(valid).alias("hi"))
    m = (F.col("hi") - F.col("lo")) * pad
    return g.select(*keys, (F.col("lo") - m).alias("y_lo"), (F.col("hi") + m).alias("y_hi"))
