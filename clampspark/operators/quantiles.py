"""Exact quantiles of groups of any size."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import BLOCK_SAMPLES
from ..session import materialise
from .intervals import samples_in
from .ordered import null_safe_join, running

PER_OCTAVE = 4096
_NAN = (1 << 62) + 1
_INF = 1 << 62


def _grid(x: Column) -> Column:
    return (F.log2(F.abs(x)) + 1100) * PER_OCTAVE


def _bucket(x: Column) -> Column:
    """Order-preserving bucket of a double: 4,096 per factor of two, so about 0.02 % wide."""
    mag = F.floor(_grid(x)).cast("bigint") + 1
    return (
        F.when(F.isnan(x), F.lit(_NAN)).when(x == 0, F.lit(0).cast("bigint"))
        .when(F.abs(x) == float("inf"), F.when(x > 0, F.lit(_INF)).otherwise(F.lit(-_INF)))
        .when(x > 0, mag).otherwise(-mag)
    )


def _part(x: Column) -> Column:
    """Order-preserving part of a value's bucket, one of 65,536."""
    part = F.floor((_grid(x) - F.floor(_grid(x))) * 65536).cast("bigint")
    finite = (x != 0) & (F.abs(x) != float("inf"))
    return F.when(finite, F.when(x > 0, part).otherwise(-part)).otherwise(F.lit(0).cast("bigint"))


def _wanted(hist: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Counts per bucket -> the buckets that hold wanted ranks: ``_b, _from, n, _bad, _asked``."""
    real = F.col("_b") != _NAN
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(
        *keys, "_b", (F.sum("_c").over(upto) - F.col("_c")).alias("_from"), F.sum("_c").over(upto).alias("_to"),
        F.sum(F.when(real, F.col("_c"))).over(per_key).alias("n"), F.max(~real).over(per_key).alias("_bad"))
    asked = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        for rank in (F.floor(pos), F.ceil(pos)):
            asked.append(F.struct(F.lit(name).alias("name"), pos.alias("pos"), rank.alias("rank")))
    mine = F.filter(F.array(*asked), lambda a: (a["rank"] >= F.col("_from")) & (a["rank"] < F.col("_to")))
    return hist.where(real & F.col("n").isNotNull()).select(*keys, "_b", "_from", "n", "_bad", F.array_distinct(mine).alias("_asked")).where(F.size("_asked") > 0)


def _picked(near: DataFrame, hits: DataFrame, keys: list[str], probs: dict[str, float], skip_nan: bool) -> DataFrame:
    """Quantiles from the values ``near(keys, _b, _x, _c)`` of the wanted buckets."""
    near = running(near, [*keys, "_b"], ["_x"], _part(F.col("_x")), {"_cum": ("sum", F.col("_c"))})
    near = null_safe_join(near, hits, [*keys, "_b"]).withColumn("_end", F.col("_from") + F.col("_cum"))
    got = F.filter("_asked", lambda a: (a["rank"] >= F.col("_end") - F.col("_c")) & (a["rank"] < F.col("_end")))
    found = near.select(*keys, "_x", "n", "_bad", F.explode(got).alias("_a"))
    ok = F.lit(True) if skip_nan else ~F.max("_bad")
    out = []
    for name in probs:
        here = F.col("_a.name") == name
        low = F.min(F.when(here, F.struct(F.col("_a.rank"), F.col("_x"))))
        high = F.max(F.when(here, F.struct(F.col("_a.rank"), F.col("_x"))))
        share = F.max(F.when(here, F.col("_a.pos"))) - low["rank"]
        out.append(F.when(ok, low["_x"] + (high["_x"] - low["_x"]) * share).alias(name))
    return found.groupBy(*keys).agg(*out, F.max("n").alias("n"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    skip_nan: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per key: ``keys``, one column per name in ``probs``, and
    ``n``. A NaN makes the result null unless ``skip_nan``; a null key is a key like any other.

    One way for groups of any size, and no group is held in one task. Equal values collapse before
    the first shuffle. A histogram per key over order-preserving buckets tells which buckets hold the
    wanted ranks; only their values are ordered, a bucket in up to 65,536 parts, so a crowded one
    does not fall to one task.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    d = d.withColumn("_b", _bucket(F.col("_x"))).groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_c"))
    hits = _wanted(d.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")), keys, probs)
    near = null_safe_join(d, hits.select(*keys, "_b"), [*keys, "_b"])
    return _picked(near, hits, keys, probs, skip_nan)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median",
                 skip_nan: bool = False) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, skip_nan).select(*keys, name)


def window_medians(blocks: DataFrame, windows: DataFrame, keys: list[str], group: list[str], name: str,
                   size: int = BLOCK_SAMPLES, start: str = "start", end: str = "end",
                   prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Median of the samples in each window; ``group`` identifies a window. A NaN inside makes it null.

    One way for windows of any length: the blocks a window meets are counted by bucket where they lie, the bucket that holds the
    middle travels back to them with the window, and only its values are put in order. ``windows`` is read twice: land it first.
    ``prepare`` as in :func:`slices`.
    """
    ident = list(dict.fromkeys([*keys, *group]))
    w = windows.select(*ident, *[c for c in (start, end) if c not in ident])

    def bucketed(wanted: DataFrame) -> DataFrame:
        s = samples_in(blocks, wanted, keys, size, start, end, prepare).where("v IS NOT NULL")
        return s.withColumn("_x", F.col("v").cast("double")).withColumn("_b", _bucket(F.col("_x")))

    hits = materialise(_wanted(bucketed(w).groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c")), group, {name: 0.5}), "middle-buckets")
    targets = hits.groupBy(*group).agg(F.collect_set("_b").alias("_bs"))  # two at most
    near = bucketed(null_safe_join(w, targets, group)).where(F.array_contains("_bs", F.col("_b")))
    near = near.groupBy(*group, "_b", "_x").agg(F.count(F.lit(1)).alias("_c"))
    return _picked(near, hits, group, {name: 0.5}, False).select(*group, name)
