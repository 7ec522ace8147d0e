"""Interval and as-of joins without nested loops."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BLOCK_SAMPLES
from ..session import materialise
from .ordered import running, segment_of
from .store import attach


def slices(blocks: DataFrame, windows: DataFrame, keys: list[str], size: int = BLOCK_SAMPLES,
           start: str = "start", end: str = "end", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Range join of blocks with half-open windows.

    A window is spread over the blocks it touches and joined on ``(keys, block_no)``, so one long
    recording is spread too. On a stored block table only the windows are shuffled. Yields the window's columns
    with ``part_start`` and ``part``, the samples shared by block and window. ``prepare`` is applied to the blocks that
    are met, halos included (a filter, say), after the join: a Python step before it would hide how they are stored.
    """
    w = windows.where(F.col(end) > F.col(start)).withColumn(
        "block_no",
        F.explode(F.sequence(F.floor(F.col(start) / size).cast("bigint"),
                             F.floor((F.col(end) - 1) / size).cast("bigint"))),
    )
    halos = ["before", "after"] if prepare else []
    b = blocks.select(*keys, "block_no", "block_start", "samples", *halos)
    lo = F.greatest(F.col(start), F.col("block_start"))
    hi = F.least(F.col(end), F.col("block_start") + F.size("samples"))
    j = attach(b, w, keys)
    if prepare:
        j = prepare(j)
    j = j.withColumn("part_start", lo).withColumn("_len", (hi - lo).cast("int")).where("_len > 0")
    part = F.slice("samples", (F.col("part_start") - F.col("block_start") + 1).cast("int"),
                   F.greatest(F.col("_len"), F.lit(0)))
    return j.select(*windows.columns, "part_start", part.alias("part"))


def samples_in(blocks: DataFrame, windows: DataFrame, keys: list[str], size: int = BLOCK_SAMPLES,
               start: str = "start", end: str = "end", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Long form of :func:`slices`: the window's columns with ``sample_index`` and ``v``."""
    s = slices(blocks, windows, keys, size, start, end, prepare)
    return s.select(*windows.columns, "part_start", F.posexplode("part").alias("_p", "v")).select(
        *windows.columns, (F.col("part_start") + F.col("_p")).alias("sample_index"), "v"
    )


def merge_overlaps(windows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of half-open windows per key as disjoint ``(keys, start, end)``."""
    w = windows.where(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end))
    seg = segment_of(start)
    w = materialise(running(w, keys, [start], seg, {"_reach": ("max", F.col(end))}, inclusive=False), "reach")
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    w = running(w.withColumn("_fresh", fresh), keys, [start], seg, {"_head": ("last", F.col("_fresh"))})
    return w.groupBy(*keys, "_head").agg(F.max(end).alias(end)).select(
        *keys, F.col("_head").alias(start), end
    )


def _side_by_side(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str,
                  point_rank: int) -> DataFrame:
    p = points.select(
        *keys, F.col(point).alias("_at"), F.lit(point_rank).alias("_rank"),
        F.struct(*points.columns).alias("_point"), F.lit(None).cast(marks.select(F.struct(*marks.columns)).schema[0].dataType).alias("_mark"),
    )
    m = marks.select(
        *keys, F.col(mark).alias("_at"), F.lit(1 - point_rank).alias("_rank"),
        F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"), F.struct(*marks.columns).alias("_mark"),
    )
    return p.unionByName(m)


def latest_before(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str,
                  tie: Column, keep: list[str], segment: Column | None = None) -> DataFrame:
    """As-of join: each point gets the latest mark with ``mark <= point``, nulls if none. Of
    several marks at one position the one with the smallest ``tie`` wins."""
    cols = [c for c in marks.columns if c not in keys]
    m = marks.groupBy(*keys, F.col(mark).alias("_m")).agg(F.min_by(F.struct(*cols), tie).alias("_s"))
    m = m.select(*keys, "_s.*")
    u = _side_by_side(points, m, keys, point, mark, point_rank=1)
    # Points may coincide; each of them only reads marks, so their mutual order is free.
    u = running(u, keys, ["_at", "_rank"], segment if segment is not None else segment_of("_at"),
                {"_hit": ("last", F.col("_mark"))})
    return u.where("_point is not null").select("_point.*", *[F.col(f"_hit.{c}").alias(c) for c in keep])


def first_at_or_after(points: DataFrame, marks: DataFrame, keys: list[str], point: str, mark: str,
                      keep: list[str], segment: Column | None = None) -> DataFrame:
    """Forward as-of join: each point gets the first mark with ``mark >= point``, nulls if none."""
    u = _side_by_side(points, marks, keys, point, mark, point_rank=0)
    u = running(u, keys, ["_at", "_rank"], segment if segment is not None else segment_of("_at"),
                {"_hit": ("last", F.col("_mark"))}, reverse=True)
    return u.where("_point is not null").select("_point.*", *[F.col(f"_hit.{c}").alias(c) for c in keep])
