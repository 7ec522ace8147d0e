"""Ordered operators that never put a whole recording into one task.

A plain window over ``(recording)`` would sort all of a recording's rows in a single task. Here
the rows of a key are cut into segments (any expression that grows with the order columns). The
window runs inside ``(key, segment)``; one summary row per segment is scanned per key; the result
of that scan is joined back on ``(key, segment)``. Rows travel once, and the only per-key task
handles one row per segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

# Samples per segment: about 52 s at 20 kHz. A month of one recording has about 50,000 segments.
SEGMENT_SAMPLES = 1 << 20
# A key of no more rows is one task's work.
WHOLE_ROWS = 1 << 20


def segment_of(index: str | Column, size: int = SEGMENT_SAMPLES) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return F.floor(c / size).cast("bigint")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which null equals null; the keys come once, from ``left``."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    segment: Column,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Add running aggregates per key.

    ``values`` maps an output name to ``(how, expression)``; ``how`` is ``sum``, ``max``, ``min``
    or ``last`` (last non-null). ``reverse`` runs from the end, so ``last`` becomes "next".
    ``order`` must be unique within a key.
    """
    keys = list(keys)
    d = df.select("*", segment.alias("_seg"), *[expr.alias(f"_v_{n}") for n, (_, expr) in values.items()])
    sort = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]
    inner = (
        Window.partitionBy(*keys, "_seg").orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    seg_sort = F.col("_seg").desc() if reverse else F.col("_seg").asc()
    outer = Window.partitionBy(*keys).orderBy(seg_sort).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[F.col(o) for o in order])
    pick = F.min_by if reverse else F.max_by
    fold = {"sum": F.sum, "max": F.max, "min": F.min}

    summary, carried, local, out = [], [], [], []
    for n, (how, _) in values.items():
        v, loc, car = F.col(f"_v_{n}"), F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if how == "last":
            summary.append(pick(v, F.when(v.isNotNull(), place)).alias(f"_s_{n}"))
            carried.append(F.last(f"_s_{n}", ignorenulls=True).over(outer).alias(f"_c_{n}"))
            local.append(F.last(v, ignorenulls=True).over(inner).alias(f"_l_{n}"))
            out.append(F.coalesce(loc, car).alias(n))
            continue
        summary.append(fold[how](v).alias(f"_s_{n}"))
        carried.append(fold[how](F.col(f"_s_{n}")).over(outer).alias(f"_c_{n}"))
        local.append(fold[how](v).over(inner).alias(f"_l_{n}"))
        if how == "sum":
            out.append((F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))).alias(n))
        else:
            out.append((F.greatest if how == "max" else F.least)(loc, car).alias(n))

    carry = d.groupBy(*keys, "_seg").agg(*summary).select(*keys, "_seg", *carried)
    inside = d.select(*df.columns, "_seg", *local).alias("_in")
    # A null key (or segment) is a key like any other.
    carry = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_seg"])], *[f"_c_{n}" for n in values])
    on = [F.col(f"_in.{k}").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_seg"])]
    return inside.join(carry, reduce(and_, on), "left").select(*[F.col(f"_in.{c}") for c in df.columns], *out)


def running_by_size(df: DataFrame, keys: list[str], order: list[str], segment: Column, values: dict[str, tuple[str, Column]], inclusive: bool = True,
                    most: int = WHOLE_ROWS) -> DataFrame:
    """:func:`running` for tables of many keys with few rows each: rows of keys of at most ``most`` rows travel once, to one window per
    key; only those of larger keys go by segments. The keys are counted first, and there are few large ones."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = materialise(n.select(*keys), "large-keys")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}

    def whole(rows: DataFrame) -> DataFrame:
        out = rows.select("*", *[expr.alias(f"_v_{n}") for n, (_, expr) in values.items()])
        got = {n: fold[how](F.col(f"_v_{n}")).over(w) for n, (how, _) in values.items()}
        return out.select(*df.columns, *[(F.coalesce(c, F.lit(0)) if values[n][0] == "sum" else c).alias(n) for n, c in got.items()])

    if large.isEmpty():
        return whole(df)
    split = running(null_safe_join(df, large, keys, "left_semi"), keys, order, segment, values, inclusive)
    return whole(null_safe_join(df, large, keys, "left_anti")).unionByName(split)


def ordinal(df: DataFrame, keys: list[str], order: list[str], segment: Column, name: str) -> DataFrame:
    """Zero-based position of each row within its key."""
    return running(df, keys, order, segment, {name: ("sum", F.lit(1).cast("bigint"))}, inclusive=False)


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, cols: dict[str, str],
    ahead: bool,
) -> DataFrame:
    """Previous (or next) row's columns: ``cols`` maps a source column to its output name."""
    packed = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    out = running(df, keys, order, segment, {"_near": ("last", packed)}, inclusive=False, reverse=ahead)
    return out.select(*df.columns, *[F.col(f"_near.{n}").alias(n) for n in cols.values()])


def join_small(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, n: int = 16,
               how: str = "inner") -> DataFrame:
    """Equi-join a per-key table to rows that may be dominated by one key.

    The optimizer still broadcasts ``small`` where its measured size allows. Where it does not, the
    hot key's rows spread over ``n`` tasks, each meeting its own copy of the per-key row.
    """
    b = big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(n)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")
