"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source stands in a shuffled queue, once per pass over the source. Its virtual finish time is the
number of the source's words up to its end, divided by the source's target. Copies are taken in order of finish time
until the total budget is reached.

No window spans a whole source: a queue is cut into segments by the leading part of the shuffle hash, the window runs
within (source, segment), and segment totals give the carry. The global order is cut the same way: words are summed
per slice of finish time, and only the slice in which the budget ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clampspark.session import materialise

WORD = r"[^\\x20\\x09-\\x0D]+"
SEGMENT_ROWS = 20_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``; null text has no words."""
    return docs.select("doc_id", "source", F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long").alias("size"))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, ...)`` -> with ``target``: shares by weight, none above ``most`` x its size.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. With sources ordered by cap per weight, the
    first ones are capped until one fits under the common level: one row per source, two windows, no iteration.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy(F.lit(0))
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(after),
        "budget": F.lit(float(share)) * F.sum("source_size").over(total)})
    level = (F.col("budget") - F.col("capped")) / F.col("left")
    # The level is that of the first source, in this order, that stays under its cap.
    s = s.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(total))
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select(
        "source", "source_size", "weight", "target", "budget")


def _cumulate(rows: DataFrame, keys: list[str], segment: str, order: list, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` within ``keys`` in (segment, order), by segments. Null-safe in the keys."""
    part = Window.partitionBy(*keys, segment)
    inner = rows.withColumn("_in", F.sum(value).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    total = rows.groupBy(*keys, segment).agg(F.sum(value).alias("_seg"))
    carry = total.withColumn("_carry", F.sum("_seg").over(Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_seg"))
    on = None
    for k in [*keys, segment]:
        one = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = one if on is None else on & one
    j = inner.alias("l").join(carry.alias("r"), on)
    return j.select("l.*", (F.col("r._carry") + F.col("l._in")).alias(out)).drop("_in")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``(doc_id, source, size, source_size, target, taken, copies)``, one row per input row.

    A null source is a source of its own, last in order; null or blank text has size 0 and is taken 0 times. Repeated rows
    are separate documents. The order within a source is a seeded hash of (doc_id, size); ties go by doc_id, nulls first, and
    rows that agree in both are interchangeable, so reruns agree. An empty table gives an empty result. Totals stay within one
    document of the budget, a source's within one of its documents of its target.
    """
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")
    base = materialise(sizes(docs).withColumn("h", h), "sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    biggest = per_source.agg(F.max("n")).first()[0] or 0
    bits = min(24, max(5, (int(biggest) // SEGMENT_ROWS).bit_length()))
    goals = materialise(targets(per_source.select("source", "source_size"), weights, share, most), "targets")
    queue = base.withColumn("segment", F.shiftrightunsigned("h", 64 - bits))
    queue = _cumulate(queue, ["source"], "segment", ["h", F.col("doc_id").asc_nulls_first()], "size", "reached")
    queue = queue.alias("l").join(goals.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(
        "l.doc_id", "l.source", "l.size", "l.h", "l.reached", "r.source_size", "r.target", "r.budget")
    queue = materialise(queue, "queue")

    copies = queue.where("size > 0").select("source", "h", "size", "target", "source_size", "reached", "budget",
                                            F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"))
    copies = copies.withColumn("finish", _finish(F.col("turn")))
    slices = 1 << (bits + 8)
    copies = copies.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(8 * slices)))
    filled = copies.groupBy("slice").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    filled = _cumulate(filled.withColumn("block", F.floor(F.col("slice") / 4096)).withColumn("all", F.lit(0)), ["all"], "block", ["slice"], "words", "upto")
    full = filled.where("upto > budget").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"), "budget"), "slice").alias("c")).first()["c"]
    if full is None:  # everything fits
        copy_count = F.when(F.col("size") > 0, F.lit(most)).otherwise(F.lit(0))
    else:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last())
        upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(int(full["before"]))
        first_out = copies.where(F.col("slice") == full["slice"]).select("finish", "source", upto.alias("upto")).where(
            F.col("upto") > F.lit(float(full["budget"]))).agg(F.min_by(F.struct("finish", "source"), "upto").alias("c")).first()["c"]
        # In order of (finish, source), null source last, all copies before the first one that does not fit are taken.
        s = first_out["source"]
        sooner = F.col("source").isNotNull() if s is None else F.coalesce(F.col("source") < F.lit(s), F.lit(False))
        copy_count = sum((F.when(_finish(F.lit(t)) < first_out["finish"], 1).when((_finish(F.lit(t)) == first_out["finish"]) & sooner, 1).otherwise(0)
                          for t in range(most)), F.lit(0))
        copy_count = F.when(F.col("size") > 0, copy_count).otherwise(F.lit(0))
    out = queue.withColumn("copies", copy_count)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _finish(turn):
    """Virtual finish time of a document's copy in pass ``turn``."""
    return (F.col("reached") + turn * F.col("source_size")) / F.col("target")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns unchanged, whatever their names, each as often as the mix takes it.

    Rows that agree in doc_id, source and size share their copies, in order of text. Null doc_ids and sources are values like any other; an empty table stays empty.
    """
    # Keys without nulls, in plain equality, deal out the documents once for the join and the window.
    keys = {"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "no_id": F.col("doc_id").isNull(),
            "of": F.coalesce(F.col("source").cast("string"), F.lit("")), "no_source": F.col("source").isNull(), "size": F.col("size")}
    key = [c.alias(k) for k, c in keys.items()]
    plan = mix(docs, **options).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    size = F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long")
    # The caller's columns travel as one, so none of their names can meet one of these.
    rows = docs.select("doc_id", "source", size.alias("size"), F.struct(*[F.col(c) for c in docs.columns]).alias("whole")).select(*key, "whole")
    j = rows.join(plan, list(keys))
    j = j.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("whole.text")))
    n = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("place") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    j = j.select("whole", n.cast("int").alias("n")).where("n > 0")
    return j.select("whole", F.explode(F.sequence(F.lit(1), F.col("n")))).select("whole.*")
