"""The stored block table: blocks bucketed by (keys, block), and the extremes of their nodes.

``land`` writes two tables. ``blocks`` is bucketed by the join key of every interval join, so a small table of windows,
thresholds or lengths travels to the samples and the samples stay where they are. ``nodes`` holds one row per aligned run of
2^level blocks (level 0: one block): a few numbers that answer questions about whole blocks without opening them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import BLOCK_SAMPLES
from .ordered import null_safe_join

BUCKETS = "buckets"  # metadata of block_no
TOP_LEVEL = 40       # 2^40 blocks: beyond any recording


def _marked(buckets: int) -> Column:
    return F.col("block_no").cast("bigint").alias("block_no", metadata={BUCKETS: buckets})


def bucket_count(blocks: DataFrame) -> int | None:
    """Number of buckets of a stored block table, also of one derived from it by column expressions."""
    return blocks.schema["block_no"].metadata.get(BUCKETS)


def beside(small: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``small`` laid out like the stored ``blocks``, as the side a join builds its table from: only ``small`` is shuffled."""
    n = bucket_count(blocks)
    return small if n is None else small.repartition(n, *keys, "block_no").hint("shuffle_hash")


def attach(blocks: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the columns of ``small(keys, block_no, ...)``; blocks without a row there are left out."""
    return blocks.join(beside(small, blocks, keys), [*keys, "block_no"])


EXTREMES = {"lo": "double", "lo_at": "bigint", "hi": "double", "hi_at": "bigint", "nan_at": "bigint", "n": "bigint", "n_good": "bigint"}


def _extremes(x: np.ndarray, off: np.ndarray, start: np.ndarray) -> dict[str, pa.Array]:
    """Extremes of each stretch ``x[off[i]:off[i + 1]]`` (none is empty), whose first index is ``start[i]``."""
    size = np.diff(off)
    at = np.arange(len(x)) - np.repeat(off[:-1] - start, size)
    good, far = ~np.isnan(x), np.iinfo(np.int64).max
    n = np.add.reduceat(good.astype(np.int64), off[:-1])
    lo = np.minimum.reduceat(np.where(good, x, np.inf), off[:-1])
    hi = np.maximum.reduceat(np.where(good, x, -np.inf), off[:-1])

    def first(hit: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(hit, at, far), off[:-1])

    none = n == 0
    return {"lo": pa.array(lo, mask=none), "lo_at": pa.array(first(good & (x == np.repeat(lo, size))), mask=none),
            "hi": pa.array(hi, mask=none), "hi_at": pa.array(first(good & (x == np.repeat(hi, size))), mask=none), "n": pa.array(size), "n_good": pa.array(n)}


def array_extremes(df: DataFrame, ident: list[str], start: str, samples: str) -> DataFrame:
    """``ident`` and the ``EXTREMES`` of each row's array, whose first value has index ``start``; rows without values are left out.

    NaN and missing samples are no extremes; ``nan_at`` is the first NaN. One pass over each Arrow batch.
    """
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ident).schema] + [f"{k} {t}" for k, t in EXTREMES.items()]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            values = column["_s"].flatten()
            off = column["_s"].offsets.to_numpy().astype(np.int64)
            x = values.to_numpy(zero_copy_only=False).astype(float)
            out = _extremes(x, off - off[0], column["_at"].to_numpy(zero_copy_only=False).astype(np.int64))
            nan = np.isnan(x) & values.is_valid().to_numpy(zero_copy_only=False)
            at = np.arange(len(x)) - np.repeat(off[:-1] - off[0] - column["_at"].to_numpy(zero_copy_only=False), np.diff(off))
            first = np.minimum.reduceat(np.where(nan, at, np.iinfo(np.int64).max), off[:-1] - off[0])
            out["nan_at"] = pa.array(first, mask=first == np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([column[c] for c in ident] + [out[k] for k in EXTREMES], names=[*ident, *EXTREMES])

    src = df.select(*ident, F.col(start).cast("bigint").alias("_at"), F.col(samples).cast("array<double>").alias("_s")).where(F.size("_s") > 0)
    return src.mapInArrow(run, ", ".join(types))


def _node(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Level 0: the extremes of each block, and the sample before it."""
    prior = F.when(F.size("before") > 0, F.element_at("before", -1)).alias("prior")
    z = array_extremes(blocks.withColumn("prior", prior), [*keys, "block_no", "block_start", "prior"], "block_start", "samples")
    return z.withColumn("level", F.lit(0)).withColumnRenamed("block_no", "node")


def fold(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Extremes of the union of nodes or of single samples: the value and its first index."""
    low = F.min(F.when(F.col("lo").isNotNull(), F.struct(F.col("lo").alias("v"), F.col("lo_at").alias("i"))))
    high = F.max(F.when(F.col("hi").isNotNull(), F.struct(F.col("hi").alias("v"), (-F.col("hi_at")).alias("i"))))
    g = nodes.groupBy(*group).agg(low.alias("_lo"), high.alias("_hi"), F.min("nan_at").alias("nan_at"), F.sum("n").alias("n"), F.sum("n_good").alias("n_good"))
    return g.select(*group, F.col("_lo.v").alias("lo"), F.col("_lo.i").alias("lo_at"), F.col("_hi.v").alias("hi"), (-F.col("_hi.i")).alias("hi_at"), "nan_at", "n", "n_good")


@dataclass(frozen=True)
class Store:
    """A landed block table. ``size`` is the block length."""
    blocks: DataFrame
    nodes: DataFrame
    keys: list[str]
    size: int

    def zones(self) -> DataFrame:
        """One row per block, without its samples."""
        return self.nodes.where("level = 0").withColumnRenamed("node", "block_no")

    def swing(self) -> DataFrame:
        """Lowest and highest value and number of samples per key."""
        return fold(self.zones(), self.keys).select(*self.keys, "lo", "hi", F.col("n").alias("n_samples"))

    def lengths(self) -> DataFrame:
        return self.zones().groupBy(*self.keys).agg(F.max(F.col("block_start") + F.col("n")).alias("n_samples"))

    def per_block(self, per_key: DataFrame, extra: list[Column] = ()) -> DataFrame:
        """A per-key table spread over the key's blocks: small rows, fit to be attached to them."""
        return null_safe_join(self.zones().select(*self.keys, "block_no", *extra), per_key, self.keys)


def land(blocks: DataFrame, path: str, keys: list[str], size: int = BLOCK_SAMPLES, buckets: int | None = None) -> Store:
    """Write ``blocks`` (as packed) and their nodes below ``path``. One shuffle of the blocks, the last they ever see."""
    n = buckets or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = blocks.repartition(n, *keys, "block_no").withColumn("block_no", _marked(n))
    columns = [*keys, "block_no"]
    marked.write.bucketBy(n, *columns).option("path", f"{path}/blocks").saveAsTable(f"blocks_{uuid.uuid4().hex}")
    spark = blocks.sparkSession
    kinds = marked.schema
    _node(spark.read.schema(kinds).parquet(f"{path}/blocks"), keys).write.parquet(f"{path}/zones")
    zones = spark.read.parquet(f"{path}/zones")
    # Each block counts in one node of every level up to the highest its recording needs.
    top = zones.groupBy(*keys).agg(F.max("node").alias("_last"))
    levels = F.sequence(F.lit(1), F.least(F.ceil(F.log2(F.col("_last") + 1)), F.lit(TOP_LEVEL)).cast("int"))
    up = null_safe_join(zones, top.where("_last > 0"), keys).select("*", F.explode(levels).alias("_level"))
    up = up.withColumn("node", _shr(F.col("node"), F.col("_level"))).withColumn("level", F.col("_level"))
    up = fold(up, [*keys, "level", "node"])
    zones.unionByName(up, allowMissingColumns=True).write.parquet(f"{path}/nodes")
    return Store(attached(spark, path, kinds, keys, n), spark.read.parquet(f"{path}/nodes"), keys, size)


def attached(spark: SparkSession, path: str, schema, keys: list[str], buckets: int) -> DataFrame:
    """The bucketed files below ``path`` as a table of this session."""
    name = f"blocks_{uuid.uuid4().hex}"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in [*keys, "block_no"])
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/blocks'")
    return spark.table(name).withColumn("block_no", _marked(buckets))


def open_store(spark: SparkSession, path: str, keys: list[str], size: int = BLOCK_SAMPLES) -> Store:
    """A store landed by another session; the number of buckets is in the files' schema."""
    schema = spark.read.parquet(f"{path}/blocks").schema
    n = schema["block_no"].metadata[BUCKETS]
    return Store(attached(spark, path, schema, keys, n), spark.read.parquet(f"{path}/nodes"), keys, size)


# ---- extremes of any window ------------------------------------------------------------------

def _shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _cover(size: int) -> tuple[Column, Column]:
    """First and last (exclusive) whole block of a window; the recording's last block is whole to its end."""
    a = F.ceil(F.col("start") / size).cast("bigint")
    b = F.when(F.col("end") >= F.col("n_samples"), F.ceil(F.col("n_samples") / size)).otherwise(F.floor(F.col("end") / size)).cast("bigint")
    return a, b


def extremes(store: Store, windows: DataFrame, group: list[str]) -> DataFrame:
    """Extremes of the samples in each window, as :func:`fold` gives them; ``group`` names a window. A window without samples has no row.

    ``windows`` has ``keys, group, start, end, n_samples`` (half open, ``n_samples`` the recording's). A window is cut into at most two
    nodes per level and at most two parts of single blocks; only those blocks are opened, and nothing of them but their extremes is shuffled.
    """
    from .intervals import slices
    keys, size = store.keys, store.size
    ident = list(dict.fromkeys([*keys, *group]))
    w = windows.select(*ident, "start", F.least("end", "n_samples").alias("end"), "n_samples").where("end > start")
    a, b = _cover(size)
    w = w.withColumn("_a", a).withColumn("_b", b)
    whole = w.where("_a < _b").select(*ident, "_a", "_b", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int"))).alias("level"))

    def up(x: Column, level: Column) -> Column:
        return _shr(x + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1, level)

    one = F.lit(1)
    lo, hi = up(F.col("_a"), F.col("level")), _shr(F.col("_b"), F.col("level"))
    lo2, hi2 = up(F.col("_a"), F.col("level") + one) * 2, _shr(F.col("_b"), F.col("level") + one) * 2
    # Nodes of this level that no node of the next level covers.
    spans = F.when(hi2 > lo2, F.array(F.struct(lo.alias("a"), lo2.alias("b")), F.struct(hi2.alias("a"), hi.alias("b")))).otherwise(F.array(F.struct(lo.alias("a"), hi.alias("b"))))
    mine = F.flatten(F.transform(F.filter(spans, lambda s: s["b"] > s["a"]), lambda s: F.sequence(s["a"], s["b"] - 1)))
    wanted = whole.select(*ident, "level", F.explode(mine).alias("node"))
    fields = ["lo", "lo_at", "hi", "hi_at", "nan_at", "n", "n_good"]
    top = null_safe_join(wanted, store.nodes.select(*keys, "level", "node", *fields), [*keys, "level", "node"]).select(*ident, *fields)

    ragged = F.when(F.col("_a") >= F.col("_b"), F.array(F.struct(F.col("start").alias("a"), F.col("end").alias("b")))).otherwise(F.array(
        F.struct(F.col("start").alias("a"), (F.col("_a") * size).alias("b")), F.struct((F.col("_b") * size).alias("a"), F.col("end").alias("b"))))
    edge = w.select(*ident, F.explode(ragged).alias("_r")).select(*ident, F.col("_r.a").alias("start"), F.col("_r.b").alias("end"))
    s = slices(store.blocks, edge, keys, size)
    raw = array_extremes(s, ident, "part_start", "part")
    return fold(top.unionByName(raw), ident)
