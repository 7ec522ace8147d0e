"""Raw scans and sinks: data derived from the tables is written, then read back."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clampspark.operators.blocks import unpack
from clampspark.session import scratch_path
from clampspark.sources import rawbin, tables
from . import query
from .views import KEY, blk, evt, sig, sig_blocks, sql

CHUNK, RAW_BLOCK, RAW_HALO, PIECE = 4, 16, 3, 1 << 20


def _write(path: str, data: np.ndarray) -> None:
    system, inner = rawbin.locate(path)
    with system.open_output_stream(inner) as f:
        f.write(np.ascontiguousarray(data, dtype="<f8").tobytes())


def raw_files(spark, d) -> str:
    """Chunk-interleaved files of five channels, ``v + channel``, one per recording and stretch."""
    path = scratch_path(spark, "raw")
    system, inner = rawbin.locate(path)
    system.create_dir(inner, recursive=True)

    def write(p: pd.DataFrame) -> pd.DataFrame:
        v = p.sort_values("sample_index")["v"].to_numpy()
        whole = len(v) // CHUNK * CHUNK
        body = np.stack([v[:whole] + c for c in range(5)]).reshape(5, -1, CHUNK).transpose(1, 0, 2).ravel()
        # Samples behind the last whole chunk become a partial tail of the file.
        _write(f"{path}/rec{p['recording_id'].iloc[0]}_{p['piece'].iloc[0]}.bin", np.concatenate([body, v[whole:]]))
        return pd.DataFrame({"n": [len(v)]})

    s = sig(spark, d).withColumn("piece", F.floor(F.col("sample_index") / PIECE))
    s.groupBy("recording_id", "piece").applyInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return path


RAW = dict(c="SELECT unnest(range(0, 5))::INTEGER AS channel_index")


@query("scan_rawbin", sql("sig len", """SELECT recording_id, channel_index, count(*) FILTER (WHERE sample_index < n_samples // 4 * 4) AS n, round(sum(v + channel_index) FILTER (WHERE sample_index < n_samples // 4 * 4), 6) AS total,
    max((n_samples % 4) * 8) AS tail_bytes FROM sig JOIN len USING (recording_id) CROSS JOIN c GROUP BY 1, 2""", **RAW))
def scan_rawbin(spark, d):
    files = rawbin.manifest(spark, raw_files(spark, d), 5, CHUNK)
    b = rawbin.scan(files, 5, RAW_BLOCK, CHUNK, RAW_HALO)
    recording = F.regexp_extract("path", r"/rec(\d+)_", 1).cast("bigint").alias("recording_id")
    s = unpack(b, ["path", "channel_index"]).select(recording, "channel_index", "v")
    g = s.groupBy("recording_id", "channel_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))
    # A recording may lie in several files; only its last one has a partial tail.
    return g.join(files.groupBy(recording).agg(F.sum("tail_bytes").alias("tail_bytes")), "recording_id")


@query("scan_trialbin", sql("bs", "SELECT recording_id, trial_index, c AS channel_index, count(*) AS n, round(sum(v * (c + 1)), 6) AS total FROM bs CROSS JOIN (SELECT unnest(range(0, 2))::INTEGER AS c) GROUP BY 1, 2, 3"))
def scan_trialbin(spark, d):
    path = scratch_path(spark, "trial-raw")
    system, inner = rawbin.locate(path)
    system.create_dir(inner, recursive=True)

    def write(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("trial_index")
        rows = [np.stack([np.asarray(s), np.asarray(s) * 2]) for s in p["samples"]]
        name = f"{path}/rec{p['recording_id'].iloc[0]}_{p['piece'].iloc[0]}.bin"
        _write(name, np.concatenate([r.ravel() for r in rows]))
        size = [r.nbytes for r in rows]
        return pd.DataFrame({"path": name, "trial_index": p["trial_index"].to_numpy(), "byte_offset": np.concatenate([[0], np.cumsum(size)[:-1]]), "n_samples": [r.shape[1] for r in rows]})

    from clampspark.session import materialise
    b = blk(spark, d).withColumn("piece", F.floor(F.col("trial_index") / 256))
    index = b.groupBy("recording_id", "piece").applyInPandas(write, "path string, trial_index bigint, byte_offset bigint, n_samples bigint")
    t = rawbin.scan_trials(materialise(index, "trial-index"), 2, 24)  # three blocks per trial and channel
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return t.groupBy(F.regexp_extract("path", r"/rec(\d+)_", 1).cast("bigint").alias("recording_id"), "trial_index", "channel_index").agg(
        F.sum(F.size("samples")).alias("n"), F.round(F.sum(total), 6).alias("total"))


@query("write_blocks", sql("sig", "SELECT recording_id, count(*) AS n, round(sum(v), 6) AS total, max(sample_index) AS last_index FROM sig GROUP BY 1"))
def write_blocks(spark, d):
    path = scratch_path(spark, "block-table")
    tables.write_blocks(sig_blocks(spark, d), path, KEY)
    s = unpack(spark.read.parquet(path), KEY)
    return s.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"), F.max("sample_index").alias("last_index"))


@query("event_append", sql("evt", "SELECT recording_id, event_type, count(*) AS n, min(sample_index) AS first_index, max(sample_index) AS last_index FROM evt GROUP BY 1, 2"))
def event_append(spark, d):
    """The event log as an append-only table: applies first, then clears."""
    path = scratch_path(spark, "event-log")
    e = evt(spark, d)
    for kind in ("apply", "clear"):
        tables.append_events(e.where(F.col("event_type") == kind), path)
    return spark.read.parquet(path).groupBy("recording_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_index").alias("first_index"), F.max("sample_index").alias("last_index"))
