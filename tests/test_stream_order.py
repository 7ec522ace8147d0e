"""Streams whose chunks come shuffled over several batches, twice, or not at all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clampspark.streaming import live
from clampspark.streaming.ordered import on_time, rejects

CHUNK = 5
T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def chunks():
    g = np.random.default_rng(3)
    x = {1: g.integers(0, 2, 103).astype(float), 2: g.integers(0, 2, 40).astype(float)}
    rows = [(r, 0, k // CHUNK, v[k:k + CHUNK].tolist(), k) for r, v in x.items() for k in range(0, len(v), CHUNK)]
    return x, rows


SCHEMA = "recording_id long, channel_index int, chunk_seq long, samples array<double>, ms long"


def stream(spark, tmp_path, batches):
    """One file and one micro-batch per list of rows."""
    d = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(d)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(d)
    return s.withColumn("ts", F.timestamp_millis("ms"))


def shuffled(rows, n, seed=1, twice=()):
    rng = random.Random(seed)
    rows = [*rows, *[r for r in rows if (r[0], r[2]) in twice]]
    rng.shuffle(rows)
    return [rows[k::n] for k in range(n)]


def test_edges_and_counts_over_shuffled_batches(spark, tmp_path, chunks):
    x, rows = chunks
    twice = {(1, 0), (1, 7), (2, 3)}
    s = stream(spark, tmp_path, shuffled(rows, 4, twice=twice))
    out = live.run_available(live.count_edges(s, 0.5), str(tmp_path / "edges"))
    got = {r.recording_id: r.n for r in on_time(out).groupBy("recording_id").agg(F.max("n_edges").alias("n")).collect()}
    assert got == {r: int((np.diff(np.concatenate([[0], v])) > 0).sum()) for r, v in x.items()}
    assert sorted((r.recording_id, r.chunk_seq, r.kind) for r in rejects(out).collect()) == [(1, 0, "late"), (1, 7, "late"), (2, 3, "late")]


def test_saved_samples_are_counted(spark, tmp_path, chunks):
    x, rows = chunks
    out = live.run_available(live.ingest(stream(spark, tmp_path, shuffled(rows, 3, 5))), str(tmp_path / "ingest"))
    last = {r.recording_id: r.n for r in on_time(out).groupBy("recording_id").agg(F.max("n_saved").alias("n")).collect()}
    assert last == {1: 103, 2: 40}
    assert all(r.n_saved == min((r.chunk_seq + 1) * CHUNK, len(x[r.recording_id])) for r in on_time(out).collect())


def test_alerts_keep_their_distance_over_batches(spark, tmp_path):
    level = [9, 1, 9, 9, 1, 1, 9, 9, 9, 1, 9]
    rows = [(1, 0, k, [float(v)], k) for k, v in enumerate(level)]
    s = stream(spark, tmp_path, shuffled(rows, 4, 2)).select("recording_id", "chunk_seq", F.col("samples")[0].cast("long").alias("available"))
    out = on_time(live.run_available(live.backlog_alerts(s, 5, 3, 10), str(tmp_path / "alerts")))
    assert sorted(r.sample_index for r in out.collect()) == [10, 40, 70, 110]


def test_a_gap_is_given_up_in_event_time(spark, tmp_path):
    rows = [(1, 0, k, [1.0] * 5, T0 + 1000 * k) for k in range(40) if k != 3]
    late = [(1, 0, 3, [1.0] * 5, T0 + 39_500)]
    s = stream(spark, tmp_path, [rows[:10], rows[10:30], rows[30:], [(9, 0, 0, [0.0], T0 + 120_000)], late, [(9, 0, 1, [0.0], T0 + 121_000)]])
    out = live.run_available(live.ingest(s, time="ts", grace_ms=2000), str(tmp_path / "gap"))
    mine = out.where("recording_id = 1")
    assert on_time(mine).agg(F.max("n_saved")).first()[0] == 39 * 5
    assert [(r.chunk_seq, r.kind) for r in rejects(mine).orderBy("kind").collect()][0] == (3, "gap")


def test_ring_view_over_shuffled_batches(spark, tmp_path, chunks):
    x, rows = chunks
    out = live.run_available(live.rolling_view(stream(spark, tmp_path, shuffled(rows, 4, 9)), 32, 3, CHUNK), str(tmp_path / "ring"))
    view = {r.recording_id: r.s for r in out.groupBy("recording_id").agg(F.max_by("samples", F.struct("last_chunk", F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.abs(v)))).alias("s")).collect()}
    for r, v in x.items():
        assert view[r] == np.concatenate([np.zeros(32), v])[-32:][::3].tolist()


def test_trials_are_cut_with_their_partial_chunk(spark, tmp_path, chunks):
    x, rows = chunks
    b = spark.createDataFrame([(1, 0, 3, 20), (1, 1, 90, 13), (1, 2, 100, 20), (2, 0, 0, 40)], "recording_id long, trial_pos long, data_start long, n_samples long")
    out = live.run_available(live.segment_trials(stream(spark, tmp_path, shuffled(rows, 3)), b, CHUNK), str(tmp_path / "cut")).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.part_start):
        got.setdefault((r.recording_id, r.trial_pos), []).extend(r.part)
    assert got == {(1, 0): x[1][3:23].tolist(), (1, 1): x[1][90:103].tolist(), (1, 2): x[1][100:].tolist(), (2, 0): x[2].tolist()}


def test_a_batch_is_carried_out_once(spark, tmp_path):
    batch = spark.range(5).select(F.col("id").alias("recording_id"))
    path = str(tmp_path / "out")
    calls = []

    def work(b):
        calls.append(1)
        return b.withColumn("done", F.lit(True))
    assert live.once(batch, 7, path, work) is True
    assert live.once(batch, 7, path, work) is False and len(calls) == 1
    assert live.once(batch, 8, path, work) is True
    assert spark.read.parquet(path).count() == 10


def test_only_the_batchs_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "archive")
    a = spark.range(400).select((F.col("id") % 100).alias("recording_id"), F.col("id").alias("v"))
    a.withColumn("part", live.archive_part()).write.partitionBy("part").parquet(path)
    batch = spark.createDataFrame([(3,), (3,), (50,)], "recording_id long")
    out = live.of_batch(spark.read.parquet(path), batch)
    assert len(out.inputFiles()) > 2 and sorted(r.v for r in out.collect()) == [3, 50, 103, 150, 203, 250, 303, 350]
    scan = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert any("part#" in line.split("PartitionFilters")[1] for line in scan)
