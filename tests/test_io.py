"""Raw files, tables, catalogue maintenance and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clampspark.operators import blocks as B, catalog as K
from clampspark.sources import files, rawbin, tables
from clampspark.operators.stimulus import trial_bounds
from clampspark.streaming import live
from clampspark.streaming.ordered import on_time

KEY = ["recording_id"]


@pytest.fixture()
def raw(tmp_path):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(5, 200 * 13))
    body = data.reshape(5, 13, 200).transpose(1, 0, 2)
    with open(tmp_path / "a.bin", "wb") as f:
        f.write(body.tobytes())
        f.write(b"\0" * 123)
    return str(tmp_path), data


def check_blocks(rows, data, block, halo):
    n = data.shape[1]
    assert len(rows) == 5 * -(-n // block)
    for r in rows:
        x, s = data[r.channel_index], r.block_start
        e = min(s + block, n)
        assert r.samples == x[s:e].tolist()
        assert r.before == x[max(0, s - halo):s].tolist() and r.after == x[e:e + halo].tolist()


def test_raw_scan_and_tail(spark, raw):
    path, data = raw
    m = rawbin.manifest(spark, path)
    r = m.first()
    assert (r.n_samples, r.tail_bytes) == (2600, 123)
    check_blocks(rawbin.scan(m, 5, 400, 200, 11, blocks_per_range=3).collect(), data, 400, 11)


def test_raw_data_source(spark, raw):
    path, data = raw
    spark.dataSource.register(rawbin.RawBinSource)
    check_blocks(spark.read.format("rawbin").option("block", 600).option("halo", 3).load(path).collect(), data, 600, 3)


def test_trial_scan(spark, tmp_path):
    a, b = np.arange(10.0).reshape(5, 2), np.arange(20.0).reshape(5, 4) * -1
    (tmp_path / "t.bin").write_bytes(a.tobytes() + b.tobytes())
    idx = spark.createDataFrame([(str(tmp_path / "t.bin"), 0, 0, 2), (str(tmp_path / "t.bin"), 1, 80, 4)], "path string, trial_index bigint, byte_offset bigint, n_samples bigint")
    got = {(r.trial_index, r.channel_index): r.samples for r in rawbin.scan_trials(idx).collect()}
    assert got == {(t, c): x[c].tolist() for t, x in ((0, a), (1, b)) for c in range(5)}


def test_range_read_prunes_blocks(spark, tmp_path):
    rows = [(r, i, float(i)) for r in (1, 2) for i in range(1000)]
    b = B.pack(spark.createDataFrame(rows, "recording_id bigint, sample_index bigint, v double"), KEY, 100, 11)
    out = str(tmp_path / "blocks")
    tables.write_blocks(b, out, KEY)
    q = tables.read_range(spark.read.parquet(out), KEY, 0.25, 0.31, 1000)
    assert sorted(r.sample_index for r in q.where("recording_id = 1").collect()) == list(range(250, 310))
    assert "LessThan(block_start,310)" in q._jdf.queryExecution().executedPlan().toString()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x1", "keep", 1), ("a", "x2", "keep2", 2), ("", "x3", "lost", 3), ("b", "x4", "u", 4)], "metadata_file string, expt_id string, rating string, row_no bigint")
    new = spark.createDataFrame([("a", "n1", 1), ("c", "n2", 2)], "metadata_file string, expt_id string, row_no bigint")
    owned = ["expt_id", "metadata_file"]
    one = K.upsert_log(old, new, owned=owned)
    assert sorted(tuple(r) for r in one.collect()) == [("n1", "a", "keep2", "updated"), ("n2", "c", "", "added"), ("x4", "b", "u", "kept")]
    two = K.upsert_log(one.drop("change").withColumn("row_no", F.monotonically_increasing_id()), new, owned=owned)
    assert sorted(tuple(r)[:3] for r in two.collect()) == sorted(tuple(r)[:3] for r in one.collect())


def test_sidecars(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r1_metadata.json").write_text('{\n "subject": {"expt_id": "e1"},\n "protocol": {"clamp_mode": "voltage_clamp"},\n "protocols": [{"start_time": "t"}, {"start_sample": 5, "protocol": {"name": "p"}}, {"protocol": {}}]\n}')
    (tmp_path / "r2_metadata.json").write_text('{"subject": {"expt_id": ')
    (tmp_path / "other.json").write_text("{}")
    s = files.read_sidecars(spark, str(tmp_path)).cache()
    assert s.count() == 2 and s.where("_corrupt_record IS NOT NULL").count() == 1
    good = s.where("_corrupt_record IS NULL")
    assert good.first().clamp_mode == "voltage_clamp"
    runs = files.protocol_runs(good, ["metadata_file"]).orderBy("run_seq").collect()
    assert [(r.run_seq, r.start_sample) for r in runs] == [(1, 5), (2, 0)]
    m = {r.name: r.extension for r in files.list_files(spark, str(tmp_path)).collect()}
    assert m == {"r1_metadata.json": ".json", "r2_metadata.json": ".json", "other.json": ".json"}


def feed(spark, path, rows, schema, parts):
    """Write rows in several rounds; between rounds the stream is run again on its checkpoint."""
    for p in range(parts):
        cut = rows[len(rows) * p // parts:len(rows) * (p + 1) // parts]
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(path)
        yield spark.readStream.schema(schema).parquet(path)


CHUNKS = "recording_id bigint, channel_index int, chunk_seq bigint, samples array<double>"


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_equal_batch(spark, tmp_path, parts):
    rng = np.random.default_rng(1)
    x = rng.choice([0.0, 5.0], 120)
    x[0] = 5.0
    rows = [(1, 0, k, x[k * 4:k * 4 + 4].tolist()) for k in range(30)]
    out = {n: str(tmp_path / n) for n in ("edges", "roll", "seg")}
    plans = spark.createDataFrame([(1, k, 6.0, 5.0, n) for k, n in enumerate([12, 10, 31])], "recording_id bigint, trial_pos bigint, iti_ms double, pre_ms double, n_samples bigint")
    bounds = trial_bounds(plans, ["recording_id"], 1000, 4).select("recording_id", "trial_pos", "data_start", F.col("n_saved").alias("n_samples"))
    for s in feed(spark, str(tmp_path / "in"), rows, CHUNKS, parts):
        e = live.run_available(live.count_edges(s, 2.5), out["edges"])
        r = live.run_available(live.rolling_view(s, 50, 4, 4), out["roll"])
        g = live.run_available(live.segment_trials(s, bounds, 4), out["seg"])
    want = int((np.diff(np.concatenate([[0], x >= 2.5]).astype(int)) == 1).sum())
    assert e.agg(F.max("n_edges")).first()[0] == want
    assert r.orderBy(F.desc("last_chunk")).first().samples == x[-50:][::4].tolist()
    # Waits end at 8, pre phases after 8 more, stimulus phases at the next chunk end.
    g = g.groupBy("recording_id", "trial_pos", "data_start").agg(F.sum(F.size("part")).alias("n"))
    assert sorted(tuple(t) for t in g.collect()) == [(1, 0, 8, 12), (1, 1, 32, 10), (1, 2, 56, 31)]


def test_alerts_keep_their_distance(spark, tmp_path):
    avail = [2000, 2000, 2000, 100, 2000, 2000, 2000, 2000]
    rows = [(1, k, a) for k, a in enumerate(avail)]
    for s in feed(spark, str(tmp_path / "in"), rows, "recording_id bigint, chunk_seq bigint, available bigint", 2):
        r = live.run_available(live.backlog_alerts(s, 1400, 3), str(tmp_path / "out"))
    quiet, want = 3, []
    for k, a in enumerate(avail):
        quiet += 1
        if a >= 1400 and quiet >= 3:
            want.append(((k + 1) * 200, a))
            quiet = 0
    assert sorted((x.sample_index, x.available) for x in on_time(r).collect()) == want
