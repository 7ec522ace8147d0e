"""Streaming queries, each run over all available data."""

from pyspark.sql import functions as F

from clampspark.operators.blocks import pack
from clampspark.session import scratch_path
from clampspark.config import CHUNK_SIZE
from clampspark.streaming import live
from clampspark.streaming.ordered import on_time
from . import query
from .intervals import FRAMES
from .views import _STORED, BLOCK, KEY, sample_path, sig, sig_blocks, sql, stored_path, table

CHUNK = 4


def chunk_path(spark, d) -> str:
    """Stored chunks of four samples of each recording."""
    def build():
        b = pack(sig(spark, d), KEY, CHUNK, 0)
        return b.select("recording_id", F.lit(0).alias("channel_index"), F.col("block_no").alias("chunk_seq"), "samples")
    return stored_path(spark, d, "chunks", build)


def chunk_stream(spark, d):
    path = chunk_path(spark, d)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_ingest", sql("sig", "SELECT recording_id, sample_index // 4 AS chunk_seq, count(*) AS n, max(sample_index) + 1 AS n_saved, round(sum(v), 6) AS total FROM sig GROUP BY 1, 2"))
def stream_ingest(spark, d):
    r = on_time(live.run_available(live.ingest(chunk_stream(spark, d)), scratch_path(spark, "ingest")))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return r.select("recording_id", "chunk_seq", F.size("samples").cast("bigint").alias("n"), "n_saved", F.round(total, 6).alias("total"))


@query("stream_edges", sql("sig", "SELECT l.recording_id, coalesce(n, 0) AS n_edges FROM (SELECT DISTINCT recording_id FROM sig) l LEFT JOIN (SELECT recording_id, count(*) AS n FROM fr GROUP BY 1) USING (recording_id)", **FRAMES))
def stream_edges(spark, d):
    r = on_time(live.run_available(live.count_edges(chunk_stream(spark, d), 60.0), scratch_path(spark, "edges")))
    return r.groupBy("recording_id").agg(F.max("n_edges").alias("n_edges"))


@query("stream_rolling", sql("sig len", """SELECT l.recording_id, p AS pos, coalesce(s.v, 0) AS v FROM len l CROSS JOIN (SELECT unnest(range(0, 80, 4)) AS p) q
    LEFT JOIN sig s ON s.recording_id = l.recording_id AND s.sample_index = n_samples - 80 + p"""))
def stream_rolling(spark, d):
    r = live.run_available(live.rolling_view(chunk_stream(spark, d), 80, 4, CHUNK), scratch_path(spark, "rolling"))
    last = r.groupBy("recording_id").agg(F.max_by("samples", "last_chunk").alias("s"))
    return last.select("recording_id", F.posexplode("s").alias("p", "v")).select("recording_id", (F.col("p") * 4).cast("bigint").alias("pos"), "v")


SEGMENT = dict(
    pl="SELECT recording_id, n_samples, unnest(range(0, 5)) AS trial_pos FROM len",
    sp="SELECT *, 10 + (recording_id + trial_pos) % 5 AS total, 8 + 8 + ((10 + (recording_id + trial_pos) % 5 - 5 + 3) // 4) * 4 AS span FROM pl",
    cu="SELECT *, sum(span) OVER (PARTITION BY recording_id ORDER BY trial_pos) AS stop FROM sp",
)


@query("stream_segment", sql("len", "SELECT recording_id, trial_pos, CAST(stop - span + 8 AS BIGINT) AS data_start, total AS n_saved FROM cu WHERE stop - span + 8 + total <= n_samples", **SEGMENT))
def stream_segment(spark, d):
    """Five planned trials per recording, cut out of the stream; interval 6 and pre phase 5 samples, rounded up to chunks. Whole trials only."""
    bounds = planned_bounds(spark, d)
    r = live.run_available(live.segment_trials(chunk_stream(spark, d), bounds, CHUNK), scratch_path(spark, "segments"))
    g = r.groupBy("recording_id", "trial_pos", "data_start", "n_samples").agg(F.sum(F.size("part")).alias("n_saved"))
    return g.where("n_saved = n_samples").drop("n_samples")


def planned_bounds(spark, d):
    from clampspark.operators.stimulus import trial_bounds
    from .views import rec_lengths
    p = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("trial_pos")
    plans = rec_lengths(spark, d).select("recording_id", p).select("recording_id", "trial_pos", F.lit(6.0).alias("iti_ms"), F.lit(5.0).alias("pre_ms"),
                                                                   (10 + (F.col("recording_id") + F.col("trial_pos")) % 5).alias("n_samples"))
    return trial_bounds(plans, KEY, 1000, CHUNK).select("recording_id", "trial_pos", "data_start", F.col("n_saved").alias("n_samples"))


@query("trial_cut", sql("sig len", """SELECT cu.recording_id, trial_pos, count(*) AS n, round(sum(v), 6) AS total FROM cu JOIN sig s ON s.recording_id = cu.recording_id AND sample_index >= stop - span + 8 AND sample_index < stop - span + 8 + total
    GROUP BY 1, 2""", **SEGMENT))
def trial_cut(spark, d):
    """The same trials cut out of the stored recording."""
    from clampspark.operators.intervals import samples_in
    w = planned_bounds(spark, d).select("recording_id", "trial_pos", F.col("data_start").alias("start"), (F.col("data_start") + F.col("n_samples")).alias("end"))
    s = samples_in(sig_blocks(spark, d), w, KEY, BLOCK)
    return s.groupBy("recording_id", "trial_pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("stream_alerts", sql("sig", """, f AS (SELECT recording_id, sample_index, v FROM sig WHERE floor(v * 10) >= 1000),
    nx AS (SELECT a.recording_id, a.sample_index, min(b.sample_index) AS nxt FROM f a LEFT JOIN f b ON b.recording_id = a.recording_id AND b.sample_index >= a.sample_index + 5 GROUP BY 1, 2),
    al AS (SELECT recording_id, min(sample_index) AS sample_index FROM f GROUP BY 1 UNION ALL SELECT al.recording_id, nx.nxt FROM al JOIN nx ON nx.recording_id = al.recording_id AND nx.sample_index = al.sample_index WHERE nx.nxt IS NOT NULL)
    SELECT al.recording_id, (al.sample_index + 1) * 200 AS sample_index, CAST(floor(f.v * 10) AS BIGINT) AS available FROM al JOIN f ON f.recording_id = al.recording_id AND f.sample_index = al.sample_index""").replace("WITH sig", "WITH RECURSIVE sig", 1))
def stream_alerts(spark, d):
    """One chunk per sample; the backlog is ten times its value."""
    path = sample_path(spark, d)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    fill = s.select("recording_id", F.col("sample_index").alias("chunk_seq"), F.floor(F.col("v") * 10).cast("bigint").alias("available"))
    r = on_time(live.run_available(live.backlog_alerts(fill, 1000, 5, CHUNK_SIZE), scratch_path(spark, "alerts")))
    return r.select("recording_id", "sample_index", "available")


FINAL = dict(
    g="SELECT user_id AS recording_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    s="SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY ts) AS n FROM g",
    z="SELECT recording_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n_chunks FROM s GROUP BY recording_id, n",
    fin="SELECT * FROM z WHERE last_seen + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR",
)


@query("stream_finalise", sql("", "SELECT recording_id, epoch_us(started) AS started_us, epoch_us(last_seen) AS last_us, n_chunks FROM fin", **FINAL))
def stream_finalise(spark, d):
    e = event_stream(spark, d).select(F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"))
    r = live.run_available(live.finalised(e, "ts", "6 hours"), scratch_path(spark, "final"))
    return r.select("recording_id", F.unix_micros("started").alias("started_us"), F.unix_micros("last_seen").alias("last_us"), "n_chunks")


def archive_path(spark, d) -> str:
    """The stored samples in folders by recording."""
    at = (spark.sparkContext.applicationId, d, "sample-archive")
    if at not in _STORED:
        path = scratch_path(spark, "sample-archive")
        s = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), (F.col("value") / 40).alias("v"))
        s.withColumn("part", live.archive_part()).repartition("part").write.partitionBy("part").parquet(path)
        _STORED[at] = path
    return _STORED[at]


@query("stream_qc", sql("", """SELECT recording_id, count(*) AS n_final, round(max(hi), 6) AS max_v, max(status) AS status FROM fin JOIN (SELECT user_id AS recording_id, max(value) / 40 AS hi,
    CASE WHEN count(*) FILTER (WHERE value / 40 >= 9.95) / count(*) >= 1e-3 THEN 'fail' ELSE 'pass' END AS status FROM events GROUP BY 1) USING (recording_id) GROUP BY 1""", **FINAL))
def stream_qc(spark, d):
    """Saturation check of every recording as it becomes final."""
    from clampspark.plans import qc
    e = event_stream(spark, d).select(F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "stream-qc")
    archive = archive_path(spark, d)

    def work(batch):
        done = batch.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_final"))
        r = qc.saturation(qc.channel_stats(live.of_batch(spark.read.parquet(archive), done), KEY))
        return r.join(done, "recording_id").select("recording_id", "n_final", "max_v", "status")

    live.on_batch(live.finalised(e, "ts", "6 hours"), path, work, path + "-checkpoint")
    r = spark.read.option("basePath", path).parquet(path)
    return r.groupBy("recording_id").agg(F.sum("n_final").alias("n_final"), F.round(F.max("max_v"), 6).alias("max_v"), F.max("status").alias("status"))


@query("stream_due", sql("len", """SELECT recording_id, action, stimulus_index, least(greatest(4, (at_ + 3) // 4 * 4), n_samples) AS logged_index, off_ AS offset_samples FROM (
    SELECT recording_id, n_samples, p AS stimulus_index, CASE WHEN p % 2 = 0 THEN 'apply' ELSE 'clear' END AS action, p * 7 + recording_id % 3 AS off_, 5 + p * 7 + recording_id % 3 AS at_ FROM len CROSS JOIN (SELECT unnest(range(0, 6)) AS p))
    WHERE at_ <= n_samples"""))
def stream_due(spark, d):
    from .views import rec_lengths
    p = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("p")
    tl = rec_lengths(spark, d).select("recording_id", p).select(
        "recording_id", F.lit(5).cast("bigint").alias("run_start"), (F.col("p") * 7 + F.col("recording_id") % 3).alias("offset"),
        F.when(F.col("p") % 2 == 0, "apply").otherwise("clear").alias("action"), F.col("p").alias("stimulus_index"))
    r = live.run_available(live.due_events(chunk_stream(spark, d), tl, CHUNK), scratch_path(spark, "due"))
    return r.withColumnRenamed("offset", "offset_samples")
