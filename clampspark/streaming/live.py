"""Live operators over chunk streams.

A chunk row is ``(recording_id, channel_index, chunk_seq, samples)``. Work that one chunk allows is
done before the stateful step, so the state sees one small row per chunk, not one per sample.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ordered import InOrder, in_order
from ..config import CHUNK_SIZE, DISPLAY_SECONDS, DISPLAY_STRIDE, SAMPLE_RATE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, checkpointed, and return what it wrote."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(path)


class _Stored(InOrder):
    """Counts the samples saved, chunk after chunk."""
    payload, carry, columns, start = "samples array<double>", "saved long", ["samples", "n_saved"], (0,)

    def take(self, carry, seq, row):
        saved = int(carry[0]) + len(row[0])
        return (saved,), [(list(map(float, row[0])), saved)]


def ingest(chunks: DataFrame, time: str | None = None, grace_ms: int = 10_000) -> DataFrame:
    """Chunks in order with the number of samples saved once each has been stored: a count, so short chunks and gaps tell. Rows of
    kind ``late`` and ``gap`` go with them (see ``ordered``)."""
    return in_order(chunks.select("recording_id", "chunk_seq", "samples", *([time] if time else [])), _Stored(1, grace_ms if time else 0), ["recording_id"], "samples array<double>, n_saved bigint", time)


# ---- edges ----------------------------------------------------------------------------------

class _EdgeCount(InOrder):
    payload, carry, columns, start = "inner int, first int, last int", "level int, edges long", ["n_edges"], (0, 0)

    def take(self, carry, seq, row):
        level, edges = carry
        inner, first, last = row
        edges = int(edges) + int(inner) + int(first == 1 and level == 0)
        return (int(last), edges), [(edges,)]


def count_edges(chunks: DataFrame, threshold: float, time: str | None = None, grace_ms: int = 10_000) -> DataFrame:
    """Rising edges so far per recording, the last level carried from chunk to chunk in their order. Each chunk is first
    reduced to its inner edges and its two end levels. A chunk that comes twice is rejected, not counted again."""
    def level(x: Column) -> Column:
        return F.when(x >= threshold, 1).otherwise(0)

    lv = F.transform("samples", level)
    rest = [time] if time else []
    c = chunks.select("recording_id", "chunk_seq", lv.alias("lv"), *rest)
    inner = F.aggregate(F.zip_with(F.slice("lv", F.lit(2), F.greatest(F.size("lv") - 1, F.lit(0))), F.slice("lv", F.lit(1), F.greatest(F.size("lv") - 1, F.lit(0))),
                                   lambda a, b: F.when((a == 1) & (b == 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    c = c.select("recording_id", "chunk_seq", inner.alias("inner"), F.element_at("lv", 1).alias("first"), F.element_at("lv", -1).alias("last"), *rest)
    return in_order(c, _EdgeCount(1, grace_ms if time else 0, each=False), ["recording_id"], "n_edges bigint", time)


# ---- rolling view ---------------------------------------------------------------------------

class _Ring(StatefulProcessor):
    """The last chunks of a channel, each under its own key: a new chunk is one write, an old one one removal."""

    def __init__(self, capacity: int, chunk: int, stride: int):
        self.capacity, self.chunk, self.stride = capacity, chunk, stride
        self.slots = -(-capacity // chunk) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "seq long")
        self.ring = handle.getMapState("ring", "seq long", "samples array<double>")

    def handleInputRows(self, key, rows, timerValues):
        top = int(self.top.get()[0]) if self.top.exists() else -1
        p = pd.concat(list(rows))
        seqs = [int(s) for s in p["chunk_seq"]]
        newest = max(top, *seqs)
        for seq, samples in zip(seqs, p["samples"]):
            if seq > newest - self.slots:
                self.ring.updateValue((seq,), ([float(x) for x in samples],))
        for old in range(max(0, top - self.slots + 1), min(newest - self.slots, top) + 1):
            if self.ring.containsKey((old,)):
                self.ring.removeKey((old,))
        self.top.update((newest,))
        view = [0.0] * (self.slots * self.chunk)
        end = 0
        for seq in range(max(0, newest - self.slots + 1), newest + 1):
            at = (seq - newest + self.slots - 1) * self.chunk
            if self.ring.containsKey((seq,)):
                got = list(self.ring.getValue((seq,))[0])
                view[at:at + len(got)] = got
                end = at + len(got) if seq == newest else at + self.chunk
        view = view[:end]
        view = [0.0] * max(0, self.capacity - len(view)) + view[-self.capacity:]
        yield pd.DataFrame({"recording_id": [key[0]], "channel_index": [int(key[1])], "last_chunk": [newest], "samples": [view[::self.stride]]})

    def close(self) -> None:
        pass


def rolling_view(chunks: DataFrame, capacity: int = DISPLAY_SECONDS * SAMPLE_RATE, stride: int = DISPLAY_STRIDE, chunk: int = CHUNK_SIZE) -> DataFrame:
    """Last ``capacity`` samples per channel in time order, zero until filled, every ``stride``-th. Chunks may come in any order; all but a
    recording's last have ``chunk`` samples."""
    return chunks.select("recording_id", "channel_index", "chunk_seq", "samples").groupBy("recording_id", "channel_index").transformWithStateInPandas(
        _Ring(capacity, chunk, stride), "recording_id bigint, channel_index int, last_chunk bigint, samples array<double>", "Append", "None")


# ---- trial segmentation ---------------------------------------------------------------------

def segment_trials(chunks: DataFrame, bounds: DataFrame, chunk: int = CHUNK_SIZE) -> DataFrame:
    """The part of each chunk that belongs to a trial: ``recording_id, trial_pos, data_start, n_samples, part_start, part``.

    ``bounds`` is static: ``recording_id, trial_pos, data_start, n_samples``. A trial is spread over the chunks it touches and meets the stream by
    chunk number, so there is no state and the order of chunks does not matter; a partial last chunk gives what it has.
    """
    b = bounds.where("n_samples > 0").select("recording_id", "trial_pos", "data_start", "n_samples", F.explode(F.sequence(
        F.floor(F.col("data_start") / chunk).cast("bigint"), F.floor((F.col("data_start") + F.col("n_samples") - 1) / chunk).cast("bigint"))).alias("chunk_seq"))
    j = chunks.select("recording_id", "chunk_seq", "samples").join(b, ["recording_id", "chunk_seq"])
    at = F.col("chunk_seq") * chunk
    lo, hi = F.greatest("data_start", at), F.least(F.col("data_start") + F.col("n_samples"), at + F.size("samples"))
    j = j.withColumn("part_start", lo.cast("bigint")).withColumn("_n", (hi - lo).cast("int")).where("_n > 0")
    return j.select("recording_id", "trial_pos", "data_start", "n_samples", "part_start", F.slice("samples", (F.col("part_start") - at + 1).cast("int"), F.col("_n")).alias("part"))


# ---- backlog alerts -------------------------------------------------------------------------

class _Alerts(InOrder):
    payload, carry, columns = "available long", "quiet long", ["sample_index", "available"]

    def __init__(self, threshold: int, gap: int, chunk: int, grace_ms: int = 0):
        super().__init__(1, grace_ms)
        self.threshold, self.gap, self.chunk, self.start = threshold, gap, chunk, (gap,)

    def take(self, carry, seq, row):
        quiet = int(carry[0]) + 1
        if row[0] >= self.threshold and quiet >= self.gap:
            return (0,), [((seq + 1) * self.chunk, int(row[0]))]
        return (quiet,), []


def backlog_alerts(fill: DataFrame, threshold: int = 1400, gap: int = 100, chunk: int = CHUNK_SIZE, time: str | None = None, grace_ms: int = 10_000) -> DataFrame:
    """An alert when the backlog reaches ``threshold``, at most one per ``gap`` chunks, judged in the chunks' order over all batches. ``fill`` has
    ``recording_id, chunk_seq, available``."""
    return in_order(fill, _Alerts(threshold, gap, chunk, grace_ms if time else 0), ["recording_id"], "sample_index bigint, available bigint", time)


# ---- completion -----------------------------------------------------------------------------

def finalised(chunks: DataFrame, time: str = "ts", grace: str = "2 seconds") -> DataFrame:
    """Recordings no chunk has reached for the grace period. Chunks later than that are dropped by
    the watermark."""
    s = chunks.withWatermark(time, grace).groupBy("recording_id", F.session_window(time, grace)).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(time).alias("last_seen"))
    return s.select("recording_id", F.col("session_window.start").alias("started"), "last_seen", "n_chunks")


def on_batch(stream: DataFrame, path: str, work, checkpoint: str) -> None:
    """Run ``work(batch) -> DataFrame`` on each batch and store its rows under the batch number, exactly once.

    A ledger lists finished batches: one that is repeated after its end writes nothing, one that was cut off replaces its own folder.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        stream.writeStream.foreachBatch(lambda b, n: once(b, n, path, work)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def once(batch: DataFrame, number: int, path: str, work) -> bool:
    """One batch of :func:`on_batch`; tells whether it was carried out now."""
    spark = batch.sparkSession
    ledger = f"{path}-ledger/batch={number}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(ledger + "/_SUCCESS")):
        return False
    if not batch.isEmpty():
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    spark.range(1).select(F.current_timestamp().alias("finished")).write.mode("overwrite").parquet(ledger)
    return True


ARCHIVE_PARTS = 256


def archive_part(recording: str = "recording_id") -> Column:
    """Folder of a recording in an archive written with ``partitionBy("part")``."""
    return F.pmod(F.xxhash64(recording), F.lit(ARCHIVE_PARTS)).cast("int")


def of_batch(archive: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the archive (with its ``part`` folders) that belong to the batch's recordings. Only their folders are listed and read: the driver learns
    at most ``ARCHIVE_PARTS`` numbers."""
    ids = batch.select("recording_id").distinct()
    parts = [r[0] for r in ids.select(archive_part().alias("p")).distinct().collect()]
    return archive.where(F.col("part").isin(parts)).join(ids, "recording_id", "left_semi")


def due_events(chunks: DataFrame, timeline: DataFrame, chunk: int = CHUNK_SIZE) -> DataFrame:
    """Planned events that fall due with each chunk.

    Chunks have one size, so the chunk that fires an event is known from its offset: the first one
    whose end reaches it. That makes it an equi-join with the static timeline
    (``recording_id, run_start, offset, action, stimulus_index``), without state.
    """
    at = F.col("run_start") + F.col("offset")
    due = timeline.withColumn("chunk_seq", F.greatest(F.lit(0), F.ceil(at / chunk) - 1).cast("bigint"))
    c = chunks.select("recording_id", "chunk_seq", (F.col("chunk_seq") * chunk + F.size("samples")).alias("n_saved"))
    j = c.join(due, ["recording_id", "chunk_seq"])
    return j.where(F.col("n_saved") >= at).select("recording_id", "action", "stimulus_index", F.col("n_saved").alias("logged_index"), "offset")
