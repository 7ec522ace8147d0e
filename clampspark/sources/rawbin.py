"""Raw binary recordings: chunk-interleaved continuous files and trial files.

Files are cut into byte ranges that are ordinary rows, so Spark spreads the reading. A range is
read with one extra chunk on either side, from which the blocks take their halos.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import BLOCK_SAMPLES, CHUNK_SIZE, HALO_SAMPLES
from .files import list_files

N_CHANNELS = 5
BLOCK_SCHEMA = ("path string, channel_index int, block_no bigint, block_start bigint, samples array<double>, "
                "before array<double>, after array<double>")
_ARROW = pa.schema([
    ("path", pa.string()), ("channel_index", pa.int32()), ("block_no", pa.int64()), ("block_start", pa.int64()),
    ("samples", pa.list_(pa.float64())), ("before", pa.list_(pa.float64())), ("after", pa.list_(pa.float64()))])


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or plain path; ``file:/x`` counts as ``/x``."""
    if "://" not in path and ":" in path.split("/")[0]:
        path = path.split(":", 1)[1]
    return pafs.FileSystem.from_uri(path)


def _open(path: str):
    system, inner = locate(path)
    return system.open_input_file(inner)


def read_blocks(path: str, first: int, last: int, n_samples: int, n_ch: int, block: int, chunk: int, halo: int):
    """Blocks ``first`` to ``last - 1`` of one file as Arrow batches."""
    start, stop = first * block, min(last * block, n_samples)
    pad = -(-halo // chunk) * chunk
    lo, hi = max(0, start - pad) // chunk * chunk, min(n_samples, -(-(stop + pad) // chunk) * chunk)
    with _open(path) as f:
        f.seek(lo * n_ch * 8)
        raw = np.frombuffer(f.read((hi - lo) * n_ch * 8), dtype="<f8")
    data = raw.reshape(-1, n_ch, chunk).transpose(1, 0, 2).reshape(n_ch, -1)
    for b in range(first, last):
        s, e = b * block - lo, min((b + 1) * block, n_samples) - lo
        cols = [[path] * n_ch, list(range(n_ch)), [b] * n_ch, [b * block] * n_ch, [data[c, s:e] for c in range(n_ch)],
                [data[c, max(0, s - halo):s] for c in range(n_ch)], [data[c, e:e + halo] for c in range(n_ch)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(cols, _ARROW)], schema=_ARROW)


def manifest(spark: SparkSession, path: str, n_ch: int = N_CHANNELS, chunk: int = CHUNK_SIZE, glob: str = "*.bin") -> DataFrame:
    """Raw files with their whole samples per channel and the bytes of a partial last chunk, which
    is reported rather than padded with zeros."""
    group = n_ch * chunk * 8
    f = list_files(spark, path, glob)
    return f.select("path", "length", (F.floor(F.col("length") / group) * chunk).cast("bigint").alias("n_samples"), (F.col("length") % group).alias("tail_bytes"))


def scan(files: DataFrame, n_ch: int = N_CHANNELS, block: int = BLOCK_SAMPLES, chunk: int = CHUNK_SIZE,
         halo: int = HALO_SAMPLES, blocks_per_range: int = 32) -> DataFrame:
    """Block rows of the manifest's files; a range of 32 blocks is 25 MB at the default layout."""
    if block % chunk:
        raise ValueError("a block must be a whole number of chunks")
    n = F.ceil(F.col("n_samples") / block).cast("bigint")
    r = files.where("n_samples > 0").select("path", "n_samples", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(blocks_per_range).cast("bigint"))).alias("first"))
    r = r.select("path", "n_samples", "first", F.least(F.col("first") + blocks_per_range, F.col("_n")).alias("last"))
    r = r.repartition("path", "first")

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from read_blocks(row["path"], row["first"], row["last"], row["n_samples"], n_ch, block, chunk, halo)
    return r.mapInArrow(read, BLOCK_SCHEMA)


def scan_trials(index: DataFrame, n_ch: int = N_CHANNELS, block: int = BLOCK_SAMPLES) -> DataFrame:
    """Trials by ``(path, trial_index, byte_offset, n_samples)`` as blocks: one row per channel and at most ``block`` samples.

    A trial's channels lie one behind the other, so each block is one range of bytes; a long trial is read by many tasks.
    """
    schema = "path string, trial_index bigint, channel_index int, block_no bigint, block_start bigint, samples array<double>"
    arrow = pa.schema([("path", pa.string()), ("trial_index", pa.int64()), ("channel_index", pa.int32()), ("block_no", pa.int64()), ("block_start", pa.int64()), ("samples", pa.list_(pa.float64()))])

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                n = min(block, row["n_samples"] - row["block_no"] * block)
                with _open(row["path"]) as f:
                    f.seek(row["byte_offset"] + (row["channel_index"] * row["n_samples"] + row["block_no"] * block) * 8)
                    d = np.frombuffer(f.read(n * 8), dtype="<f8")
                cols = [row["path"], row["trial_index"], row["channel_index"], row["block_no"], row["block_no"] * block, d]
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(cols, arrow)], schema=arrow)

    last = F.greatest(F.floor((F.col("n_samples") - 1) / block), F.lit(0)).cast("bigint")
    parts = index.select("path", F.col("trial_index").cast("bigint"), "byte_offset", "n_samples", F.explode(F.sequence(F.lit(0), F.lit(n_ch - 1))).alias("channel_index"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block_no"))
    return parts.repartition("path", "trial_index", "block_no").mapInArrow(read, schema)


class _Range(InputPartition):
    def __init__(self, path: str, n_samples: int, first: int, last: int):
        self.path, self.n_samples, self.first, self.last = path, n_samples, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.n_ch, self.block = int(options.get("channels", N_CHANNELS)), int(options.get("block", BLOCK_SAMPLES))
        self.chunk, self.halo = int(options.get("chunk", CHUNK_SIZE)), int(options.get("halo", HALO_SAMPLES))

    def partitions(self):
        path = self.o["path"].rstrip("/")
        system, inner = locate(path)
        scheme = path[:len(path) - len(inner)] if path.endswith(inner) else ""  # workers open files by their full address
        out = []
        for f in system.get_file_info(pafs.FileSelector(inner, recursive=True)):
            if f.is_file and f.path.endswith(".bin"):
                n = f.size // (self.n_ch * self.chunk * 8) * self.chunk
                blocks = -(-n // self.block)
                out += [_Range(scheme + f.path, n, b, min(b + 32, blocks)) for b in range(0, blocks, 32)]
        return out

    def read(self, p):
        yield from read_blocks(p.path, p.first, p.last, p.n_samples, self.n_ch, self.block, self.chunk, self.halo)


class RawBinSource(DataSource):
    """``spark.read.format("rawbin").load(folder)`` after ``spark.dataSource.register``; the listing
    runs on the driver, so :func:`scan` suits archives of very many files better."""

    @classmethod
    def name(cls) -> str:
        return "rawbin"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))
