"""Text, JSON and CSV inputs of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SIDECAR_SCHEMA = """
  subject STRUCT<expt_id STRING, genotype STRING, age STRING, sex STRING, targeted_cell_type STRING, notes STRING,
                 drug_applied BOOLEAN, drug_name STRING, drug_concentration STRING>,
  start_time STRING, end_time STRING, duration_samples BIGINT, duration_seconds DOUBLE, clamp_mode STRING, sample_rate_hz INT,
  n_trials_completed INT,
  protocol STRUCT<name STRING, clamp_mode STRING, pre_ms DOUBLE, post_ms DOUBLE, iti_ms DOUBLE, repeats_per_stimulus INT, n_stimuli INT, n_trials_total INT>,
  channels ARRAY<STRUCT<name STRING, ni_channel STRING, terminal_config STRING, display_scale DOUBLE, units STRING>>,
  camera STRUCT<frame_rate_hz DOUBLE, exposure_ms DOUBLE>,
  files STRUCT<ephys_h5 STRING, ephys_bin STRING, video STRING, videos ARRAY<STRING>>,
  protocols ARRAY<STRUCT<start_time STRING, start_sample BIGINT, protocol STRING>>
"""


def read_sidecars(spark: SparkSession, path: str, glob: str = "*_metadata.json") -> DataFrame:
    """All sidecars under ``path``. A file that does not parse yields a row with ``_corrupt_record``
    set. Trial sidecars keep the clamp mode under their protocol; it is lifted here."""
    raw = (
        spark.read.schema(f"{SIDECAR_SCHEMA}, _corrupt_record STRING").option("multiLine", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    )
    r = raw.withColumn("metadata_file", F.col("_metadata.file_path"))
    return r.withColumn("clamp_mode", F.coalesce("clamp_mode", "protocol.clamp_mode"))


def protocol_runs(sidecars: DataFrame, keys: list[str]) -> DataFrame:
    """Protocol runs of the sidecars in list order. Entries without a protocol are dropped; a run
    without a start sample starts at 0."""
    r = sidecars.select(*keys, F.posexplode("protocols").alias("run_seq", "_r"))
    return r.where("_r.protocol IS NOT NULL").select(
        *keys, F.col("run_seq").cast("bigint").alias("run_seq"), F.coalesce("_r.start_sample", F.lit(0)).alias("start_sample"), F.col("_r.protocol").alias("protocol"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Acquisition logs as ``(path, line)``, blank lines dropped."""
    t = spark.read.text(path, recursiveFileLookup=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.trim("line") != "")


def parse_buffer_warnings(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``key=value`` fields of the buffer-fill warnings; other lines are left out."""
    def field(name: str):
        return F.try_to_number(F.regexp_extract("line", rf"\b{name}=(\d+)", 1), F.lit("999999999999999999")).cast("bigint").alias(name)
    return lines.where(F.col("line").startswith("WARN buffer_fill")).select(
        *keep, field("sample_index"), field("avail_samp_per_chan"), field("threshold"))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Folder manifest ``(dir, name, extension, length)``; file contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    f = r.load(path).select("path", "length")
    return f.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("extension"), "length", "path")
