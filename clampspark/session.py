"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F

# Small files that one task writes.
FILES_PER_TASK = 256


def build_session(app: str = "clampspark", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Unset on a local master, as in tests, it is a folder beside the tables of ``spark.sql.warehouse.dir``; unset on a cluster it is an error, as
    the machines' own folders are not shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_files(df: DataFrame, by: list[Column], per_task: int = FILES_PER_TASK) -> tuple[DataFrameWriter, int]:
    """Writer of ``df`` for one small file per value of ``by``, and their number.

    To the planner many small files are little data, which it would leave to one task; here the tasks follow the number of files. Each task
    moves its own files into place, not the driver all of them one by one. ``df`` is read twice.
    """
    n = df.select(*by).distinct().count()
    return df.repartition(max(1, -(-n // per_task)), *by).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2"), n


# What Spark's writer escapes in the name of a folder, and its name for a value that is null or empty.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as the machines' own file system has it, which all of them mount; None in any other store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def folder_name(column: str, value: str | None) -> str:
    """Folder of one value as ``partitionBy`` names it."""
    def escaped(x: str) -> str:
        return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", x)
    return f"{escaped(column)}={escaped(value) if value else _NO_VALUE}"


def write_lines(df: DataFrame, folders: list[str], files: int, part: str, order: list[str], line: Column, header: str, path: str, per_task: int = FILES_PER_TASK) -> None:
    """One text file per folder and ``part`` below the mounted ``path``: the header, then ``line`` of each row by ``order``.

    Written by the Python workers: Spark's writer makes a folder and a file on a mounted store by starting ``chmod`` for each of them, several
    times per file. A file is written under another name and moved, so a task that is tried again replaces its files. ``files`` is their number.
    """
    os.makedirs(path)
    names = [F.col(f).cast("string").alias(f) for f in folders]
    keys = [*folders, part]
    d = df.select(*names, F.col(part).cast("bigint").alias(part), *order, line.alias("_line"))
    d = d.repartition(max(1, -(-files // per_task)), *keys).sortWithinPartitions(*keys, *order).select(*keys, "_line")

    def run(batches):
        at, to, f, other = None, "", None, f"_{uuid.uuid4().hex}"

        def close():
            if f:
                f.close()
                os.replace(f.name, to)

        for b in batches:
            *key, lines = (b.column(i).to_pylist() for i in range(b.num_columns))
            for k, text in zip(zip(*key), lines):
                if k != at:
                    close()
                    folder = os.path.join(path, *map(folder_name, folders, k))
                    os.makedirs(folder, exist_ok=True)
                    at, to = k, f"{folder}/part-{k[-1]:05d}.csv"
                    f = open(f"{folder}/{other}", "w", encoding="utf-8", newline="\n")
                    f.write(f"{header}\n")
                f.write(f"{text}\n")
        close()
        yield from ()

    d.mapInArrow(run, "n int").count()
    open(f"{path}/_SUCCESS", "w").close()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: reused by several branches and
    safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
