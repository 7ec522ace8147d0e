"""Catalogue, files and log."""

from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from clampspark.operators import catalog as K, protocols
from clampspark.session import FILES_PER_TASK, scratch_path
from clampspark.sources import files as S, rawbin
from . import query
from .views import rec, sql, stim, table


@query("recording_mode", sql("rec", """SELECT recording_id, CASE WHEN has_trials AND recording_id % 8 <> 0 THEN 'trial' ELSE 'continuous' END AS mode,
    CASE WHEN drug_applied THEN '' ELSE genotype END AS start_time FROM rec"""))
def recording_mode(spark, d):
    r = rec(spark, d).select("recording_id", "has_trials", (F.col("recording_id") % 8 == 0).alias("has_continuous"),
                             F.when(~F.col("drug_applied"), F.col("genotype")).alias("start_time"))
    return K.recording_mode(r).select("recording_id", "mode", "start_time")


@query("continuous_view", sql("rec", "SELECT count(*) AS n, CAST(sum(recording_id) AS BIGINT) AS ids FROM rec WHERE NOT has_trials OR recording_id % 8 = 0"))
def continuous_view(spark, d):
    r = rec(spark, d).select("recording_id", "has_trials", (F.col("recording_id") % 8 == 0).alias("has_continuous"), F.lit("").alias("start_time"))
    c = K.continuous_only(K.recording_mode(r).where("mode = 'continuous'"))
    return c.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("recording_id").alias("ids"))


FILES = dict(
    b="SELECT o_orderkey AS i, 'd' || (o_orderkey % 50) AS dir, 'rec' || o_orderkey AS base, o_orderkey % 7 = 0 AS tr FROM orders",
    s="SELECT *, CASE WHEN tr THEN base || '_trials' ELSE base END AS stem FROM b",
)


def file_list(spark, d):
    """A store file per order; sidecars, videos and logs for some of them."""
    i = F.col("o_orderkey")
    base = F.concat(F.lit("rec"), i)
    stem = F.when(i % 7 == 0, F.concat(base, F.lit("_trials"))).otherwise(base)
    names = F.array_compact(F.array(
        F.concat(stem, F.lit(".h5")), F.when(i % 2 == 0, F.concat(stem, F.lit(".json"))), F.when(i % 3 == 0, F.concat(base, F.lit("_metadata.json"))),
        F.when(i % 4 == 0, F.concat(base, F.lit("_x.avi"))), F.when(i % 5 == 0, F.concat(base, F.lit("_y.avi"))), F.when(i % 6 == 0, F.concat(stem, F.lit("_acquisition.log")))))
    return table(spark, d, "orders").select(F.concat(F.lit("d"), i % 50).alias("dir"), F.explode(names).alias("name"))


VIDEOS = dict(**FILES, v="SELECT dir, i, base || '_x.avi' AS name FROM b WHERE i % 4 = 0 UNION ALL SELECT dir, i, base || '_y.avi' FROM b WHERE i % 5 = 0",
              px="SELECT dir, name, left(name, unnest(range(1, len(name) - 3))) AS pre FROM v",
              m="SELECT s.dir, s.stem, count(*) AS n, min(px.name) AS f FROM s JOIN px ON px.dir = s.dir AND px.pre = s.base GROUP BY 1, 2")


@query("companion_files", sql("", """SELECT s.dir, s.stem, CASE WHEN i % 2 = 0 THEN s.stem || '.json' WHEN i % 3 = 0 THEN base || '_metadata.json' END AS sidecar, coalesce(n, 0) AS n_videos,
    f AS first_video, CASE WHEN i % 6 = 0 THEN s.stem || '_acquisition.log' END AS log FROM s LEFT JOIN m ON m.dir = s.dir AND m.stem = s.stem""", **VIDEOS))
def companion_files(spark, d):
    return K.companions(file_list(spark, d))


@query("video_lookup", sql("", """SELECT i AS recording_id, coalesce(CASE WHEN i % 4 = 0 AND i % 3 = 0 THEN base || '_x.avi' END, CASE WHEN i % 5 = 0 AND i % 2 = 0 THEN base || '_y.avi' END, f) AS video
    FROM b LEFT JOIN (SELECT dir, pre, min(name) AS f FROM px GROUP BY 1, 2) q ON q.dir = b.dir AND q.pre = b.base""", **VIDEOS))
def video_lookup(spark, d):
    i = F.col("o_orderkey")
    base = F.concat(F.lit("rec"), i)
    r = table(spark, d, "orders").select(
        i.alias("recording_id"), F.concat(F.lit("d"), i % 50).alias("dir"), F.concat(base, F.lit("_metadata")).alias("stem"),
        F.when(i % 3 == 0, F.concat(base, F.lit("_x.avi"))).alias("sidecar_video"), F.when(i % 2 == 0, F.concat(base, F.lit("_y.avi"))).alias("trial_video"))
    return K.find_video(r, file_list(spark, d))


@query("file_rollup", """SELECT dir, extension, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS bytes FROM (
    SELECT split_part(split_part(url, '://', 2), '/', 1) AS dir, regexp_extract(split_part(split_part(url, '://', 2), '/', 1), '(\\.[^./]*)$', 1) AS extension, length(html) AS length FROM pages) GROUP BY 1, 2""")
def file_rollup(spark, d):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    f = table(spark, d, "pages").select(host.alias("dir"), F.regexp_extract(host, r"(\.[^./]*)$", 1).alias("extension"), F.length("html").alias("length"))
    return K.rollup_by_extension(f)


@query("protocol_decode", sql("stim", """SELECT stimulus_index, coalesce(CASE WHEN stimulus_index % 3 = 0 THEN name END, 'Unnamed protocol') AS protocol_name, coalesce(pulse_pa, 0) AS pulse_pa, pulse_pa IS NOT NULL AS has_pulse,
    CASE WHEN stimulus_index % 5 = 0 THEN min_pa ELSE -50 END AS min_pa, CASE WHEN stimulus_index % 2 = 0 THEN CAST(staircase_repeats AS BIGINT) ELSE 1 END AS repeats, 1000.0::DOUBLE AS pre_ms, type FROM stim"""))
def protocol_decode(spark, d):
    i = F.col("stimulus_index")
    text = F.to_json(F.struct(
        F.lit(1).alias("version"), F.when(i % 3 == 0, F.col("name")).alias("name"),
        F.when(F.col("pulse_pA").isNotNull(), F.struct(F.col("pulse_pA").alias("amplitude_pA"), F.col("pulse_ms").alias("duration_ms"))).alias("hyperpolarization"),
        F.array(F.struct("type", F.when(i % 5 == 0, F.col("min_pA")).alias("min_pA"), F.when(i % 2 == 0, F.col("staircase_repeats")).alias("staircase_repeats"))).alias("stimuli")))
    p = stim(spark, d).select("stimulus_index", protocols.decode(text).alias("p"))
    s = F.get("p.stimuli", F.lit(0))
    return p.select(
        "stimulus_index", F.col("p.name").alias("protocol_name"), F.coalesce("p.hyperpolarization.amplitude_pA", F.lit(0.0)).alias("pulse_pa"),
        F.col("p.hyperpolarization").isNotNull().alias("has_pulse"), s["min_pA"].alias("min_pa"), s["staircase_repeats"].cast("bigint").alias("repeats"),
        F.col("p.pre_ms").alias("pre_ms"), s["type"].alias("type"))


FOLDERS = 256


def sidecar_text(spark, d):
    """Sidecar JSON of every supplier; some are damaged, some keep the mode under the protocol."""
    s = table(spark, d, "supplier")
    i = F.col("s_suppkey")
    runs = F.array(
        F.struct(F.lit("r0").alias("start_time"), F.col("s_nationkey").cast("bigint").alias("start_sample"), F.lit("{}").alias("protocol")),
        F.struct(F.lit("r1").alias("start_time"), F.lit(None).cast("bigint").alias("start_sample"), F.when(i % 2 == 0, F.lit("{}")).alias("protocol")))
    text = F.to_json(F.struct(
        F.struct(F.col("s_name").alias("expt_id"), (i % 2 == 0).alias("drug_applied")).alias("subject"), (F.col("s_acctbal") / 10).alias("duration_seconds"),
        F.when(i % 3 != 0, F.lit("current_clamp")).alias("clamp_mode"), F.struct(F.lit("voltage_clamp").alias("clamp_mode")).alias("protocol"),
        F.lit(20000).alias("sample_rate_hz"), runs.alias("protocols")))
    return s.select(i.alias("id"), F.when(i % 10 == 9, F.substring(text, 1, 40)).otherwise(text).alias("value"))


def sidecars(spark, d):
    """One file per sidecar in the shared folder, read back by the sidecar reader."""
    path = scratch_path(spark, "sidecars")
    t = sidecar_text(spark, d)
    tasks = max(1, -(-t.count() // FILES_PER_TASK))

    def write(batches):
        system, inner = rawbin.locate(path)
        rows = ((i, v) for b in batches for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        n, made = 0, set()
        for i, group in groupby(rows, lambda r: r[0]):
            folder = f"{inner}/{(i or 0) % FOLDERS}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/{i}_metadata.json") as f:
                f.write("".join(f"{v}\n" for _, v in group).encode())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # Small files are little data: the number of tasks follows that of the files, and each task writes its own.
    t.select("id", "value").repartition(tasks, "id").sortWithinPartitions("id").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return S.read_sidecars(spark, path).withColumn("id", F.regexp_extract("metadata_file", r"/(\d+)_metadata", 1).try_cast("bigint"))


@query("scan_sidecars", """SELECT s_suppkey AS id, CASE WHEN bad THEN '' ELSE s_name END AS expt_id, CASE WHEN bad THEN '' WHEN s_suppkey % 3 = 0 THEN 'voltage_clamp' ELSE 'current_clamp' END AS clamp_mode,
    round(CASE WHEN bad THEN 0 ELSE s_acctbal / 10 END, 6) AS duration_seconds, bad AS damaged FROM (SELECT *, s_suppkey % 10 = 9 AS bad FROM supplier)""")
def scan_sidecars(spark, d):
    bad = F.col("_corrupt_record").isNotNull()
    blank = lambda c, v: F.when(bad, v).otherwise(F.col(c))
    return sidecars(spark, d).select("id", blank("subject.expt_id", "").alias("expt_id"), blank("clamp_mode", "").alias("clamp_mode"),
                                     F.round(blank("duration_seconds", 0.0), 6).alias("duration_seconds"), bad.alias("damaged"))


@query("protocol_runs", """SELECT s_suppkey AS id, 0::BIGINT AS run_seq, s_nationkey::BIGINT AS start_sample FROM supplier WHERE s_suppkey % 10 <> 9
    UNION ALL SELECT s_suppkey, 1, 0 FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 2 = 0""")
def protocol_runs(spark, d):
    ok = sidecars(spark, d).where("_corrupt_record IS NULL")
    return S.protocol_runs(ok, ["id"]).select("id", "run_seq", "start_sample")


@query("log_severity", """SELECT event_id, user_id * 10 AS sample_index, CAST(floor(value) AS BIGINT) AS avail_samp_per_chan, 1400::BIGINT AS threshold FROM events WHERE event_type = 'error'""")
def log_severity(spark, d):
    """Acquisition log lines written as text, read back and parsed."""
    e = table(spark, d, "events")
    warn = F.concat(F.lit("WARN buffer_fill sample_index="), F.col("user_id") * 10, F.lit(" avail_samp_per_chan="), F.floor("value"), F.lit(" threshold=1400 event="), F.col("event_id"))
    line = F.when(F.col("event_type") == "error", warn).when(F.col("event_type") == "view", "# buffer-fill events").otherwise(" ")
    path = scratch_path(spark, "acquisition-log")
    e.select(line.alias("value")).write.text(path)
    lines = S.read_log_lines(spark, path).withColumn("event_id", F.regexp_extract("line", r"event=(\d+)", 1).cast("bigint"))
    return S.parse_buffer_warnings(lines, ["event_id"])


@query("log_coerce", sql("rec", """SELECT recording_id, CASE WHEN recording_id % 9 <> 0 THEN start_time END AS start_time, CASE WHEN recording_id % 10 <> 0 THEN round(duration_seconds, 6) END AS duration_seconds,
    has_video, recording_id % 4 IN (0, 1) AS has_trials FROM rec"""))
def log_coerce(spark, d):
    i = F.col("recording_id")
    raw = rec(spark, d).select(
        "recording_id", F.when(i % 9 == 0, "soon").otherwise(F.col("start_time").cast("string")).alias("start_time"),
        F.when(i % 10 == 0, "n/a").otherwise(F.round("duration_seconds", 6).cast("string")).alias("duration_seconds"),
        F.when(F.col("has_video"), "TRUE").otherwise("no").alias("has_video"),
        F.when(i % 4 == 0, "1").when(i % 4 == 1, "Yes").when(i % 4 == 2, "0").otherwise("").alias("has_trials"))
    path = scratch_path(spark, "log-csv")
    raw.write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema("recording_id bigint, start_time string, duration_seconds string, has_video string, has_trials string").csv(path)
    return K.coerce_log(back)


UPSERT = dict(
    o="""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'gone' || (doc_id % 5000) ELSE 'm' || (doc_id % 5000) END AS metadata_file, 'old' || doc_id AS expt_id, 'u' || quality AS rating FROM labels""",
    od="SELECT metadata_file, arg_max(expt_id, doc_id) AS expt_id, arg_max(rating, doc_id) AS rating FROM o WHERE metadata_file <> '' GROUP BY 1",
    n="SELECT 'm' || (doc_id % 5000) AS metadata_file, arg_max(source, doc_id) AS expt_id, arg_max(lang, doc_id) AS genotype, arg_max(n_chars, doc_id)::VARCHAR AS duration_seconds FROM documents GROUP BY 1",
)


UPSERTED = sql("", """SELECT coalesce(od.metadata_file, n.metadata_file) AS metadata_file, CASE WHEN n.metadata_file IS NULL THEN od.expt_id ELSE n.expt_id END AS expt_id, coalesce(n.genotype, '') AS genotype,
    coalesce(n.duration_seconds, '') AS duration_seconds, coalesce(od.rating, '') AS rating,
    CASE WHEN n.metadata_file IS NULL THEN 'kept' WHEN od.metadata_file IS NULL THEN 'added' ELSE 'updated' END AS change FROM od FULL JOIN n ON od.metadata_file = n.metadata_file""", **UPSERT)


def upserted(spark, d):
    """Labels are the old log, documents the fresh metadata. Every fourth row of the old log names a file that has vanished."""
    i = F.col("doc_id")
    key = F.concat(F.lit("m"), i % 5000)
    old = table(spark, d, "labels").select(F.when(i % 13 == 0, "").when(i % 4 == 0, F.concat(F.lit("gone"), i % 5000)).otherwise(key).alias("metadata_file"), F.concat(F.lit("old"), i).alias("expt_id"),
                                           F.concat(F.lit("u"), F.col("quality")).alias("rating"), i.alias("row_no"))
    new = table(spark, d, "documents").select(key.alias("metadata_file"), F.col("source").alias("expt_id"), F.col("lang").alias("genotype"), F.col("n_chars").alias("duration_seconds"), i.alias("row_no"))
    return K.upsert_log(old, new, owned=["expt_id", "genotype", "metadata_file", "duration_seconds"])


@query("log_upsert", UPSERTED)
def log_upsert(spark, d):
    return K.log_order(upserted(spark, d))


@query("log_sink", UPSERTED)
def log_sink(spark, d):
    """The merged log written as CSV, owned columns first, and read back."""
    path = scratch_path(spark, "log")
    K.write_log(upserted(spark, d), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


WHERE = """regexp_matches(expt_id, '(?i)customer#0000000?[0-4]') AND genotype IN ('1-URGENT', '2-HIGH') AND has_video AND start_time >= TIMESTAMP '1996-01-01' AND start_time < TIMESTAMP '1999-01-01'"""


def shown():
    return K.catalog_filter("customer#0000000?[0-4]", {"genotype": ["1-URGENT", "2-HIGH"], "owner": []}, ["has_video"], "1996-01-01", "1998-12-31")


@query("catalog_filter", sql("rec", f"SELECT recording_id, expt_id, genotype FROM rec WHERE {WHERE}"))
def catalog_filter(spark, d):
    return rec(spark, d).where(shown()).select("recording_id", "expt_id", "genotype")


@query("catalog_kpis", sql("rec", f"""SELECT count(*) AS n_shown, count(DISTINCT expt_id) AS n_ids, round(sum(duration_seconds) / 3600, 4) AS hours, count(*) FILTER (WHERE has_video) AS n_video,
    count(*) FILTER (WHERE has_trials) AS n_trials, (SELECT count(*) FROM rec) AS n_total FROM rec WHERE {WHERE}"""))
def catalog_kpis(spark, d):
    return K.kpis(rec(spark, d), shown()).withColumn("hours", F.round("hours", 4))


@query("facets", sql("rec", """SELECT DISTINCT 'genotype' AS facet, genotype AS value FROM rec UNION SELECT DISTINCT 'clamp_mode', clamp_mode FROM rec WHERE clamp_mode IS NOT NULL
    UNION SELECT DISTINCT 'cell_type', cell_type FROM rec"""))
def facets(spark, d):
    return K.facets(rec(spark, d), ["genotype", "clamp_mode", "cell_type"])
