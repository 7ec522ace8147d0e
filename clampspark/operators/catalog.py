"""The experiment catalogue: companion files, log maintenance, filters and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LOG_COLUMNS
from ..functions.scalar import truthy


# ---- files ----------------------------------------------------------------------------------

def _stem(name: str) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def recording_mode(recordings: DataFrame) -> DataFrame:
    """Trial recordings have trials and no continuous data; attributes left out take defaults."""
    r = recordings.withColumn("mode", F.when(F.col("has_trials") & ~F.col("has_continuous"), "trial").otherwise("continuous"))
    return r.withColumn("start_time", F.coalesce("start_time", F.lit("")))


def assemble(recordings: DataFrame, channels: DataFrame, trials: DataFrame, events: DataFrame, sidecars: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings put together from landed tables: ``(recordings, trials, events)``.

    A recording has its mode, a start time (empty where there is none), its channels in order as arrays ``channel_names, display_scales, units``, its number of trials
    or events, and whether it has a sidecar. Trials belong to trial recordings and events to continuous ones; rows of the other mode are
    left out. A trial lacking a number or a stimulus has -1, lacking a text has the empty text. A recording without channels has empty arrays.
    """
    r = recording_mode(recordings)
    mode = r.select(*keys, "mode")
    fields = ["name", "display_scale", "units"]
    ch = channels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel_index", *fields))).alias("_c"))  # a fixed small number per recording
    t = trials.join(mode.where("mode = 'trial'").select(*keys), keys)
    numbers, texts = ("trial_index", "stimulus_index"), ("stimulus_name", "onset_time", "video_file")
    rest = [c for c in t.columns if c not in (*numbers, *texts)]
    t = t.select(*rest, *[F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")).alias(c) for c in numbers if c in t.columns],
                 *[F.coalesce(c, F.lit("")).alias(c) for c in texts if c in t.columns])
    e = events.join(mode.where("mode = 'continuous'").select(*keys), keys)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    out = r.join(ch, keys, "left").join(count(t, "n_trials"), keys, "left").join(count(e, "n_events"), keys, "left").join(sidecars.select(*keys, F.lit(True).alias("has_sidecar")).distinct(), keys, "left")
    empty = {"name": "string", "display_scale": "double", "units": "string"}
    lists = [F.coalesce(F.col("_c")[f], F.array().cast(f"array<{empty[f]}>")).alias(n) for f, n in zip(fields, ("channel_names", "display_scales", "units"))]
    zero = F.lit(0).cast("bigint")
    return out.select(*r.columns, *lists, F.coalesce("n_trials", zero).alias("n_trials"), F.coalesce("n_events", zero).alias("n_events"), F.coalesce("has_sidecar", F.lit(False)).alias("has_sidecar")), t, e


def continuous_only(recordings: DataFrame) -> DataFrame:
    """Rows a continuous reader accepts; a trial recording raises."""
    ok = F.when(F.col("mode") == "continuous", F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not a continuous recording: "), F.col("recording_id").cast("string"))).cast("boolean"))
    return recordings.where(ok)


def companions(files: DataFrame) -> DataFrame:
    """Sidecar, videos and log of every store file in ``files(dir, name)``.

    Sidecar candidates in order: ``<stem>.json``, ``<stem>_metadata.json`` and, for a trials file,
    ``<base>_metadata.json``. Videos start with the base stem: each video offers all its prefixes,
    so the prefix match is an equi-join.
    """
    h5 = files.where(F.col("name").endswith(".h5")).select("dir", "name", _stem("name").alias("stem"))
    h5 = h5.withColumn("base", F.regexp_replace("stem", "_trials$", ""))
    cand = h5.select("dir", "stem", F.posexplode(F.array(
        F.concat("stem", F.lit(".json")), F.concat("stem", F.lit("_metadata.json")),
        F.when(F.col("stem").endswith("_trials"), F.concat("base", F.lit("_metadata.json"))))).alias("rank", "cand"))
    names = files.select("dir", F.col("name").alias("cand"))
    side = cand.where("cand IS NOT NULL").join(names, ["dir", "cand"]).groupBy("dir", "stem").agg(F.min_by("cand", "rank").alias("sidecar"))
    avi = files.where(F.col("name").endswith(".avi")).select("dir", F.col("name").alias("video"), _stem("name").alias("_v"))
    avi = avi.select("dir", "video", F.explode(F.sequence(F.lit(1), F.length("_v"))).alias("_n"), "_v").select("dir", "video", F.expr("left(_v, _n)").alias("base"))
    vids = h5.join(avi, ["dir", "base"]).groupBy("dir", "stem").agg(F.count(F.lit(1)).alias("n_videos"), F.min("video").alias("first_video"))
    logs = h5.select("dir", "stem", F.concat("stem", F.lit("_acquisition.log")).alias("cand")).join(names, ["dir", "cand"]).select("dir", "stem", F.col("cand").alias("log"))
    at = ["dir", "stem"]
    return h5.join(side, at, "left").join(vids, at, "left").join(logs, at, "left").select(
        *at, "sidecar", F.coalesce("n_videos", F.lit(0)).cast("bigint").alias("n_videos"), "first_video", "log")


def find_video(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Video of each recording: the sidecar's, else the trial's, else the first that starts with
    the recording's stem; the first two count only if the file exists. ``recordings`` has
    ``recording_id, dir, stem, sidecar_video, trial_video``."""
    at = files.select("dir", "name")
    r = recordings.withColumn("base", F.replace("stem", F.lit("_metadata"), F.lit("")))
    a = r.join(at.withColumnRenamed("name", "sidecar_video").withColumn("_a", F.lit(True)), ["dir", "sidecar_video"], "left")
    a = a.join(at.withColumnRenamed("name", "trial_video").withColumn("_t", F.lit(True)), ["dir", "trial_video"], "left")
    avi = at.where(F.col("name").endswith(".avi")).select("dir", F.col("name").alias("_video"), _stem("name").alias("_v"))
    avi = avi.select("dir", "_video", F.explode(F.sequence(F.lit(1), F.length("_v"))).alias("_n"), "_v").select("dir", "_video", F.expr("left(_v, _n)").alias("base"))
    first = avi.groupBy("dir", "base").agg(F.min("_video").alias("_first"))
    a = a.join(first, ["dir", "base"], "left")
    return a.select("recording_id", F.coalesce(
        F.when(F.col("_a"), F.col("sidecar_video")), F.when(F.col("_t"), F.col("trial_video")), F.col("_first")).alias("video"))


def rollup_by_extension(files: DataFrame) -> DataFrame:
    """Number of files and bytes per folder and extension."""
    return files.groupBy("dir", "extension").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").cast("bigint").alias("bytes"))


# ---- experiment log -------------------------------------------------------------------------

def upsert_log(existing: DataFrame, fresh: DataFrame, key: str = "metadata_file", owned: list[str] = LOG_COLUMNS,
               position: str = "row_no") -> DataFrame:
    """Merge fresh metadata into the log.

    Fresh values replace the owned columns; user columns and rows whose file has vanished stay.
    Rows with a blank key are dropped, the last of several rows with one key wins (``position``
    orders them). ``change`` is added, updated or kept. Blank text stands for a missing value.
    """
    user = [c for c in existing.columns if c not in owned and c != position]
    old = existing.where(F.coalesce(F.col(key), F.lit("")) != "")
    rest = [c for c in existing.columns if c not in (key, position)]
    old = old.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_o"))
    mine = [c for c in owned if c != key]
    new = fresh.groupBy(key).agg(F.max_by(F.struct(*mine), F.col(position)).alias("_n"))
    j = old.join(new, key, "full_outer")
    has_new, has_old = F.col("_n").isNotNull(), F.col("_o").isNotNull()
    blank = F.lit("")
    cols = []
    for c in owned:
        if c == key:
            cols.append(F.col(key))
        else:
            before = F.col(f"_o.{c}") if c in rest else F.lit(None)
            cols.append(F.coalesce(F.when(has_new, F.col(f"_n.{c}").cast("string")).otherwise(before.cast("string")), blank).alias(c))
    cols += [F.coalesce(F.col(f"_o.{c}").cast("string"), blank).alias(c) for c in user]
    change = F.when(has_new & has_old, "updated").when(has_new, "added").otherwise("kept")
    return j.select(*cols, change.alias("change"))


def log_order(log: DataFrame, key: str = "metadata_file") -> DataFrame:
    """Owned columns first, then user columns; rows by start time when the log has one, then key."""
    time = [F.coalesce(F.col("start_time").cast("string"), F.lit(""))] if "start_time" in log.columns else []
    return log.orderBy(*time, F.coalesce(F.col(key), F.lit("")))


def write_log(log: DataFrame, path: str, owned: list[str] = LOG_COLUMNS, key: str = "metadata_file") -> None:
    """The log as CSV: the owned columns it has first and in their order, then the user's in theirs; rows as :func:`log_order` puts them, over
    files that follow one another by name."""
    cols = [c for c in owned if c in log.columns] + [c for c in log.columns if c not in owned]
    log_order(log, key).select(*cols).write.option("header", True).option("escape", '"').csv(path)


def coerce_log(log: DataFrame) -> DataFrame:
    """Typed log: bad timestamps and numbers become null, flags are true only for true, 1, yes."""
    out = log
    for c in ("start_time", "end_time"):
        if c in log.columns:
            out = out.withColumn(c, F.col(c).try_cast("timestamp_ntz"))
    if "duration_seconds" in log.columns:
        out = out.withColumn("duration_seconds", F.col("duration_seconds").try_cast("double"))
    for c in ("has_video", "has_trials", "drug_applied"):
        if c in log.columns:
            out = out.withColumn(c, truthy(c))
    return out


def catalog_filter(search: str | None = None, one_of: dict[str, list[str]] | None = None,
                   flags: list[str] = (), first_day: str | None = None, last_day: str | None = None) -> Column:
    """Catalogue predicate: case-insensitive regular expression on the id, value lists, flags, and
    a day range that includes its last day. Used in ``where`` it reaches the scan."""
    out = F.lit(True)
    if search:
        out = out & F.coalesce(F.col("expt_id").cast("string").rlike(f"(?i){search}"), F.lit(False))
    for c, vals in (one_of or {}).items():
        if vals:
            out = out & F.col(c).isin(vals)
    for c in flags:
        out = out & F.col(c)
    if first_day and last_day:
        lo = F.lit(first_day).cast("timestamp_ntz")
        hi = F.lit(last_day).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
        out = out & (F.col("start_time") >= lo) & (F.col("start_time") < hi)
    return out


def kpis(log: DataFrame, shown: Column) -> DataFrame:
    """Headline figures of the rows shown, and how many there are in all; one pass, with one row
    per id before the last step."""
    s = F.coalesce(shown, F.lit(False))
    per_id = log.groupBy("expt_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(s).alias("_shown"), F.sum(F.when(s, F.col("duration_seconds"))).alias("_sec"),
        F.count_if(s & F.col("has_video")).alias("_video"), F.count_if(s & F.col("has_trials")).alias("_trials"))
    return per_id.groupBy().agg(
        F.sum("_shown").alias("n_shown"), F.count_if((F.col("_shown") > 0) & F.col("expt_id").isNotNull()).alias("n_ids"),
        (F.coalesce(F.sum("_sec"), F.lit(0.0)) / 3600).alias("hours"), F.sum("_video").alias("n_video"),
        F.sum("_trials").alias("n_trials"), F.sum("_all").alias("n_total"))


def facets(log: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values of each column as ``(facet, value)``, sorted within the facet."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return log.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct().orderBy("facet", "value")
