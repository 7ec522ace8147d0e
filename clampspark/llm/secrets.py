"""Secret scan over a ledger of contents, in DataFrame operations only.

Every version of every text is named by the SHA-256 of its content (its blob). The ledger holds which (blob, rule version)
pairs have been scanned and what was found. A run scans only pairs that the ledger lacks, each blob once however many paths
or copies have it, appends to the ledger, and joins the findings back to all paths. A new rule version makes every blob
unseen for that rule alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clampspark.session import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and non-overlapping; a match counts if group ``group`` has ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
SCANNED = "blob_id binary, rules array<string>"
FOUND = "blob_id binary, kind string, rule string, start int, stop int"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _ledger(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(f"{path}/{part}")
    return spark.createDataFrame([], schema)


def _fast(rule: Rule) -> str:
    """A run shorter than needed is dropped whole, so plain runs may be asked for at full length; ``assign`` may not."""
    return f"[0-9a-f]{{{rule.least},}}" if rule.pattern == "[0-9a-f]+" else rule.pattern


def _inner(rule: Rule):
    return (lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group))) if rule.group else (lambda x: F.length(x))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs(blob_id, text, pending)`` -> ``FOUND`` rows of the pending rules. Positions are code points.

    Lengths of matches and of what lies between them add up to positions, within (blob, rule).
    """
    hit = {r.name: F.when(F.array_contains("pending", r.name), F.regexp_extract_all("text", F.lit(_fast(r)), F.lit(0))) for r in rules}
    cols = blobs.select("blob_id", "text", *[m.alias(f"m{i}") for i, m in enumerate(hit.values())])
    some = [F.when(F.size(F.col(f"m{i}")) > 0, F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.name).alias("rule"),
        F.arrays_zip(F.transform(F.slice(F.split("text", _fast(r), -1), F.lit(1), F.size(F.col(f"m{i}"))), lambda x: F.length(x)).alias("gap"),
                     F.transform(F.col(f"m{i}"), lambda x: F.length(x)).alias("size"),
                     F.transform(F.col(f"m{i}"), _inner(r)).alias("inner")).alias("hits")))
            for i, r in enumerate(rules)]
    found = cols.select("blob_id", F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("f"))
    found = found.select("blob_id", "f.kind", "f.rule", F.posexplode("f.hits").alias("k", "h"))
    order = Window.partitionBy("blob_id", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("h.gap") + F.col("h.size")).over(order).cast("int")
    least = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.least)])
    found = found.select("blob_id", "kind", "rule", (stop - F.col("h.size")).alias("start"), stop.alias("stop"), F.col("h.inner").alias("inner"))
    return found.where(F.col("inner") >= least[F.col("rule")]).drop("inner")


def scan(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths(path_id, text)`` and the ledger's folder -> ``(path_id, blob_id, findings)``, one row per row of ``paths``.

    ``findings`` is an array of ``(start, kind_no, kind, stop)`` in order, ``kind_no`` the place of the rule in ``rules``. Null text is the empty
    blob. Findings are written before the scanned mark: a run that dies in between is repeated, and repeated findings count once. An empty
    table writes nothing new. Only path_id and text are read.
    """
    spark = paths.sparkSession
    texts = paths.select("path_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = _ledger(spark, ledger, "scanned", SCANNED).groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    every = F.array(*[F.lit(r.name) for r in rules])
    # Copies meet in the map-side aggregation: one text per blob is shuffled.
    blobs = texts.groupBy(blob_id(F.col("text")).alias("blob_id")).agg(F.first("text").alias("text"))
    pending = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen")))
    unseen = blobs.join(seen, "blob_id", "left").withColumn("pending", pending).where(F.size("pending") > 0)
    marks = texts.select(blob_id(F.col("text")).alias("blob_id")).distinct().join(seen, "blob_id", "left").withColumn("rules", pending).where(F.size("rules") > 0)
    find(unseen.select("blob_id", "text", "pending"), rules).write.mode("append").parquet(f"{ledger}/found")
    marks.select("blob_id", "rules").write.mode("append").parquet(f"{ledger}/scanned")

    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    found = _ledger(spark, ledger, "found", FOUND).where(F.col("rule").isin([r.name for r in rules])).distinct()
    found = found.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", place[F.col("rule")].alias("kind_no"), "kind", "stop"))).alias("findings"))
    # Written, so that the join meets two plain shuffles and a blob with many paths can be split.
    found = materialise(found, "findings")
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,stop:int>>")
    out = texts.select("path_id", blob_id(F.col("text")).alias("blob_id")).join(found, "blob_id", "left")
    return out.select("path_id", "blob_id", F.coalesce("findings", none).alias("findings"))


def joined(findings: Column) -> Column:
    """``kind:start:end`` of all findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
