"""Stand-ins for recordings, events and protocols, built from the driver tables.

Each view exists twice: as a Spark function and as a named SQL fragment in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clampspark.operators.blocks import pack
from clampspark.operators.ordered import ordinal, segment_of
from clampspark.operators.store import Store, land
from clampspark.session import scratch_path

RATE = 1000          # one sample per millisecond, so that settings in ms stay readable
BLOCK = 1024
HALO = 11
KEY = ["recording_id"]
CH = ["recording_id", "channel_index"]
TRIAL = ["recording_id", "trial_index"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored_path(spark: SparkSession, d: str, name: str, build) -> str:
    """Land a derived table once per session in the shared folder, as an archive would hold it."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[at] = path
    return _STORED[at]


def stored(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    return spark.read.parquet(stored_path(spark, d, name, build))


def _sig(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.col("user_id").alias("recording_id"), "ts", "event_id", F.col("value").alias("v"), "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    s = ordinal(e, KEY, ["ts", "event_id"], F.date_trunc("minute", "ts"), "sample_index")
    return s.select("recording_id", "sample_index", "v", "event_type", "k")


def sample_path(spark: SparkSession, d: str) -> str:
    return stored_path(spark, d, "samples", lambda: _sig(spark, d))


def sig(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """One recording per user, one sample per event in time order."""
    return spark.read.parquet(sample_path(spark, d)).select("recording_id", "sample_index", "v", *extra)


_STORES: dict[tuple[str, str, str], Store] = {}


def block_store(spark: SparkSession, d: str, name: str, build, keys: list[str]) -> Store:
    """Land blocks and their nodes once per session."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _STORES:
        _STORES[at] = land(build(), scratch_path(spark, name), keys, BLOCK)
    return _STORES[at]


def sig_store(spark: SparkSession, d: str) -> Store:
    return block_store(spark, d, "blocks", lambda: pack(sig(spark, d), KEY, BLOCK, HALO), KEY)


def sig_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sig_store(spark, d).blocks


def channel_store(spark: SparkSession, d: str, channel: int) -> Store:
    """One channel of the two-channel recordings: 2 the command, 0 the response."""
    one = lambda: two_channels(spark, d).where(F.col("channel_index") == channel).drop("channel_index")
    return block_store(spark, d, f"channel-{channel}-blocks", lambda: pack(one(), KEY, BLOCK, HALO), KEY)


def channel_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Both channels' blocks, landed."""
    return channel_store(spark, d, 2).blocks.unionByName(channel_store(spark, d, 0).blocks)


def dealt_store(spark: SparkSession, d: str) -> Store:
    """Samples dealt to five channels by ``k``, in volts; the samples of other channels are missing."""
    def build():
        s = sig(spark, d, "k").select("recording_id", (F.col("k") % 5).alias("channel_index"), "sample_index", (F.col("v") / 40).alias("v"))
        return pack(s, CH, BLOCK, HALO)
    return block_store(spark, d, "dealt-blocks", build, CH)


def trial_store(spark: SparkSession, d: str) -> Store:
    """Trials of 64 samples, one block each."""
    none = F.array().cast("array<double>")
    zero = F.lit(0).cast("bigint")
    return block_store(spark, d, "trial-blocks", lambda: blk(spark, d).select(
        "recording_id", "trial_index", "vec_id", zero.alias("block_no"), zero.alias("block_start"), "samples", none.alias("before"), none.alias("after")), TRIAL)


def two_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channel 2 is the command ``2 v - 100``, channel 0 the response ``k - 70``."""
    s = sig(spark, d, "k").select("recording_id", "sample_index", F.explode(F.array(
        F.struct(F.lit(2).alias("channel_index"), (F.col("v") * 2 - 100).alias("v")),
        F.struct(F.lit(0).alias("channel_index"), (F.col("k") - 70.0).alias("v")))).alias("c"))
    return s.select("recording_id", "c.channel_index", "sample_index", "c.v")


def sweep_store(spark: SparkSession, d: str) -> Store:
    """Each trial's magnitudes in falling order, as a sweep of one block."""
    falling = F.reverse(F.array_sort(F.transform("samples", lambda x: F.abs(x))))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<double>")
    return block_store(spark, d, "sweep-blocks", lambda: blk(spark, d).select(
        "recording_id", "trial_index", zero.alias("block_no"), zero.alias("block_start"), falling.alias("samples"), none.alias("before"), none.alias("after")), TRIAL)


def lengths(samples: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))


def rec_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Samples per recording straight from the table: needs no ordinals."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("recording_id")).agg(F.count(F.lit(1)).alias("n_samples"))


def evt(spark: SparkSession, d: str) -> DataFrame:
    """Apply and clear events; the sample index is also the log order."""
    s = sig(spark, d, "event_type", "k").where("event_type IN ('signup', 'purchase')")
    return s.select(
        "recording_id", F.col("sample_index").alias("event_seq"), "sample_index",
        F.when(F.col("event_type") == "signup", "apply").otherwise("clear").alias("event_type"),
        (F.col("k") % 3).alias("stimulus_index"), F.concat(F.lit("stim"), F.col("k") % 3).alias("stimulus_name"),
    )


def proto(spark: SparkSession, d: str) -> DataFrame:
    """Protocol runs; each lists two stimuli, and even ``k`` announces a leading pulse."""
    s = sig(spark, d, "event_type", "k").where("event_type = 'view'")
    stim = [F.struct(F.lit("staircase").alias("type"), (-10.0 - F.col("k") % 50).alias("min_pA"),
                     (10.0 + F.col("k")).alias("max_pA"), F.lit(5.0 * (i + 1)).alias("step_pA"),
                     (F.col("k") % 3).alias("staircase_repeats")) for i in range(2)]
    return s.select("recording_id", F.col("sample_index").alias("run_seq"), F.col("sample_index").alias("start_sample"),
                    (F.col("k") % 2 == 0).alias("has_pulse"), F.array(*stim).alias("stimuli"))


def blk(spark: SparkSession, d: str) -> DataFrame:
    """Trials of 64 samples: ``(recording_id, trial_index, vec_id, samples)``."""
    e = table(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("recording_id"), "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    return ordinal(e, KEY, ["vec_id"], segment_of("vec_id", 4096), "trial_index")


def pulse(spark: SparkSession, d: str) -> DataFrame:
    """Pulses of an order: its line items by part, amplitude from the quantity."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("recording_id"), (F.col("l_quantity") - 25).alias("amplitude"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "amplitude", "l_shipdate"]
    return ordinal(li, KEY, order, segment_of("l_partkey", 1024), "pulse_seq").select("recording_id", "pulse_seq", "amplitude")


def stim(spark: SparkSession, d: str) -> DataFrame:
    """Stimulus definitions: one per part, one protocol per brand."""
    size = F.col("p_size").cast("double")
    kind = (F.when(F.col("p_type").isin("ECONOMY", "SMALL", "MEDIUM"), "staircase")
            .when(F.col("p_type").isin("LARGE", "STANDARD"), "voltage_step").otherwise("baseline"))
    return table(spark, d, "part").select(
        F.col("p_brand").alias("protocol"), F.col("p_partkey").alias("stimulus_index"), F.col("p_name").alias("name"),
        kind.alias("type"), (-size).alias("min_pA"), size.alias("max_pA"),
        (1.0 + F.col("p_partkey") % 5).alias("step_pA"), (F.col("p_size") % 7 * 10.0).alias("step_width_ms"),
        (F.col("p_size") % 3 * 5.0).alias("gap_ms"), (F.col("p_partkey") % 3).cast("int").alias("staircase_repeats"),
        (size - 25).alias("step_mV"), (F.col("p_size") % 4 * 100.0).alias("duration_ms"),
        F.when(F.col("p_type").isin("LARGE", "PROMO"), "voltage_clamp").otherwise("current_clamp").alias("clamp_mode"),
        F.lit(20.0).alias("pre_ms"), F.lit(30.0).alias("post_ms"), F.lit(100.0).alias("iti_ms"), F.lit(25.0).alias("mv_per_volt"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit(-50.0)).alias("pulse_pA"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit(40.0)).alias("pulse_ms"),
    )


def rec(spark: SparkSession, d: str) -> DataFrame:
    """Recording dimension from orders and their customers."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("recording_id"), F.col("c_name").alias("expt_id"), F.col("n_name").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "voltage_clamp").when(F.col("o_orderstatus") == "O", "current_clamp").alias("clamp_mode"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"), F.col("o_orderpriority").alias("genotype"),
        (F.col("o_totalprice") / 100).alias("duration_seconds"), F.col("c_mktsegment").alias("cell_type"),
        (F.col("o_orderkey") % 3 == 0).alias("has_video"), (F.col("o_orderkey") % 4 == 0).alias("has_trials"),
        (F.col("o_orderkey") % 5 == 0).alias("drug_applied"), F.col("c_acctbal").alias("acctbal"),
    )


# name: (fragments it needs, body)
CTE: dict[str, tuple[str, str]] = {
    "sig": ("", """SELECT user_id AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_index,
        value AS v, event_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events"""),
    "len": ("", "SELECT user_id AS recording_id, count(*) AS n_samples FROM events GROUP BY user_id"),
    "two": ("sig", """SELECT recording_id, sample_index, v * 2 - 100 AS cmd, k - 70.0::DOUBLE AS vm FROM sig"""),
    "evt": ("sig", """SELECT recording_id, sample_index AS event_seq, sample_index, CASE event_type WHEN 'signup' THEN 'apply' ELSE 'clear' END AS event_type,
        k % 3 AS stimulus_index, 'stim' || (k % 3) AS stimulus_name FROM sig WHERE event_type IN ('signup', 'purchase')"""),
    "proto": ("sig", "SELECT recording_id, sample_index AS run_seq, sample_index AS start_sample, k % 2 = 0 AS has_pulse, k FROM sig WHERE event_type = 'view'"),
    "blk": ("", """SELECT CAST(label AS BIGINT) AS recording_id, vec_id, embedding,
        CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS trial_index FROM embeddings"""),
    "bs": ("blk", """SELECT recording_id, trial_index, vec_id, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS sample_index,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM blk"""),
    "pulse": ("", """SELECT l_orderkey AS recording_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
        l_extendedprice, l_discount, l_tax, l_quantity, l_shipdate) - 1 AS BIGINT) AS pulse_seq, l_quantity - 25 AS amplitude FROM lineitem"""),
    "stim": ("", """SELECT p_brand AS protocol, p_partkey AS stimulus_index, p_name AS name,
        CASE WHEN p_type IN ('ECONOMY','SMALL','MEDIUM') THEN 'staircase' WHEN p_type IN ('LARGE','STANDARD') THEN 'voltage_step' ELSE 'baseline' END AS type,
        -p_size::DOUBLE AS min_pa, p_size::DOUBLE AS max_pa, 1.0::DOUBLE + p_partkey % 5 AS step_pa, p_size % 7 * 10.0::DOUBLE AS step_width_ms,
        p_size % 3 * 5.0::DOUBLE AS gap_ms, CAST(p_partkey % 3 AS INTEGER) AS staircase_repeats, p_size - 25.0::DOUBLE AS step_mv,
        p_size % 4 * 100.0::DOUBLE AS duration_ms, CASE WHEN p_type IN ('LARGE','PROMO') THEN 'voltage_clamp' ELSE 'current_clamp' END AS clamp_mode,
        20.0::DOUBLE AS pre_ms, 30.0::DOUBLE AS post_ms, 100.0::DOUBLE AS iti_ms, 25.0::DOUBLE AS mv_per_volt,
        CASE WHEN p_partkey % 2 = 0 THEN -50.0::DOUBLE END AS pulse_pa, CASE WHEN p_partkey % 2 = 0 THEN 40.0::DOUBLE END AS pulse_ms FROM part"""),
    "rec": ("", """SELECT o_orderkey AS recording_id, c_name AS expt_id, n_name AS owner,
        CASE o_orderstatus WHEN 'F' THEN 'voltage_clamp' WHEN 'O' THEN 'current_clamp' END AS clamp_mode, CAST(o_orderdate AS TIMESTAMP) AS start_time,
        o_orderpriority AS genotype, o_totalprice / 100 AS duration_seconds, c_mktsegment AS cell_type, o_orderkey % 3 = 0 AS has_video,
        o_orderkey % 4 = 0 AS has_trials, o_orderkey % 5 = 0 AS drug_applied, c_acctbal AS acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
}


def sql(needs: str, body: str, **local: str) -> str:
    """``body`` preceded by the fragments it needs; ``local`` adds fragments of its own, in order."""
    done: list[str] = []

    def visit(n: str) -> None:
        deps, text = CTE[n]
        for x in deps.split():
            visit(x)
        part = f"{n} AS ({text})"
        if part not in done:
            done.append(part)

    for n in needs.split():
        visit(n)
    done += [f"{n} AS ({t})" for n, t in local.items()]
    return ("WITH " + ",\n".join(done) + "\n" if done else "") + body
