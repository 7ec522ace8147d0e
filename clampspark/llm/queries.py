"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from clampspark.llm import chat, decontaminate, lang, mixing, packing, quality, query, recompress, repair, secrets, simhash, structure, whitening, winnow
from clampspark.llm.text import small_batches
from clampspark.session import scratch_path


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def vocab(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def bucket(n: int) -> str:
    return f"pmod(crc32(cast(cast(doc_id as string) as binary)), {n})"


@query("op1_secrets")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of every document, by way of a new ledger: see ``secrets.scan``."""
    paths = table(spark, d, "documents").select(F.col("doc_id").alias("path_id"), "text")
    found = secrets.scan(paths, scratch_path(spark, "ledger"))
    base = F.filter("findings", lambda f: f["kind_no"] < len(secrets.BASE))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("path_id").alias("doc_id"), *[count(r.kind) for r in secrets.BASE],
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


@query("op2_repair")
def op2(spark: SparkSession, d: str) -> DataFrame:
    """Encoded, Re-Pair compressed, written, and read back: see ``repair``."""
    path = scratch_path(spark, "shards")
    repair.write(table(spark, d, "documents"), path, vocab("byte_bpe_50k.json"))
    return repair.read(spark, path)


@query("op3_winnowing")
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and its edited text: see ``winnow.neighbours``."""
    return winnow.neighbours(table(spark, d, "documents"))


@query("op4_string_tiling")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Contaminated (document, item) pairs: see ``decontaminate.contaminated``."""
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op5_simhash")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document: see ``simhash.near_duplicates``."""
    out = simhash.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


@query("op6_language")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """Predicted language of every document; learned from the other four folds."""
    docs = table(spark, d, "documents")
    model = lang.train(docs, vocab("byte_bpe_multi_50k.tiktoken"), keep=f"coalesce({bucket(5)}, 0) <> 0")
    held = docs.select("doc_id", "text", "lang")
    out = lang.predict(held, model)
    return out.select("doc_id", F.coalesce(F.expr(f"{bucket(5)} = 0"), F.lit(True)).alias("held_out"), "lang_pred", "score")


@query("op7_recompression")
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Every document without passages of 13 words that a smaller doc_id has: see ``recompress.repeats``."""
    return recompress.repeats(table(spark, d, "documents"))


@query("op8_compression_quality")
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Quality score of every document; learned from labels outside fold 2."""
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"), keep=f"{bucket(4)} <> 2")
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(F.expr(f"{bucket(4)} = 2"), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_chat")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation formatted and read back, with one that quotes control strings: see ``chat``."""
    real = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    quoted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = real.union(quoted).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    path = scratch_path(spark, "chat")
    chat.render(messages).write.parquet(path)
    out = chat.parse(spark.read.parquet(path)).withColumn("loss_text", F.array_join("loss_texts", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


@query("op10_fair_queueing")
def op10(spark: SparkSession, d: str) -> DataFrame:
    """What the mix takes of every document: see ``mixing.mix``."""
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op11_power_of_two")
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document, with the sequence it fills: see ``packing.pieces``."""
    out = packing.pieces(table(spark, d, "documents"), vocab("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_qdwh_whitening")
def op12(spark: SparkSession, d: str) -> DataFrame:
    """First four whitened coordinates of every embedding: see ``whitening``."""
    x = whitening.vectors(table(spark, d, "embeddings").select("vec_id", "embedding"))
    model = whitening.fit(x)
    if model is None:  # no usable vector: no rows
        model = whitening.Whitening(0, [0], np.zeros(0), np.zeros((1, 0)), 0.0, 0.0)
    return whitening.apply(x, model)


@query("op13_grammar_repair")
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Every damaged conversation with its faults, its cheapest repair and that repair's hash: see ``structure``."""
    conversations = table(spark, d, "conversations")
    landed, edits = structure.analyse(structure.damaged(conversations))
    return structure.digests(conversations, landed, edits)


@query("pipeline")
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The corpus pipeline of the repository top."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)
