"""Documents cut into pieces of power-of-two length; a training sequence is one piece, so none crosses documents.

A document of ``L`` ids becomes ``L // longest`` pieces of the longest length and one piece per set bit of the rest,
longest first. Pieces of equal length form a bucket. No piece needs padding, and a batch is filled from one bucket.
The table is read once and not shuffled: pieces are numbered per bucket inside the task that cuts them.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clampspark.llm.repair import byte_characters
from clampspark.llm.text import chunks, column, load_tokenizer, raw

END = 1
LONGEST = 2048
CHUNK_BYTES = 4 << 20
KNOWN_WORDS = 400_000  # units whose ids a task remembers; beyond that it begins anew
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
LEVEL_BITS, PART_BITS = 58, 32


# Kinds of bytes: blank, letter, digit, other visible. Letters are those of ASCII and of U+00C0 to U+027F (two bytes each). Words with
# anything else, an apostrophe or "<|" are encoded whole.
_KIND = np.full(256, 4, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x21:0x7F] = 3
_KIND[0x27] = 4
for _b in range(0x21, 0x7F):
    if chr(_b).isalnum():
        _KIND[_b] = 2 if chr(_b).isdigit() else 1
_KIND[0x80:0xC0] = _KIND[0xC3:0xCA] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# The multiplication and division signs, the dotted capital I (two characters once lowered), and what control strings begin with.
_HARD = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"<|")


def units(buf: np.ndarray, off: np.ndarray):
    """Bytes of what is encoded on its own, its lengths, whether it is a hard word, and where each document's begin."""
    kind = _KIND[buf]
    word, edge = kind != 0, np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = word & edge[:-1]
    first[1:] |= word[1:] & ~word[:-1]
    bad = kind == 4
    for pair in _HARD:
        bad[:-1] |= (buf[:-1] == pair[0]) & (buf[1:] == pair[1])
    start = kind == 2
    start[1:] |= kind[1:] != kind[:-1]
    start &= word
    data = _LOWER[buf]
    hard = None
    if bad.any():
        number = np.cumsum(first)
        hard = np.zeros(int(number[-1]) + 1, bool)
        hard[number[bad]] = True
        hard = hard[number] & word
        start &= ~hard
        data = np.where(hard, buf, data)  # case is kept: a control string must not arise from lowering one
    start |= first
    s = np.flatnonzero(start)
    cuts = np.searchsorted(np.flatnonzero(word), s) if not word.all() else s
    cuts = np.append(cuts, np.count_nonzero(word))
    return data[word], cuts, np.zeros(len(s), bool) if hard is None else hard[s], np.searchsorted(s, off)


def encoder(path: str):
    """Function from an Arrow text array to (ids, lengths), equal to encoding each text on its own.

    This vocabulary drops white space and splits what is between into runs of letters, single digits and runs of other marks. ASCII
    text is cut there, and each distinct unit is encoded once.
    """
    tok = load_tokenizer(path)
    model, as_text = tok.model, byte_characters()
    known: dict[bytes, int] = {}
    flat, begin, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(easy: list[bytes], hard: list[bytes]) -> None:
        """An easy unit is one pre-token, which the model takes as it is; hard words pass the whole tokenizer."""
        nonlocal flat, begin, size
        found = [[t.id for t in model.tokenize((x if x.isascii() else x.decode().lower().encode()).decode("latin-1").translate(as_text))] for x in easy]
        for at in range(0, len(hard), 200):
            found += [e.ids for e in tok.encode_batch_fast([w.decode() for w in hard[at:at + 200]], add_special_tokens=False)]
        known.update(zip([*easy, *hard], range(len(known), len(known) + len(found))))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32)])
        size = np.concatenate([size, np.fromiter(map(len, found), np.int64, len(found))])
        begin = np.cumsum(size) - size

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal flat, begin, size
        buf, off = raw(texts)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data, cuts, hard, bounds = units(buf, off)
        enc = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        index = enc.indices.to_numpy(zero_copy_only=False)
        whole = np.zeros(len(enc.dictionary), bool)
        whole[index] = hard
        distinct = enc.dictionary.to_pylist()
        if len(known) + len(distinct) > KNOWN_WORDS:
            known.clear()
            flat, begin, size = flat[:0], begin[:0], size[:0]
        at = np.fromiter((known.get(x, -1) for x in distinct), np.int64, len(distinct))
        fresh = at < 0
        if fresh.any():
            easy, alone = np.flatnonzero(fresh & ~whole), np.flatnonzero(fresh & whole)
            at[np.concatenate([easy, alone])] = len(known) + np.arange(len(easy) + len(alone))
            learn([distinct[i] for i in easy], [distinct[i] for i in alone])
        at = at[index]
        m = size[at]
        total = np.concatenate([[0], np.cumsum(m)])
        take = np.arange(total[-1]) + np.repeat(begin[at] - total[:-1], m)
        return flat[take], np.diff(total[bounds])

    return encode


def cut(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of documents -> (document, start, length) of their pieces, in order."""
    whole, rest = lengths // longest, lengths % longest
    doc = [np.repeat(np.arange(len(lengths)), whole)]
    start = [(np.arange(len(doc[0])) - np.repeat(np.cumsum(whole) - whole, whole)) * longest]
    size = [np.full(len(doc[0]), longest, np.int64)]
    bit = longest >> 1
    while bit:
        has = np.flatnonzero(rest & bit)
        doc.append(has)
        start.append(whole[has] * longest + (rest[has] & ~(2 * bit - 1)))
        size.append(np.full(len(has), bit, np.int64))
        bit >>= 1
    doc, start, size = np.concatenate(doc), np.concatenate(start), np.concatenate(size)
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def pieces(docs: DataFrame, tokenizer: str, end: int = END, longest: int = LONGEST) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece (``SCHEMA``); ``ids`` are little-endian unsigned 32-bit ids.

    ``sequence_id`` is (bucket, input partition, number within both), so ids of one bucket are one range. ``docs`` should be a
    table as read, whose partitions come out alike when a task is repeated. Null text is empty and has the end id alone;
    null and repeated doc_ids are documents of their own; an empty table has no pieces; other columns are ignored.
    A document is encoded whole in one task.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("_part"))

    def run(batches):
        encode, given = encoder(tokenizer), np.zeros(longest.bit_length(), np.int64)
        for chunk, texts in chunks(batches, limit=CHUNK_BYTES):
            ids, lens = encode(texts)
            total = lens + 1
            out = np.full(len(ids) + len(lens), end, "<u4")
            mask = np.ones(len(out), bool)
            mask[np.cumsum(total) - 1] = False
            out[mask] = ids
            doc, start, size = cut(total, longest)
            level = np.log2(size).astype(np.int64)
            number = np.zeros(len(size), np.int64)
            for v in range(len(given)):
                hit = np.flatnonzero(level == v)
                number[hit] = given[v] + np.arange(len(hit))
                given[v] += len(hit)
            part = column(chunk, "_part")[0].as_py()
            # Pieces follow one another as the ids do.
            bounds = np.concatenate([[0], np.cumsum(size)]) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
            for a in range(0, len(size), 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([
                    column(chunk, "doc_id").take(pa.array(doc[s])), pa.array(start[s]), pa.array(size[s]), pc.cast(data[s], pa.binary()), pa.array(total[doc[s]]),
                    pa.array((level[s] << LEVEL_BITS) | (part << PART_BITS) | number[s]), pa.array(np.zeros(len(size[s]), np.int64))],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return src.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """One folder per bucket (``length=...``), as a loader reads them."""
    pieces(docs, tokenizer, **options).write.partitionBy("length").parquet(path)


def batch_no(tokens: int) -> Column:
    """Batch of a sequence: ``tokens`` ids of one bucket and input partition; the last one of both may be short."""
    per = F.greatest(F.floor(F.lit(tokens) / F.col("length")), F.lit(1)).cast("long")
    number = F.col("sequence_id").bitwiseAND(F.lit((1 << PART_BITS) - 1).cast("long"))
    return (F.col("sequence_id") - number) + F.floor(number / per).cast("long")


def batches(spark: SparkSession, path: str, tokens: int, length: int) -> DataFrame:
    """Sequences of one bucket with their ``batch_id``; reads that bucket's folder alone."""
    return spark.read.parquet(path).where(F.col("length") == length).withColumn("batch_id", batch_no(tokens))
