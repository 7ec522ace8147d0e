"""Vectorised helpers on Arrow text batches: bounded chunks, word boundaries, exact word ids."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACES
# Letters and digits of ASCII, and every byte of a longer UTF-8 sequence.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])

CHUNK_BYTES = 4 << 20


def whole(texts: pa.Array) -> pa.Array:
    """Text as plain UTF-8 strings; null becomes empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0]


_TUNED: list[bool] = []


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on between tasks, beside the heap of its executor.

    Large arrays are mapped on their own, so they leave when they are freed; what earlier tasks left is trimmed. Other C libraries do without.
    """
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        if not _TUNED:
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD: fixed at 128 KB otherwise, so arrays in use again and again would leave and fault in each time
            _TUNED.append(True)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def byte_strings(values: pa.LargeBinaryArray) -> list[bytes]:
    """Values of an array without nulls, in a third of the time of ``to_pylist``."""
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1].tolist()
    data = bytes(values.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(off, off[1:])]


def load_tokenizer(path: str):
    """The tokenizer of one task, without the library's cache of words: that outlives the tokenizer, some 5 MB for each task of a worker, and callers remember ids themselves."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    if hasattr(tok.model, "_resize_cache"):
        tok.model._resize_cache(0)
    return tok


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of at most ``limit`` bytes of text, one row at least, each with its texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = whole(batch.column(column))
        _, off = raw(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), texts.slice(at, end - at)
            at = end


@dataclass
class Words:
    """``ids[i]`` names word ``i`` exactly within this chunk; ``bounds[d]:bounds[d+1]`` are document ``d``'s."""
    ids: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array
    starts: np.ndarray
    ends: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of maximal runs of ``inside`` bytes that do not cross a document."""
    m = inside[buf]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(len(m) + 1, bool)
    edge[off[:-1]] = True
    edge[-1] = True
    start = m & edge[:-1]
    start[1:] |= m[1:] & ~m[:-1]
    end = m & edge[1:]
    end[:-1] |= m[:-1] & ~m[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def words(texts: pa.Array, inside: np.ndarray = WORD) -> Words:
    buf, off = raw(texts)
    s, e, bounds = spans(buf, off, inside)
    if not len(s):
        return Words(np.zeros(0, np.int64), bounds, pa.array([], pa.binary()), s, e)
    lens = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=lens[1:])
    data = buf[inside[buf]]
    enc = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(s), [None, pa.py_buffer(lens), pa.py_buffer(data)]).dictionary_encode()
    return Words(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, enc.dictionary, s, e)


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator."""
    h = h + M1
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    import xxhash
    f = xxhash.xxh3_64_intdigest
    return np.array([f(x, seed) for x in distinct.to_pylist()], np.uint64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def row_filter(make, limit: int = CHUNK_BYTES):
    """Function from a text column to a boolean one. ``make()`` gives, once per task, a function from an Arrow text array to a mask.

    Only that column travels to Python and one bit per row back; the other columns of a filtered table stay in the JVM.
    """
    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        mask = make()
        for texts in batches:
            out = [np.zeros(0, bool)]
            for part, _ in chunks([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=limit):
                out.append(mask(part.column(0)))
            yield pa.array(np.concatenate(out))
        del mask
        give_back()
    return keep


def small_batches(spark, rows: int = 1000) -> None:
    """Documents are long: fewer rows per Arrow batch keep both ends of the exchange with Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
