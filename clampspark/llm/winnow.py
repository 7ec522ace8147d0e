"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; in every window of ``w`` neighbouring k-grams the smallest hash is kept, the rightmost
of equals, with its position. Two texts that share a passage of ``w + k - 1`` characters are sure to share a kept hash. A text
shorter than that is one window; a text shorter than ``k`` is a single gram; an empty text has no hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from clampspark.llm.text import chunks, column, mix

K = 32          # characters in a gram, a power of two
WINDOW = 64     # grams in a window, a power of two
PART_BYTES = 32 << 20
LEVEL = 2048    # parts cut in one step
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _grams(points: np.ndarray) -> np.ndarray:
    """Hash of the ``K`` code points from every position, by doubling."""
    h = mix(points.astype(np.uint64))
    size = 1
    for step in _STEP:
        if size >= K or len(h) <= size:
            break
        h = (h[:-size] * step) ^ (h[size:] >> np.uint64(7)) ^ (h[size:] << np.uint64(11))
        size *= 2
    return mix(h)


def _minima(value: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    return value


def winnow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept (hashes, positions) of one text's code points, in order of position."""
    n = len(points)
    if n < K:
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.uint64(int.from_bytes(hashlib.blake2b(points.astype("<u4").tobytes(), digest_size=8).digest(), "little"))
        return np.array([h & np.uint64(0xFFFFFFFFFF000000)]), np.zeros(1, np.int64)
    hashes, places = [], []
    block = (1 << 23) - 2 * (K + WINDOW)
    for at in range(0, n - K + 1, block):
        # 40 bits of hash over 24 bits of inverse place: the smallest value is the smallest hash, rightmost of equals.
        h = _grams(points[at:at + block + WINDOW + K - 2])
        value = (h & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64))
        least = _minima(value, WINDOW) if len(value) >= WINDOW else value.min(keepdims=True)
        least = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]
        place = (np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))).astype(np.int64) + at
        hashes.append(least & np.uint64(0xFFFFFFFFFF000000))
        places.append(place)
    h, p = np.concatenate(hashes), np.concatenate(places)
    p, first = np.unique(p, return_index=True)
    return h[first], p


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared among all hashes of two sorted sets; two empty fingerprints are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """Short name of a fingerprint: equal for equal hashes at equal places."""
    return hashlib.blake2b(hashes.tobytes() + places.astype("<i8").tobytes(), digest_size=16).hexdigest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, hashes, positions)``, arrays in order of position, one row per input row.

    Null text counts as empty; equal texts have equal arrays; repeated rows stay apart.
    """
    def run(batches):
        for chunk, texts in chunks(batches):
            got = [winnow(np.frombuffer(t.encode("utf-32-le"), "<u4")) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64())),
                                              pa.array([p for _, p in got], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<bigint>, positions array<bigint>")


LEAST = -(1 << 63)


def in_order(docs: DataFrame, part_bytes: int = PART_BYTES, level: int = LEVEL) -> DataFrame:
    """``(part, peek, doc_id, no, text)``: documents cut into parts of descending doc_id, each part followed by the first document(s) of the next.

    The cuts are quantiles of doc_id, moved to ids that exist; the driver and the tasks hold two numbers per part, the plan none. Beyond ``level`` parts they are taken
    in two steps, quantiles within quantiles, so parts stay near ``part_bytes`` at any size. A part's follower is a copy of the
    next part's head, so neighbours meet without a window over all rows: the texts are shuffled once. The last part is
    followed by the first document of all. A null doc_id comes last.
    """
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("no"), F.coalesce("text", F.lit("")).alias("text"))
    stat = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.max(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).alias("top")).first()
    n = max(1, -(-(stat["b"] or 0) // part_bytes))
    top = LEAST if stat["top"] is None else stat["top"]

    def quantiles(k: int):
        return F.percentile_approx("no", [i / k for i in range(1, k)], max(10_000, 8 * k))

    def numbered(cuts: np.ndarray):
        @pandas_udf("int")
        def part_of(no: pd.Series) -> pd.Series:
            return pd.Series((len(cuts) - np.searchsorted(cuts, no.to_numpy(), "left")).astype("int32"))
        return part_of("no")

    cuts = np.zeros(0, np.int64)
    if n > 1:
        cuts = np.unique(np.array([x for x in src.agg(quantiles(min(n, level)).alias("q")).first()["q"] if x < top], np.int64))
    if n > level:
        inner = src.groupBy(numbered(cuts).alias("first")).agg(quantiles(-(-n // level)).alias("q")).select(F.explode("q").alias("cut")).toPandas()["cut"].to_numpy()
        cuts = np.unique(np.concatenate([cuts, inner[inner < top]]))
    src = src.withColumn("part", numbered(cuts))
    # The approximate cuts only say where to cut; each part's head is looked up exactly.
    found = src.groupBy("part").agg(F.max("no").alias("head")).toPandas().sort_values("part") if n > 1 else pd.DataFrame({"part": [0], "head": [top]})
    parts, heads = found["part"].to_numpy(), found["head"].to_numpy(np.int64)

    @pandas_udf("part int, before int")
    def placed(part: pd.Series, no: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(parts, part.to_numpy())
        return pd.DataFrame({"part": at.astype("int32"), "before": np.where(heads[at] == no.to_numpy(), (at - 1) % len(heads), -1).astype("int32")})

    src = src.select("no", "text", placed("part", "no").alias("p"))
    mine = F.struct(F.col("p.part").alias("part"), F.lit(0).alias("peek"))
    copies = F.when(F.col("p.before") >= 0, F.array(mine, F.struct(F.col("p.before").alias("part"), F.lit(1).alias("peek")))).otherwise(F.array(mine))
    out = src.select("no", "text", F.explode(copies).alias("c")).select("c.part", "c.peek", "no", "text")
    return out.repartitionById(max(len(heads), 1), "part").sortWithinPartitions("part", "peek", F.col("no").desc(), "text")


def neighbours(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The next document is that of the next smaller doc_id (after the smallest: the largest). The edited text has its last floor(n/2) code points
    replaced by the first as many of the next text, or all of it. Null text counts as empty. Rows that repeat a doc_id follow each other in
    order of text. A single row is its own next document. Two empty fingerprints have likeness 1. One row per input row.
    """
    def finish(held, following):
        no, text, h, p = held[:4]
        n = len(text)
        edited = text[:n - n // 2] + following[1][:n // 2]
        eh, ep = winnow(np.frombuffer(edited.encode("utf-32-le"), "<u4"))
        return (None if no == LEAST else no, n, hashlib.sha256(edited.encode()).hexdigest(), digest(h, p), digest(eh, ep), likeness(held[4], np.unique(eh)), likeness(held[4], following[2]))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held, part, peeked = None, None, False
        for chunk, texts in chunks(batches):
            rows = []
            for no, q, peek, text in zip(column(chunk, "no").to_pylist(), column(chunk, "part").to_pylist(), column(chunk, "peek").to_pylist(), texts.to_pylist()):
                if peek and (held is None or part != q or peeked):
                    continue  # a further row of the same head, or no row of the part itself
                h, p = winnow(np.frombuffer(text.encode("utf-32-le"), "<u4"))
                u = np.unique(h)
                if held is not None and part == q:
                    rows.append(finish(held, (no, text, u)))
                held, part, peeked = (no, text, h, p, u), q, bool(peek)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return in_order(docs, part_bytes).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
