"""Quality score from compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes, each compressed with either dictionary. The two normalised sizes and their difference
go through a logistic curve, fitted on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.text import chunks, column

BLOCK = 1024
LEVEL = 3
DICT_BYTES = 1 << 16
SAMPLE_DOCS = 3000     # labelled rows per class, about; half for the dictionaries, half for the curve
SAMPLE_BLOCKS = 6000   # blocks per class that a dictionary is built from


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


@dataclass
class Model:
    """``good`` and ``bad`` are dictionaries; without either, ``prior`` is every text's score."""
    good: bytes
    bad: bytes
    prior: float
    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray

    def features(self, sizes: np.ndarray) -> np.ndarray:
        n = np.maximum(sizes[:, 2], 1.0)
        return np.stack([(sizes[:, 0] - sizes[:, 1]) / n, sizes[:, 1] / n, 1 / np.sqrt(n)], 1)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if not self.good or not len(self.weights):
            return np.full(len(sizes), self.prior)
        z = np.clip(self.features(sizes), self.low, self.high)
        return 1 / (1 + np.exp(-np.clip(_terms(self._unit(z)) @ self.weights, -35, 35)))

    def _unit(self, z: np.ndarray) -> np.ndarray:
        return 2 * (z - self.low) / np.maximum(self.high - self.low, 1e-9) - 1


def _terms(z: np.ndarray) -> np.ndarray:
    k = z.shape[1]
    return np.stack([np.ones(len(z)), *(z[:, i] for i in range(k)), *(z[:, i] * z[:, j] for i in range(k) for j in range(i, k))], 1)


def _compressors(model: Model):
    import zstandard as zs
    return [zs.ZstdCompressor(level=LEVEL, dict_data=_loaded(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (model.bad, model.good)]


def _loaded(raw: bytes):
    import zstandard as zs
    d = zs.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained dictionary; with too few samples their text itself serves as one."""
    import zstandard as zs
    try:
        return zs.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zs.ZstdError:
        return b"\0" + b"".join(samples)[-DICT_BYTES:]


def _sizes(texts: pa.Array, model: Model) -> np.ndarray:
    bad, good = _compressors(model)
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts.to_pylist()):
        t = t.encode()
        for b in blocks(t):
            out[i, 0] += len(bad.compress(b))
            out[i, 1] += len(good.compress(b))
        out[i, 2] = len(t)
    return out


def fit(docs: DataFrame, labels: DataFrame, keep: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)``; ``keep``: SQL condition on label rows. Reads a bounded sample of labelled rows.

    Rows are chosen by a hash of doc_id. Labels other than 0 and 1 and null doc_ids are not used. With rows of one class only, or
    none, every score is the share of label 1 (0.5 without labels).
    """
    rows = labels.select("doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL")
    if keep:
        rows = rows.where(keep)
    n = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    none = np.zeros(0)
    if len(n) < 2:
        return Model(b"", b"", float(next(iter(n), 0.5)), none, none, none)
    part = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30))
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, sample_docs / n[1]))).otherwise(F.lit(min(1.0, sample_docs / n[0])))
    sample = rows.where(part < share * (1 << 30)).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    # About 2 x sample_docs short rows, whatever the size of the tables.
    sample = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def cut(batches):
        import xxhash
        for chunk, texts in chunks(batches):
            q = column(chunk, "quality").to_pylist()
            out = [(k, b) for k, t in zip(q, texts.to_pylist()) for b in blocks(t.encode())]
            h = [xxhash.xxh64_intdigest(b) >> 1 for _, b in out]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array(h, pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["quality", "h", "block"])

    cuts = sample.where("half = 0").select("quality", "text").mapInArrow(cut, "quality int, h long, block binary")
    dicts = {}
    for q in (0, 1):
        got = cuts.where(F.col("quality") == q).orderBy("h", "block").limit(SAMPLE_BLOCKS).collect()
        dicts[q] = _dictionary([bytes(r["block"]) for r in got])
    share_good = n[1] / (n[0] + n[1])
    model = Model(dicts[1], dicts[0], share_good, none, none, none)

    def measure(batches):
        for chunk, texts in chunks(batches):
            s = _sizes(texts, model)
            yield pa.RecordBatch.from_arrays([column(chunk, "quality").cast(pa.int32()), *(pa.array(s[:, k]) for k in range(3))], names=["quality", "bad", "good", "n"])

    seen = sample.where("half = 1").select("quality", "text").mapInArrow(measure, "quality int, bad double, good double, n double").toPandas()
    y = seen["quality"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return Model(b"", b"", share_good, none, none, none)
    # The classes are sampled at different rates: weigh them back.
    row_weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    row_weight *= len(y) / row_weight.sum()
    z = model.features(seen[["bad", "good", "n"]].to_numpy())
    model.low, model.high = z.min(0), z.max(0)
    p = _terms(model._unit(z))
    w = np.zeros(p.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(p @ w, -35, 35)))
        h = (p * (row_weight * (mu * (1 - mu) + 1e-9))[:, None]).T @ p + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, p.T @ (row_weight * (y - mu)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, score, bad_size, good_size, n_bytes)``, one row per input row.

    Null text counts as empty; an empty text is compressed like any other, its features held within the range seen in training.
    """
    def run(batches):
        for chunk, texts in chunks(batches):
            s = _sizes(texts, model)
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array(model.score(s)), *(pa.array(s[:, k].astype(np.int64)) for k in range(3))],
                                             names=["doc_id", "score", "bad_size", "good_size", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, bad_size long, good_size long, n_bytes long")
