"""Benchmark decontamination by greedy string tiling.

Benchmark items are cut into word n-grams (seeds). Documents' n-grams meet them by a hash join inside the scan; only
seeds that meet go on. Each (document, item) pair with shared seeds is tiled: of all matches of unmarked words the
longest is marked, again and again, so a passage whose sentences were put in another order is still covered. An item
is reported when the covered share of its words reaches the threshold.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, each sent to the executors as one seed index of
about that size; documents are scanned once per block and never shuffled.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.text import ALNUM, chunks, column, mix, row_filter, whole, word_hashes, words

BLOCK_BYTES = 16 << 20
MIN_MATCH = 5
COVERAGE = 0.5
BASE = np.uint64(0xD6E8FEB86659FD93)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin value of every run of ``k`` words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + h[i:i + n]
    return mix(out)


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in doc, start in item, length)``. ``seeds`` are the places where ``least`` words agree.

    Every match of unmarked words is part of a maximal diagonal run, so runs wait in a queue by length; one that has
    since been marked in part comes back as its unmarked pieces. Ties: the first place in the item, then in the document.
    """
    runs: dict[int, list[list[int]]] = {}
    for i, j in sorted(seeds):
        d = runs.setdefault(i - j, [])
        if d and d[-1][1] >= i:
            d[-1][1] = i + least
        else:
            d.append([i, i + least])
    queue = [(-(e - s), s - diag, s) for diag, parts in runs.items() for s, e in parts]
    heapq.heapify(queue)
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    out = []
    while queue and item_free.any():
        n, j, i = heapq.heappop(queue)
        n = -n
        free = doc_free[i:i + n] & item_free[j:j + n]
        if free.all():
            out.append((i, j, n))
            doc_free[i:i + n] = False
            item_free[j:j + n] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(queue, (-int(e - s), j + int(s), i + int(s)))
    return out


class Index:
    """Seeds of one benchmark block: sorted hashes with item and position, behind a bitmap; one table per seed length.

    An item of fewer than ``least`` words is its own seed, so that short items, and those of scripts without spaces, are found as well.
    """

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.ids = [i for i, _ in items]
        w = words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        self.hash = word_hashes(w.distinct)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
        self.bounds = w.bounds
        size = np.diff(w.bounds)
        self.tables = [_Seeds(self, n, np.flatnonzero(size >= n if n == least else size == n)) for n in range(1, least + 1)]
        self.tables = [t for t in self.tables if len(t.key)]

    def words_of(self, item: int) -> np.ndarray:
        return self.hash[self.bounds[item]:self.bounds[item + 1]]


class _Seeds:
    def __init__(self, index: Index, length: int, items: np.ndarray):
        self.length = length
        key = rolling(index.hash, length)
        at = np.arange(len(key))
        item = np.searchsorted(index.bounds, at, "right") - 1
        ok = np.isin(item, items)
        ok[ok] = at[ok] + length <= index.bounds[item[ok] + 1]
        order = np.argsort(key[ok], kind="stable")
        self.key, self.item, self.pos = key[ok][order], item[ok][order], (at - index.bounds[item])[ok][order]
        bits = min(26, max(16, int(len(self.key)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.key >> self.shift] = True


def _search(texts: pa.Array, index: Index, coverage: float) -> list[tuple]:
    """``(row, item_id, coverage, n_tiles, n_matched, n_item_words)`` of every item found in lower-cased texts."""
    w = words(texts, ALNUM)
    if not len(w.ids) or not index.tables:
        return []
    h = word_hashes(w.distinct)[w.ids]
    return [row for table in index.tables for row in _matches(w, h, index, table, coverage)]


def _matches(w, h: np.ndarray, index: Index, table: _Seeds, coverage: float) -> list[tuple]:
    least = table.length
    if len(h) < least:
        return []
    key = rolling(h, least)
    at = np.flatnonzero(table.seen[key >> table.shift])
    key = key[at]
    lo = np.searchsorted(table.key, key, "left")
    n = np.searchsorted(table.key, key, "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    doc = np.searchsorted(w.bounds, at, "right") - 1
    ok = at + least <= w.bounds[doc + 1]
    at, lo, n, doc = at[ok], lo[ok], n[ok], doc[ok]
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, m, d in zip(at.tolist(), lo.tolist(), n.tolist(), doc.tolist()):
        for k in range(b, b + m):
            pairs.setdefault((d, int(table.item[k])), []).append((a - int(w.bounds[d]), int(table.pos[k])))
    rows = []
    for (d, it), seeds in pairs.items():
        text, item = h[w.bounds[d]:w.bounds[d + 1]], index.words_of(it)
        # Verify the Karp-Rabin hits word by word, then tile.
        seeds = [(i, j) for i, j in seeds if np.array_equal(text[i:i + least], item[j:j + least])]
        found = tiles(text, item, seeds, least)
        matched = sum(x[2] for x in found)
        if matched and matched >= coverage * len(item):
            rows.append((d, index.ids[it], matched / len(item), len(found), matched, len(item)))
    return rows


def _scan(docs: DataFrame, items: list[tuple[int, str]], least: int, coverage: float) -> DataFrame:
    index = Index(items, least)
    names = ["doc_id", "item_id", "coverage", "n_tiles", "n_matched", "n_item_words"]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        for chunk, texts in chunks(batches):
            rows = _search(texts, index, coverage)
            if rows:
                ids = column(chunk, "doc_id").to_pylist()
                rows = [(ids[d], *rest) for d, *rest in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(
        run, "doc_id long, item_id long, coverage double, n_tiles long, n_matched long, n_item_words long")


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Benchmark rows in blocks of bounded size, in item order; one block is on the driver at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("text IS NOT NULL").distinct()
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    if n == 1:
        yield [tuple(r) for r in b.orderBy("item_id", "text").collect()]
        return
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [tuple(r) for r in b.where(part == i).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` against ``benchmark(item_id, text, ...)`` -> one row per contaminated (document row, item):
    ``(doc_id, item_id, coverage, n_tiles, n_matched, n_item_words)``.

    Words are lower-cased runs of letters and digits, so punctuation and spacing do not matter. Null and empty texts match
    nothing; an item with fewer than ``least`` words must occur whole. An item given twice with the same
    text counts once, with two texts as two rows. A document row given twice is reported twice. Without items, or without
    documents, the result is empty.
    """
    out = None
    for items in blocks(benchmark, block_bytes):
        part = _scan(docs, items, least, coverage)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that ``contaminated`` does not report, all columns unchanged, whatever their names; one filter per benchmark block, no shuffle.

    Null texts and null doc_ids stay, repeated rows are judged alike, and without items every row stays.
    """
    for items in blocks(benchmark, block_bytes):
        index = Index(items, least)

        def make(index=index):
            def mask(texts: pa.Array) -> np.ndarray:
                keep = np.ones(len(texts), bool)
                keep[[r[0] for r in _search(whole(texts), index, coverage)]] = False
                return keep
            return mask

        docs = docs.where(row_filter(make)(F.lower("text")))
    return docs
