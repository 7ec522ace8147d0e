"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

Fingerprints are made in Arrow batches, one row per distinct fingerprint goes on. The trie's upper levels are
walked by replication: a fingerprint visits every pair of ``p``-bit nodes whose prefixes differ within the error
budget, and each node pair is one group. Inside the group both subtrees are walked together, bit by bit over
sorted arrays; the differing bits add up and a pair is dropped as soon as they exceed the budget.

``p`` follows the fullest 16-bit prefix, so a group holds about 2 x 32,768 fingerprints at any size of input
(16 bits at most; larger groups are walked in blocks of node pairs, depth first).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.graph import components
from clampspark.llm.text import chunks, column
from clampspark.session import materialise

NODE_ROWS = 1 << 15
BLOCK_PAIRS = 1 << 19
LEAF = 16


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    import xxhash
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    f = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.array([f(joined[a:b], seed) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``; null and blank texts have fingerprint 0. One row per input row."""
    def run(batches):
        for rows, texts in chunks(batches):
            fp = [_fingerprint(t.encode(), shingle, seed) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _steps(x: np.ndarray, bit: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum((x >> np.uint64(bit)) & np.uint64(1), out=out[1:], dtype=np.int64)
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def walk(a: np.ndarray, b: np.ndarray, depth: int, spent: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted arrays with at most ``budget`` differing bits. Members of ``a`` share their first ``depth``
    bits, as do those of ``b``; ``spent`` of these differ. ``same``: both are one array, each pair comes once."""
    found_a, found_b = [], []
    ones_a: dict[int, np.ndarray] = {}
    ones_b = ones_a if same else {}
    stack = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), spent)))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > BLOCK_PAIRS:
            half = len(al) // 2
            stack += [(depth, *(x[:half] for x in (al, ah, bl, bh, err))), (depth, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        small = (ah - al) * (bh - bl) <= LEAF
        if depth == 64:
            small[:] = True
        if small.any():
            l1, l2 = al[small], bl[small]
            n1, n2 = ah[small] - l1, bh[small] - l2
            n = n1 * n2
            k = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            i, j = l1[k] + at // n2[k], l2[k] + at % n2[k]
            ok = _popcount(a[i] ^ b[j]) <= budget
            if same:
                ok &= i < j
            found_a.append(i[ok])
            found_b.append(j[ok])
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        bit = 63 - depth
        if bit not in ones_a:
            ones_a[bit] = _steps(a, bit)
        if bit not in ones_b:
            ones_b[bit] = _steps(b, bit)
        am = ah - (ones_a[bit][ah] - ones_a[bit][al])
        bm = bh - (ones_b[bit][bh] - ones_b[bit][bl])
        kids = []
        for x1, x2, y1, y2, cost in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)):
            ok = (x1 < x2) & (y1 < y2) & (err + cost <= budget)
            if same and x1 is am and y1 is bl:
                ok &= al != bl  # mirror image of the pair before
            kids.append([x[ok] for x in (x1, x2, y1, y2, err + cost)])
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*kids))))
    if not found_a:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(found_a), np.concatenate(found_b)


def prefix_bits(nodes: DataFrame, least: int = 6, most: int = 16) -> int:
    """Fewest prefix bits with which no trie node holds more than ``NODE_ROWS`` fingerprints; at most 65,536 counts are read."""
    counts = np.zeros(1 << most, np.int64)
    for r in nodes.groupBy(F.shiftrightunsigned("fp", 64 - most).alias("k")).count().collect():
        counts[r["k"]] = r["count"]
    for p in range(least, most):
        if counts.reshape(1 << p, -1).sum(1).max(initial=0) <= NODE_ROWS:
            return p
    return most


def links(nodes: DataFrame, budget: int = 2) -> DataFrame:
    """``nodes(fp)``, distinct -> ``(u, v)``: every pair of fingerprints within ``budget`` differing bits, once."""
    p = prefix_bits(nodes)
    masks = [sum(1 << i for i in c) for r in range(budget + 1) for c in combinations(range(p), r)]
    own = F.shiftrightunsigned("fp", 64 - p)
    visits = nodes.select("fp", own.alias("own"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    visits = visits.select("fp", F.least("own", other).alias("lo"), F.greatest("own", other).alias("hi"))

    def join(key, group):
        lo, hi = key[0].as_py(), key[1].as_py()
        fp = np.sort(group.column("fp").to_numpy().view(np.uint64))
        side = fp >> np.uint64(64 - p)
        a, b = fp[side == lo], fp[side == hi]
        i, j = walk(a, b, p, bin(lo ^ hi).count("1"), budget, lo == hi)
        return pa.table({"u": a[i].view(np.int64), "v": b[j].view(np.int64)})

    return visits.groupBy("lo", "hi").applyInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp, component_id, n_links)``, one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``budget`` differing bits, ``n_links`` the
    number of other fingerprints within the budget. Null or blank text: fingerprint 0, linked like any other. A null
    doc_id stays in its component but never names one (null if nothing else is there). Repeated rows share their
    component. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    fps = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    edges = materialise(links(nodes.select("fp"), budget), "links")
    roots = components(edges)
    degree = edges.select(F.col("u").alias("fp")).union(edges.select(F.col("v").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
             .select("fp", "first_doc", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    named = nodes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    nodes = nodes.join(named, "root").select("fp", "component_id", "n_links")
    return fps.join(nodes, "fp").select("doc_id", "fp", "component_id", "n_links")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
