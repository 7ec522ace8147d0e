"""Repeated passages found by recompression of word sequences.

Words become symbols; a round first replaces every run of equal symbols by one symbol, then every pair whose left member is
of one hash class and whose right member is of the other. A symbol's name is a hash of what it stands for, so all tasks give equal
names without a naming shuffle. Whether a symbol is formed depends only on the words next to it; that stretch is its
reach. Two equal windows of words hold the same symbols wherever the reach lies inside, so a window is represented by the smallest
name of such an interior symbol (named by all words of its reach); a window without one is named by all its words.

Pass 1 finds representatives that several documents share, pass 2 compares the windows they stand for by 96 bits of hash and finds
the smallest document of each. Both passes send one row per batch of documents and hash range, with packed arrays in which each name
occurs once per batch, so a passage shared by a third of all documents adds one entry per batch. The answers return to the
batches, and meet the texts there; all uses of the texts share one shuffle by batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.text import WORD, column, mix, whole, word_hashes, words

BATCH_BYTES = 4 << 20
RANGE_WORDS = 2_000_000
ROUNDS = 2
LAST = (1 << 63) - 1
NAME = np.uint64((1 << 48) - 1)
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def round_of(sym, lo, hi, start, doc, salt: int):
    """One round: runs, then pairs. ``lo:hi`` is each symbol's reach in words, ``start`` its first word, ``doc`` its document.

    A reach that depends on the edge of its document is widened beyond it, so that no window holds it.
    """
    n = len(sym)
    if not n:
        return sym, lo, hi, start, doc
    # Runs of equal symbols.
    head = np.ones(n, bool)
    head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, n))
    last = first + count - 1
    left_lo = np.where((first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first]), lo[np.maximum(first - 1, 0)], lo[first] - 1)
    nxt = np.minimum(last + 1, n - 1)
    right_hi = np.where((last + 1 < n) & (doc[nxt] == doc[last]), hi[nxt], hi[last] + 1)
    sym = np.where(count > 1, mix(sym[first] ^ (count.astype(np.uint64) * _C)), sym[first])
    lo, hi = np.minimum(lo[first], left_lo), np.maximum(hi[last], right_hi)
    start, doc = start[first], doc[first]
    # Pairs of a left-class symbol with a right-class one.
    n = len(sym)
    left = (mix(sym + _A * np.array([salt], np.uint64)) & np.uint64(1)) == 0
    joined = np.zeros(n, bool)
    same = doc[1:] == doc[:-1]
    joined[:-1] = left[:-1] & ~left[1:] & same
    second = np.zeros(n, bool)
    second[1:] = joined[:-1]
    # An unpaired symbol's fate hangs on the neighbour it could have paired with.
    before, after = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    has_before, has_after = np.append(False, same), np.append(same, False)
    new_lo = np.where(left, lo, np.where(has_before, np.minimum(lo, lo[before]), lo - 1))
    new_hi = np.where(left, np.where(has_after, np.maximum(hi, hi[after]), hi + 1), hi)
    pair_hi = np.maximum(hi, hi[after])
    sym = np.where(joined, mix(sym * _A ^ mix(sym[after] + _B)), sym)
    lo = np.where(joined, np.minimum(lo, lo[after]), new_lo)
    hi = np.where(joined, pair_hi, new_hi)
    keep = ~second
    return sym[keep], lo[keep], hi[keep], start[keep], doc[keep]


def _rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = out * base + h[i:i + len(out)]
    return out


def starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of ``width`` words within a document: ``(first word, document)``."""
    n = int(bounds[-1])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(max(n - width + 1, 0))
    at = at[doc[at] == doc[at + width - 1]] if len(at) else at
    return at, doc[at] if len(at) else at


def windows(hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """The representative of every window."""
    n = len(hashes)
    if not len(at):
        return np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sym, lo, hi, start, d = hashes, np.arange(n), np.arange(n) + 1, np.arange(n), doc
    for r in range(rounds):
        sym, lo, hi, start, d = round_of(sym, lo, hi, start, d, r + 1)
    # Interior symbols: named by their own name and all words of their reach.
    b = bounds[d]
    ok = (hi - lo <= width) & (lo >= b) & (hi <= bounds[d + 1])
    sym, lo, hi, start = sym[ok], lo[ok], hi[ok], start[ok]
    whole_window = _rolling(hashes, width, _B)
    name = mix(sym ^ mix(_reach_hash(hashes, lo, hi, width)))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n + width, none)
    for off in range(width):
        # Windows that begin ``off`` words before the reach.
        fits = hi - lo + off <= width
        np.minimum.at(best, lo[fits] - off + width, name[fits])
    rep = best[at + width]
    return np.where(rep == none, mix(whole_window[at]), rep)


def _reach_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(lo), np.uint64)
    for i in range(width):
        live = lo + i < hi
        out[live] = out[live] * _A + h[lo[live] + i]
    return out


def _least_by(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest id and whether another id has the key too."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    end = np.append(head[1:], len(keys)) - 1 if len(head) else head
    return keys[head], ids[head], ids[head] != ids[end]


class Batch:
    """Words and windows of one batch of documents."""

    def __init__(self, table: pa.Table, width: int, represent: bool = True):
        self.ids = np.array([LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.texts = whole(table.column("text"))
        self.words = words(self.texts, WORD)
        d = self.words.distinct
        self.hash = word_hashes(d, 1)[self.words.ids] if len(d) else np.zeros(0, np.uint64)
        self.at, self.doc = starts(self.words.bounds, width)
        self.rep = windows(self.hash, self.words.bounds, self.at, width) if represent else None
        self.width = width

    def full(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the picked windows."""
        h1, h2 = _rolling(self.hash, self.width, _A), _rolling(mix(self.hash), self.width, _C)
        return mix(h1[self.at[pick]]), mix(h2[self.at[pick]]) >> np.uint64(32)


NAME_BYTES = 6   # of a representative: a chance agreement costs one comparison in pass 2, no error
FULL_BYTES, MORE_BYTES = 8, 4   # 96 bits decide whether two windows are equal


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(col, width: int) -> np.ndarray:
    return _wide(np.frombuffer(b"".join(col.to_pylist()), np.uint8), width)


def _wide(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view(np.uint64).ravel()


def _pack_ids(x: np.ndarray) -> bytes:
    """Ids in as few bytes as the largest needs, behind one byte that tells how many."""
    width = 8 if len(x) and x.min() < 0 else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _pack(x, width)


def _unpack_ids(col) -> np.ndarray:
    parts = [_wide(np.frombuffer(x, np.uint8, offset=1), x[0]) for x in col.to_pylist()]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


ANSWER = "batch long, keys binary, extra binary, least binary"
SENT = "range long, batch long, keys binary, extra binary, ids binary, more binary"


def _by_range(batch: int, keys, extra, ids, more, ranges: int, key_bytes: int) -> pa.Table:
    """One row per hash range that the batch has keys in. ``extra`` may be None."""
    part = (keys >> np.uint64(8)).astype(np.int64) % ranges
    order = np.argsort(part, kind="stable")
    part, keys, ids, more = part[order], keys[order], ids[order], more[order]
    extra = None if extra is None else extra[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    s = list(zip(at.tolist(), [*at[1:].tolist(), len(part)]))
    return pa.table({
        "range": pa.array(part[at], pa.int64()), "batch": pa.array(np.full(len(at), batch, np.int64)),
        "keys": pa.array([_pack(keys[a:b], key_bytes) for a, b in s], pa.binary()),
        "extra": pa.array([b"" if extra is None else _pack(extra[a:b], MORE_BYTES) for a, b in s], pa.binary()),
        "ids": pa.array([_pack_ids(ids[a:b]) for a, b in s], pa.binary()), "more": pa.array([np.packbits(more[a:b]).tobytes() for a, b in s], pa.binary())})


def _shared(sent: DataFrame, key_bytes: int, final: bool) -> DataFrame:
    """Per hash range: keys that more than one document has, sent back to the batches that have them. The ``final`` answer
    holds the smallest document, and goes only to batches with another document than that."""
    def answer(key, table):
        lens = np.array([len(x) // key_bytes for x in table.column("keys").to_pylist()], np.int64)
        k = _unpack(table.column("keys"), key_bytes)
        e = _unpack(table.column("extra"), MORE_BYTES) if final else np.zeros(len(k), np.uint64)
        i = _unpack_ids(table.column("ids"))
        m = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("more").to_pylist(), lens.tolist())] or [np.zeros(0, bool)])
        b = np.repeat(table.column("batch").to_numpy(), lens)
        order = np.lexsort((i, e, k))
        k, e, i, m, b = k[order], e[order], i[order], m[order], b[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(k)) - 1 if len(head) else head
        many = (i[head] != i[last]) | (np.add.reduceat(m, head) > 0) if len(head) else np.zeros(0, bool)
        ok = many[group]
        if final:
            ok &= m | (i != i[head][group])
        k, e, b, least = k[ok], e[ok], b[ok], i[head][group[ok]]
        order = np.argsort(b, kind="stable")
        k, e, b, least = k[order], e[order], b[order], least[order]
        at = np.flatnonzero(np.diff(b, prepend=-1))
        s = list(zip(at.tolist(), [*at[1:].tolist(), len(b)]))
        return pa.table({"batch": pa.array(b[at], pa.int64()), "keys": pa.array([_pack(k[x:y], key_bytes) for x, y in s], pa.binary()),
                         "extra": pa.array([_pack(e[x:y], MORE_BYTES) if final else b"" for x, y in s], pa.binary()),
                         "least": pa.array([_pack_ids(least[x:y]) if final else b"" for x, y in s], pa.binary())})

    return sent.groupBy("range").applyInArrow(answer, ANSWER)


def repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, n_removed, kept_sha256, n_kept_chars)``, one row per input row.

    A word is removed if a window of ``width`` words that covers it also starts in a document of a smaller doc_id. Windows are judged on the
    input. Null text has no words; a null doc_id counts as larger than all others; rows that repeat a doc_id count as one document, so they remove
    nothing from each other. Texts shorter than a window lose nothing. An empty table gives an empty result.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BATCH_BYTES))
    ranges = max(16, -(-total // (6 * RANGE_WORDS)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "doc_id", "text"), F.lit(n))).select("batch", "doc_id", "text")
    grouped = source.groupBy("batch")

    def first(key, table):
        b = Batch(table, width)
        keys, ids, more = _least_by(b.rep & NAME, b.ids[b.doc])
        return _by_range(key[0].as_py(), keys, None, ids, more, ranges, NAME_BYTES)

    def second(key, table, back):
        b = Batch(table, width)
        pick = np.flatnonzero(_member(b.rep & NAME, _unpack(back.column("keys"), NAME_BYTES)))
        h1, h2 = b.full(pick)
        ids = b.ids[b.doc[pick]]
        order = np.lexsort((ids, h2, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(h1)) - 1 if len(head) else head
        return _by_range(key[0].as_py() if key[0] is not None else 0, h1[head], h2[head], ids[head], ids[head] != ids[last], ranges, FULL_BYTES)

    def third(key, table, back):
        b = Batch(table, width, represent=False)
        n_words = np.diff(b.words.bounds)
        gone = np.zeros(len(b.words.ids) + 1, np.int64)
        k1, k2, least = _unpack(back.column("keys"), FULL_BYTES), _unpack(back.column("extra"), MORE_BYTES), _unpack_ids(back.column("least"))
        if len(k1) and len(b.at):
            h1, h2 = b.full(np.arange(len(b.at)))
            order = np.lexsort((k2, k1))
            k1, k2, least = k1[order], k2[order], least[order]
            lo, hi = np.searchsorted(k1, h1, "left"), np.searchsorted(k1, h1, "right")
            hit = np.zeros(len(h1), bool)
            for step in range(int((hi - lo).max(initial=0))):
                at = np.minimum(lo + step, len(k1) - 1)
                hit |= (lo + step < hi) & (k2[at] == h2) & (least[at] < b.ids[b.doc])
            np.add.at(gone, b.at[hit], 1)
            np.subtract.at(gone, np.minimum(b.at[hit] + width, len(gone) - 1), 1)
        keep = np.cumsum(gone[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[b.words.bounds]
        pieces = b.words.distinct.to_pylist()
        sha, chars = [], []
        ids, bounds = b.words.ids, b.words.bounds
        for d in range(len(n_words)):
            w = ids[bounds[d]:bounds[d + 1]][keep[bounds[d]:bounds[d + 1]]]
            text = b" ".join([pieces[i] for i in w.tolist()])
            sha.append(hashlib.sha256(text).hexdigest())
            chars.append(len(text.decode()))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array((n_words - np.diff(kept)).astype(np.int64)),
                         "kept_sha256": pa.array(sha, pa.string()), "n_kept_chars": pa.array(chars, pa.int64())})

    shared = _shared(grouped.applyInArrow(first, SENT), NAME_BYTES, False)
    exact = _shared(grouped.cogroup(shared.groupBy("batch")).applyInArrow(second, SENT), FULL_BYTES, True)
    return grouped.cogroup(exact.groupBy("batch")).applyInArrow(third, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_kept_chars long")


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(x):
        return np.zeros(len(x), bool)
    among = np.unique(among)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x
