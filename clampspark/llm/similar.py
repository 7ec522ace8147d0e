"""Documents of a given Jaccard similarity: SimHash tries find most pairs, a prefix filter the rest, and a count of the common shingles decides.

Each document has ``TRIES`` independent 32-bit SimHash values of its distinct word shingles. The leading bits of each go through the trie
self-join of ``simhash`` with a budget of ``BUDGET`` bits; documents that agree in a key are linked through the smallest of them. A pair that
meets in any trie is compared by its whole sets. Tries miss some pairs, more of them the larger the input, so an exact way follows.

Put the distinct shingles of all documents in one order. Two sets of similarity t or more then share a shingle among the
first ``n - ceil(t n) + 1`` of each, and at the first one they share, enough must be left on either side. Every pair that passes
is compared by its whole sets, so no pair of the wanted similarity is missed and none below it is linked, at any size of input.
Any order gives the same links; rare shingles first (by counts in hashed slots) keeps the pairs to compare few.

Equal sets are one node. A family of near copies does not form all pairs: first the tries, and each shingle links its documents with the smallest
of them; after that only pairs that are not yet connected are compared, with every other document of the shingle.

Most pairs to compare are far below the wanted similarity. Each set has a parity bitmap: two sets differ in no fewer shingles than their
bitmaps in bits, so most are told apart by 64 bytes, none wrongly, and only the whole sets of the others travel.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.decontaminate import rolling
from clampspark.llm.graph import components
from clampspark.llm.simhash import walk
from clampspark.llm.text import WORD, chunks, column, give_back, mix, word_hashes, words
from clampspark.session import materialise

SLOT_BITS = 20
BLOCK_BITS = 14
BUCKET_ROWS = 1 << 19
PAIRS = 1 << 21     # pairs of places looked at together
SALTS = 64
LEVELS = 8          # steps per doubling of a slot's count
TRIES = 8
BUDGET = 2          # differing bits of two trie keys that meet
NODE_ROWS = 1 << 17
PARITY_WORDS = 8
IDS_SENT = 1 << 21  # ids, about 50 MB of them, that travel to the documents
SKETCH = [f"s{j}" for j in range(TRIES // 2)]
PARITY = [f"p{j}" for j in range(PARITY_WORDS)]


def _sets(batches, shingle: int):
    """Per chunk: its rows, the sorted distinct shingle hashes of each. Fewer words than a shingle make one; none make an empty set."""
    give_back()
    for chunk, texts in chunks(batches):
        w = words(texts, WORD)
        h = word_hashes(w.distinct)[w.ids] if len(w.ids) else np.zeros(0, np.uint64)
        key = rolling(h, shingle)
        yield chunk, [np.unique(key[a:b - shingle + 1] if b - a >= shingle else rolling(h[a:b], b - a) if b > a else h[:0])
                      for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
    give_back()


def _sent(ids: DataFrame) -> DataFrame:
    """Landed ``ids`` to join documents with: they travel to the documents, so that no text is shuffled, unless they are very many."""
    return F.broadcast(ids) if ids.count() <= IDS_SENT else ids


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


# A byte's bits as eight byte-wide counters; 255 of them add up without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
_SEEDS = np.array([0x9E3779B97F4A7C15 * (j + 1) % (1 << 64) for j in range(TRIES // 2)], np.uint64)[:, None]


def _sketch(s: np.ndarray) -> np.ndarray:
    """Sign bits of ``TRIES`` x 32 sums over the shingles, as 64-bit words."""
    ones = np.zeros((TRIES // 2, 64), np.int64)
    for at in range(0, len(s), 255):
        lanes = _LANES[mix(s[at:at + 255] ^ _SEEDS).view(np.uint8).reshape(TRIES // 2, -1, 8)]
        ones += lanes.sum(1, dtype=np.uint64).view(np.uint8)
    return np.packbits((2 * ones > len(s)).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0]


def _parity(s: np.ndarray) -> np.ndarray:
    """Bit b is set when an odd number of shingles fall on it: the bitmaps of two sets differ in at most as many bits as the sets in shingles."""
    at = (mix(s ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(64 * PARITY_WORDS)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _digests(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document with the digest, size, sketch and parity bitmap of its set; and, with a block, how many sets have a shingle in each slot."""
    words = [*SKETCH, *PARITY]
    names = ["doc_id", "d0", "d1", "n", *words, "block", "slots", "counts"]
    types = [pa.int64()] * (4 + len(words)) + [pa.int32(), pa.binary(), pa.binary()]
    schema = f"doc_id long, d0 long, d1 long, n long, {', '.join(f'{w} long' for w in words)}, block int, slots binary, counts binary"

    def run(batches):
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        for chunk, sets in _sets(batches, shingle):
            for s in sets:
                np.add.at(total, _slot(s), 1)
            d = [_digest(s) for s in sets]
            n = chunk.num_rows
            w = np.array([np.concatenate([_sketch(s), _parity(s)]) for s in sets], np.int64).reshape(n, len(words))
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(w[:, j])) for j in range(len(words))),
                                              *(pa.nulls(n, t) for t in types[-3:])], names=names)
        rows = []
        for block, part in enumerate(total.reshape(-1, 1 << BLOCK_BITS)):
            at = np.flatnonzero(part)
            if len(at):
                rows.append((block, at.astype("<u2").tobytes(), part[at].tobytes()))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in types[:-3]), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types[-3:]))], names=names)

    return _lowered(docs).mapInArrow(run, schema)


def _levels(rows: DataFrame) -> np.ndarray:
    """How common the shingles of each slot are, as the logarithm of their count."""
    size = 1 << BLOCK_BITS

    def add(key, group):
        total = np.zeros(size, np.int64)
        for s, c in zip(group.column("slots").to_pylist(), group.column("counts").to_pylist()):
            total[np.frombuffer(s, "<u2")] += np.frombuffer(c, np.uint32)
        level = np.minimum(255, LEVELS * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()])})

    out = np.zeros((1 << SLOT_BITS >> BLOCK_BITS, size), np.uint8)
    for r in rows.where("block IS NOT NULL").select("block", "slots", "counts").groupBy("block").applyInArrow(add, "block int, levels binary").collect():
        out[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, shingle: int, t: Fraction, levels: np.ndarray) -> DataFrame:
    """``(doc_id, d0, n, tokens)``: the first ``n - ceil(t n) + 1`` shingles of each set, rare ones first."""
    def run(batches):
        for chunk, sets in _sets(batches, shingle):
            out = []
            for s in sets:
                n = len(s)
                first = n - -(-t.numerator * n // t.denominator) + 1 if n else 0
                out.append(s[np.lexsort((s, levels[_slot(s)]))[:first]].tobytes())
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(out, pa.binary())],
                                             names=["doc_id", "d0", "n", "tokens"])

    return _lowered(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, d0 long, n long, tokens binary").where("n > 0")


def _meet(nodes: DataFrame, bits: int, p: int) -> DataFrame:
    """``nodes(trie, key)``, keys of ``bits`` bits -> ``(trie, a, b)``: keys within the budget. Visits travel packed, one row per batch and node pair."""
    masks = [sum(1 << i for i in c) for r in range(BUDGET + 1) for c in combinations(range(p), r)]

    def send(batches):
        for batch in batches:
            trie, key = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("trie", "key"))
            own = key >> (bits - p)
            other = own[:, None] ^ np.array(masks, np.int64)
            pair = (trie[:, None] << 40 | np.minimum(own[:, None], other) << 20 | np.maximum(own[:, None], other)).ravel()
            keys = np.repeat(key, len(masks)).astype(np.uint32)
            order = np.argsort(pair, kind="stable")
            pair, keys = pair[order], keys[order]
            at = np.flatnonzero(np.diff(pair, prepend=-1))
            end = np.append(at[1:], len(pair)) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(pair[at]), pa.array([keys[a:b].tobytes() for a, b in zip(at.tolist(), end.tolist())], pa.binary())], names=["pair", "keys"])

    def join(key, group):
        pair = key[0].as_py()
        trie, lo, hi = pair >> 40, pair >> 20 & 0xFFFFF, pair & 0xFFFFF
        k = np.unique(np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32)).astype(np.uint64)
        side = k >> np.uint64(bits - p)
        back = np.uint64(64 - bits)
        k = k << back
        a, b = k[side == lo], k[side == hi]
        i, j = walk(a, b, p, bin(lo ^ hi).count("1"), BUDGET, lo == hi)
        return pa.table({"trie": pa.array(np.full(len(i), trie, np.int64)), "a": (a[i] >> back).astype(np.int64), "b": (b[j] >> back).astype(np.int64)})

    return nodes.mapInArrow(send, "pair long, keys binary").groupBy("pair").applyInArrow(join, "trie long, a long, b long")


def _trie_pairs(sketches: DataFrame) -> DataFrame:
    """``sketches(doc_id, s0, ...)``, one row per set -> ``(u, v)``: documents whose keys meet in a trie, each key by its smallest document.

    The key length follows the logarithm of the number of documents, which keeps chance meetings per document constant.
    """
    n = sketches.count()
    bits = min(32, max(20, max(1, n).bit_length() + 9))
    p = min(16, max(2, (n // NODE_ROWS).bit_length()))
    keys = F.array(*[F.struct(F.lit(j).cast("long").alias("trie"), F.shiftrightunsigned(F.col(SKETCH[j // 2]), 32 * (j % 2)).bitwiseAND(F.lit((1 << bits) - 1)).alias("key"))
                     for j in range(TRIES)])
    placed = sketches.select("doc_id", F.explode(keys).alias("k")).select("k.trie", "k.key", "doc_id")
    nodes = materialise(placed.groupBy("trie", "key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")), "trie-nodes")
    met = materialise(_meet(nodes.select("trie", "key"), bits, p).where("a <> b"), "trie-links")
    met = met.join(nodes.select("trie", F.col("key").alias("a"), F.col("rep").alias("u")), ["trie", "a"]).join(
        nodes.select("trie", F.col("key").alias("b"), F.col("rep").alias("v")), ["trie", "b"]).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    same = placed.join(nodes.where("k > 1").drop("k"), ["trie", "key"]).where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    return met.where("u <> v").union(same).distinct()


PLACE = np.dtype([("token", "<u8"), ("doc", "<i8"), ("root", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def _fits(x: np.ndarray, y: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of which these are the first common places can have similarity ``t``."""
    most = np.minimum(x["n"] - x["pos"], y["n"] - y["pos"]).astype(np.int64)
    return most * (t.numerator + t.denominator) >= t.numerator * (x["n"].astype(np.int64) + y["n"])


def _pairs_of(p: np.ndarray, t: Fraction, stars: bool) -> np.ndarray:
    """Distinct pairs ``(u, v)``, u < v, of places of one token that may be similar: with the smallest document of the token, or all
    whose roots differ."""
    p = p[np.argsort(p, order=("token", "doc"))]
    new = np.append(True, p["token"][1:] != p["token"][:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    end = np.append(np.flatnonzero(new)[1:], len(p))[np.cumsum(new) - 1]
    found = []

    def keep(i, j):
        ok = (p["doc"][i] != p["doc"][j]) & (p["root"][i] != p["root"][j])
        i, j = i[ok], j[ok]
        ok = _fits(p[i], p[j], t)
        found.append(np.unique(np.stack([p["doc"][i[ok]], p["doc"][j[ok]]], 1), axis=0))

    if stars:
        keep(start, np.arange(len(p)))
    else:
        # Tokens whose documents are all connected have nothing left.
        mixed = np.logical_or.reduceat(p["root"] != p["root"][start], np.flatnonzero(new))[np.cumsum(new) - 1]
        at = np.flatnonzero(mixed)
        left = end[at] - at - 1
        cut = np.concatenate([[0], np.cumsum(left)])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + PAIRS, "right")) - 1)
            n = left[a:b]
            i = np.repeat(at[a:b], n)
            keep(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
            a = b
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _candidates(prefixes: DataFrame, buckets: int, t: Fraction, stars: bool) -> DataFrame:
    """``prefixes(doc_id, n, tokens, root)`` -> distinct ``(u, v)``. Places travel packed, one row per batch and bucket of tokens."""
    def send(batches):
        for batch in batches:
            tokens = column(batch, "tokens").to_pylist()
            lens = np.array([len(x) // 8 for x in tokens], np.int64)
            p = np.zeros(int(lens.sum()), PLACE)
            p["token"] = np.frombuffer(b"".join(tokens), "<u8")
            for name, c in (("doc", "doc_id"), ("root", "root"), ("n", "n")):
                p[name] = np.repeat(column(batch, c).to_numpy(zero_copy_only=False), lens)
            p["pos"] = np.arange(len(p)) - np.repeat(np.cumsum(lens) - lens, lens)
            b = (p["token"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            at = np.flatnonzero(np.diff(b, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array([p[x:y].tobytes() for x, y in zip(at.tolist(), [*at[1:].tolist(), len(p)])], pa.binary())], names=["bucket", "places"])

    def join(key, group):
        p = np.frombuffer(b"".join(group.column("places").to_pylist()), PLACE)
        pairs = _pairs_of(p, t, stars)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return prefixes.mapInArrow(send, "bucket long, places binary").groupBy("bucket").applyInArrow(join, "u long, v long").distinct()


def _alike(pairs: DataFrame, marks: DataFrame, t: Fraction) -> DataFrame:
    """``pairs(u, v)`` without those whose sizes or parity bitmaps rule out similarity ``t``: ``marks(doc_id, n, p0, ...)``, one row per set.

    Similarity t means that at most (1 - t) / (1 + t) of both sizes together differ.
    """
    x, y = (marks.select(F.col("doc_id").alias(end), F.struct("n", *PARITY).alias(name)) for end, name in (("u", "x"), ("v", "y")))
    differ = sum((F.bit_count(F.col("x")[p].bitwiseXOR(F.col("y")[p])) for p in PARITY), F.lit(0)).cast("long")
    differ = F.greatest(differ, F.abs(F.col("x.n") - F.col("y.n")))
    near = differ * (t.denominator + t.numerator) <= (F.col("x.n") + F.col("y.n")) * (t.denominator - t.numerator)
    return pairs.join(x, "u").join(y, "v").where(near).select("u", "v")


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """Those of ``pairs(u, v)`` whose whole sets have similarity ``t`` or more. Each document's set goes to blocks of its pairs."""
    def run(batches):
        for chunk, sets in _sets(batches, shingle):
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array([_digest(s)[0] for s in sets], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "d0", "s"])

    ids = materialise(pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct(), "pair-ids")
    sets = materialise(_lowered(docs).join(_sent(ids), "doc_id", "leftsemi").mapInArrow(run, "doc_id long, d0 long, s array<long>").dropDuplicates(["doc_id", "d0"]), "sets")
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("su"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).alias("sv"))

    def side(name, salt, out):
        return salted.select(name, salt).distinct().join(sets.select(F.col("doc_id").alias(name), F.col("s").alias(out)), name)

    both = salted.join(side("u", "su", "x"), ["u", "su"]).join(side("v", "sv", "y"), ["v", "sv"])
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(common * (t.numerator + t.denominator) >= (F.size("x") + F.size("y")).cast("long") * t.numerator).select("u", "v").distinct()


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, component_id)``, one row per input row: the smallest doc_id reachable over links.

    A link joins two documents whose sets of distinct shingles (words lower-cased) have Jaccard similarity ``similarity`` or more. Blank and null texts have the
    empty set and form one component. A null doc_id is a document of its own.
    """
    t = Fraction(str(similarity))
    rows = materialise(_digests(docs, shingle), "digests")
    levels = _levels(rows)
    rows = rows.where("block IS NULL")
    known = rows.where("doc_id IS NOT NULL")
    many = known.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    copies = materialise(known.select("doc_id", "d0", "d1").join(many, ["d0", "d1"]).where("doc_id <> rep").select("doc_id", "d0", "rep").distinct(), "copies")
    marks = known.where("n > 0").join(copies, ["doc_id", "d0"], "leftanti").dropDuplicates(["doc_id", "d0"])
    marks = materialise(marks.select("doc_id", "n", *SKETCH, *PARITY), "marks")
    tries = materialise(_alike(_trie_pairs(marks.select("doc_id", *SKETCH)), marks, t), "trie-pairs")
    prefixes = materialise(_prefixes(docs, shingle, t, levels).join(copies, ["doc_id", "d0"], "leftanti").dropDuplicates(["doc_id", "d0"]), "prefixes")
    places = prefixes.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(256, places // 8 // BUCKET_ROWS)

    stars = _alike(_candidates(prefixes.withColumn("root", F.col("doc_id")), buckets, t, True), marks, t)
    first = materialise(tries.union(stars).distinct(), "stars")
    links = materialise(_similar(first, docs, shingle, t), "star-links")
    roots = components(links)
    rooted = prefixes.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "tokens", F.coalesce("root", "doc_id").alias("root"))
    rest = materialise(_alike(_candidates(rooted, buckets, t, False), marks, t).join(first, ["u", "v"], "leftanti"), "candidates")
    links = links.union(_similar(rest, docs, shingle, t)).union(copies.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    roots = components(links)
    return rows.select("doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as one column ``whole``, with ``node``: the doc_id, or for a doc_id that names several texts a number of (doc_id, text).

    And the doc_ids, null too, that stand in more than one row: ``(doc_id, again)``, landed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(c) for c in docs.columns]).alias("whole"))
    h = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), (F.min(h) != F.max(h)).alias("several")).where("rows > 1")
    again = materialise(again.select("doc_id", F.lit(True).alias("again"), "several"), "repeated-ids")
    twice = again.where("doc_id IS NOT NULL AND several").select("doc_id", "several")
    again = again.select("doc_id", "again")
    if twice.isEmpty():
        return rows.withColumn("node", F.col("doc_id")), again
    own = F.xxhash64(F.lit("node"), "doc_id", h)
    return rows.join(_sent(twice), "doc_id", "left").select("doc_id", "text", "whole", F.when(F.col("several"), own).otherwise(F.col("doc_id")).alias("node")), again


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whatever their names: of each group the document with the smallest doc_id, once.

    Rows that agree in doc_id and text are one document; a doc_id with several texts is several documents, and of those that are alike the
    one with the smallest hash stays. Documents without a doc_id stay, rows that agree in a null doc_id and text once. Blank and null texts form one group.
    """
    rows, again = _nodes(docs)
    found = groups(rows.select(F.col("node").alias("doc_id"), "text"), shingle, similarity).where("doc_id IS NOT NULL").distinct()
    named = found.join(rows.where("doc_id IS NOT NULL AND node <> doc_id").select("node", F.col("doc_id").alias("own")).distinct(), F.col("doc_id") == F.col("node"), "left")
    named = named.select(F.col("doc_id").alias("node"), "component_id", F.struct(F.coalesce("own", "doc_id").alias("id"), F.col("doc_id").alias("node")).alias("place"))
    first = named.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = materialise(named.join(first, "component_id").where("place <> first").select(F.col("node").alias("gone")).distinct(), "gone")
    kept = rows.join(_sent(gone), F.col("node") == F.col("gone"), "leftanti").select("doc_id", "text", "whole")
    if again.isEmpty():
        return kept.select("whole.*")
    # Only rows that share their doc_id can be the same document; the others are not shuffled.
    kept = kept.alias("l").join(_sent(again).alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left").select("l.*", "again")
    once, more = kept.where("again IS NULL"), kept.where("again")
    return once.select("whole").union(more.dropDuplicates(["doc_id", "text"]).select("whole")).select("whole.*")
