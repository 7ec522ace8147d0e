"""Token ids compressed by Re-Pair per shard, with random access to single documents.

Documents are put in doc_id order by a range partitioning, encoded, and cut into shards of a bounded number of ids.
In each shard the frequent id pairs are replaced by nonterminals, round after round; pairs never span a document.
A shard row holds the rules, the length of each rule's expansion, the symbols left, and where each document
starts in them, so one document is decoded without its neighbours. Shards are written by Spark's Parquet writer, so a
lost executor's part is written anew and any file system will do.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clampspark.llm.text import byte_strings, chunks, column, give_back, load_tokenizer, mix, raw

END = 2
SHARD_IDS = 3 << 18
STEP = 8
SLOT_BITS = 18
LEAST = 16         # a pair must occur this often in a shard to become a rule
PART_BYTES = 48 << 20
CHUNK_BYTES = 4 << 20
ENCODE_BYTES = 1 << 20  # text cut into pieces at a time, which takes many times its size
KNOWN_PIECES = 400_000  # pieces whose ids a task remembers; beyond that it forgets those seen in one chunk alone
SHARD_SCHEMA = ("part int, shard int, first_doc long, n_docs long, n_ids long, base int, doc_ids binary, doc_symbols binary, doc_starts binary, "
                "rules binary, expansion binary, symbols binary, width int")

# A blank followed by a visible character always starts a new pre-token, whatever stands before it. Lead bytes C2 and
# E1 to E3 are left out: they may begin a Unicode space.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xE0] = True
_AFTER[0xE4:0xF5] = True
# Kinds of bytes: blank, letter (ASCII, or two bytes of U+00C0 to U+027F), digit, other visible ASCII, anything else.
_KIND = np.full(256, 4, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x21:0x7F] = 3
_KIND[0x27] = 4
for _b in range(0x21, 0x7F):
    if chr(_b).isalnum():
        _KIND[_b] = 2 if chr(_b).isdigit() else 1
_KIND[0xC3:0xCA] = 1


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut texts so that every piece is encoded alike on its own, and which pieces are one pre-token: a run with at most a blank before it.

    Cuts lie at a blank before a visible character, where a visible run ends, around a line feed or tab before a visible character, and between
    letters, digits and other marks; not beside an apostrophe or what is neither ASCII nor a Latin letter, nor within a word
    that holds the beginning of a control string.
    """
    n = len(buf)
    kind = _KIND[buf]
    # The second byte of a Latin letter goes with its first; those of other characters stay apart.
    kind[1:][(buf[:-1] >= 0xC3) & (buf[:-1] < 0xCA)] = 1
    for second in (0x97, 0xB7):  # the multiplication and division signs are no letters
        sign = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] == second))
        kind[sign] = kind[sign + 1] = 4
    seen = (kind > 0) & (kind < 4)
    inside = np.ones(n, bool)  # not a text's last byte: what follows it is another text
    inside[off[1:][off[1:] > 0] - 1] = False
    cut = np.zeros(n + 1, bool)
    cut[:-2] = (buf[:-1] == 0x20) & _AFTER[buf[1:]] & inside[:-1]
    cut[1:-1] |= seen[:-1] & (kind[1:] == 0)
    # The last of several white space characters before a visible one is a token of its own.
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    known = first.copy()
    known[1:] |= kind[:-1] != 4
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == 0) & (buf[:-1] != 0x20) & seen[1:]
    last &= known & inside
    cut[1:] |= last
    cut[:-1] |= last
    inner = seen[:-1] & seen[1:] & (kind[1:] != kind[:-1])
    control = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
    if len(control):
        word = np.cumsum((kind == 0) | first)
        inner &= ~np.isin(word[1:], word[control])
        # White space before a control string stays together, as at a text's end.
        before = control[(control > 0)] - 1
        cut[before[(kind[before] == 0) & (before > 0) & (kind[before - 1] == 0)]] = False
        cut[control[kind[np.maximum(control - 1, 0)] == 0]] = False
    cut[1:-1] |= inner
    cut[off] = True
    at = np.flatnonzero(cut)
    bad = np.concatenate([[0], np.cumsum(kind == 4)])
    bad = np.diff(bad[at]) > 0
    bad |= (kind[at[:-1]] == 0) & ~((buf[at[:-1]] == 0x20) & (at[1:] - at[:-1] > 1) & seen[np.minimum(at[:-1] + 1, n - 1)])
    if len(control):
        bad[np.searchsorted(at, control, "right") - 1] = True
    return at, ~bad


class Known:
    """Numbers of the pieces that a task has encoded, looked up for many pieces at once.

    A piece of up to 16 bytes is told exactly by its first and last 8 bytes and its length; a hash of these finds the
    candidate. Longer pieces are in a dict.
    """

    def __init__(self):
        self.told = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        self.hashes, self.numbers, self.long = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}

    def __len__(self) -> int:
        return len(self.told[2])

    @staticmethod
    def tell(values: pa.LargeBinaryArray) -> tuple[list[np.ndarray], np.ndarray]:
        data, off = raw(values)
        m = np.diff(off)
        at_byte = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        first, last = at_byte[off[:-1]], at_byte[np.maximum(off[1:] - 8, off[:-1])]
        inside = np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(m, 8))).astype(np.uint64)
        first, last = first & inside, last & inside
        return [first, last, m], mix(mix(first) ^ (last + m.astype(np.uint64)))

    def find(self, values: pa.LargeBinaryArray) -> np.ndarray:
        """Number of each non-empty piece, -1 where it is not known."""
        told, h = self.tell(values)
        which = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            order = np.argsort(h)
            place = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
            number = np.empty(len(h), np.int64)
            number[order] = self.numbers[place]
            same = told[2] <= 16
            for mine, theirs in zip(self.told, told):
                same &= mine[number] == theirs
            which[same] = number[same]
        long = np.flatnonzero(told[2] > 16)
        if len(long):
            which[long] = [self.long.get(x, -1) for x in byte_strings(values.take(pa.array(long)))]
        return which

    def add(self, values: pa.LargeBinaryArray) -> None:
        """New pieces get the next numbers, in their order."""
        told, h = self.tell(values)
        number = np.arange(len(self), len(self) + len(h))
        self.told = [np.concatenate(x) for x in zip(self.told, told)]
        order = np.flatnonzero(told[2] <= 16)
        order = order[np.argsort(h[order])]
        place = np.searchsorted(self.hashes, h[order])
        self.hashes, self.numbers = np.insert(self.hashes, place, h[order]), np.insert(self.numbers, place, number[order])
        long = np.flatnonzero(told[2] > 16)
        if len(long):
            self.long.update(zip(byte_strings(values.take(pa.array(long))), number[long].tolist()))

    def keep(self, stay: np.ndarray) -> None:
        """Forget all pieces but those of a mask, which are numbered anew in their order."""
        anew = np.where(stay, np.cumsum(stay) - 1, -1)
        self.told = [x[stay] for x in self.told]
        left = stay[self.numbers]
        self.hashes, self.numbers = self.hashes[left], anew[self.numbers[left]]
        self.long = {x: int(anew[n]) for x, n in self.long.items() if stay[n]}


def encoder(path: str):
    """Function from an Arrow text array to (ids, lengths), equal to encoding each text on its own; distinct pieces are encoded once."""
    tok = load_tokenizer(path)
    model, known = tok.model, Known()
    as_text = np.array([ord(c) for _, c in sorted(byte_characters().items())], "<u2")
    flat, begin, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = np.zeros(0, bool)  # pieces that were asked for once more since they were learned or last kept

    def ids_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces in a row, and where each piece's begin."""
        m = size[which]
        total = np.concatenate([[0], np.cumsum(m)])
        return flat[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], m)], total

    def forget(room: int) -> None:
        """Keep the pieces that came again, if they leave half of the room; else begin anew."""
        nonlocal flat, begin, size, again
        stay = again if 2 * (np.count_nonzero(again) + room) <= KNOWN_PIECES else np.zeros(len(again), bool)
        known.keep(stay)
        flat, total = ids_of(np.flatnonzero(stay))
        begin, size = total[:-1], np.diff(total)
        again = np.zeros(len(size), bool)

    def learn(plain: pa.LargeBinaryArray, alone: pa.LargeBinaryArray) -> None:
        """A plain piece is one pre-token, which the model takes as it is; the others pass the whole tokenizer."""
        nonlocal flat, begin, size, again
        data, off = raw(plain)
        shown, off = as_text[data].tobytes().decode("utf-16-le"), off.tolist()
        found = [[t.id for t in model.tokenize(shown[a:b])] for a, b in zip(off, off[1:])]
        texts = [x.decode() for x in byte_strings(alone)]
        for at in range(0, len(texts), 200):
            found += [e.ids for e in tok.encode_batch_fast(texts[at:at + 200], add_special_tokens=False)]
        known.add(pa.concat_arrays([plain, alone]))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32)])
        size = np.concatenate([size, np.fromiter(map(len, found), np.int64, len(found))])
        begin = np.cumsum(size) - size
        again = np.concatenate([again, np.zeros(len(found), bool)])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = raw(texts)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at, plain = pieces(buf, off)
        enc = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf)]).dictionary_encode()
        index, distinct = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
        safe = np.zeros(len(distinct), bool)
        safe[index] = plain
        if len(known) + len(distinct) > KNOWN_PIECES:
            forget(len(distinct))
        which = known.find(distinct)
        fresh = which < 0
        again[which[~fresh]] = True
        if fresh.any():
            one, alone = np.flatnonzero(fresh & safe), np.flatnonzero(fresh & ~safe)
            which[np.concatenate([one, alone])] = len(known) + np.arange(len(one) + len(alone))
            learn(distinct.take(pa.array(one)), distinct.take(pa.array(alone)))
        ids, total = ids_of(which[index])
        return ids, np.diff(total[np.searchsorted(at, off)])

    return encode


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash slot of each id pair."""
    return ((a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)


def compress(ids: np.ndarray, lens: np.ndarray, base: int, least: int = LEAST):
    """Re-Pair of the documents of one shard: ``(symbols, symbols per document, rules, expansion lengths)``.

    ``base`` is the first nonterminal. Each round counts the adjacent pairs within documents and replaces all whose
    count reaches the round's threshold, which falls ``STEP``-fold per round from the count of the commonest pair. Where chosen
    pairs overlap, they are replaced left to right; of two that share a hash slot the commoner one is replaced, the other
    in a later round. Rounds end when no pair occurs ``least`` times.
    """
    sym = ids.astype(np.int32)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(lens) - 1] = True
    rules, limit = np.zeros((0, 2), np.int64), None
    while len(sym) > 1:
        slot = _slots(sym[:-1], sym[1:])
        filled = np.bincount(slot, minlength=1 << SLOT_BITS)
        # A slot's count bounds that of its pairs, so only slots that reach the threshold are looked at pair by pair.
        top = int(filled.max())
        if top < least:
            break
        limit = max(least, (top if limit is None else min(top, limit)) // STEP)
        at = np.flatnonzero((filled >= limit)[slot] & ~last[:-1])
        key = (sym[at].astype(np.int64) << 32) | sym[at + 1]
        ordered = np.sort(key)
        head = np.flatnonzero(np.diff(ordered, prepend=-1))
        n = np.diff(np.append(head, len(ordered)))
        good = np.flatnonzero(n >= limit)
        if not len(good):
            if limit == least:
                break
            continue
        good = good[np.argsort(-n[good], kind="stable")]
        pairs = ordered[head[good]]
        table = np.full(1 << SLOT_BITS, -1, np.int64)
        table[_slots(pairs[::-1] >> 32, pairs[::-1] & 0xFFFFFFFF)] = np.arange(len(pairs))[::-1]
        which = table[slot[at]]
        ok = (which >= 0) & (pairs[which] == key)
        at, which = at[ok], which[ok]
        # In a run of overlapping hits every second one is taken.
        order = np.arange(len(at))
        first = np.diff(at, prepend=-2) != 1
        ok = (order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0
        at, which = at[ok], which[ok]
        used = np.flatnonzero(np.bincount(which, minlength=len(pairs)))
        rank = np.zeros(len(pairs), np.int64)
        rank[used] = np.arange(len(used))
        sym[at] = base + len(rules) + rank[which]
        rules = np.concatenate([rules, np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1)])
        last[at] = last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, last = sym[keep], last[keep]
    size = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[i] = (size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1)
    return sym, np.diff(np.flatnonzero(last), prepend=-1), rules, size


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of every rule in a row, where each rule's begin, and how many they are; rules of one height are filled together."""
    n = len(rules)
    parts = np.where(rules >= base, rules - base, -1)
    size, height = np.ones(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(parts.tolist()):  # parts come before the rules that use them
        size[i] = (size[a] if a >= 0 else 1) + (size[b] if b >= 0 else 1)
        height[i] = 1 + max(height[a] if a >= 0 else 0, height[b] if b >= 0 else 0)
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int64)
    for h in range(1, int(height.max(initial=0)) + 1):
        at = np.flatnonzero(height == h)
        left = np.where(parts[at, 0] >= 0, size[parts[at, 0]], 1)
        for side, start in ((0, begin[at]), (1, begin[at] + left)):
            plain = parts[at, side] < 0
            flat[start[plain]] = rules[at[plain], side]
            of = parts[at[~plain], side]
            m = size[of]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            flat[np.repeat(start[~plain], m) + step] = flat[np.repeat(begin[of], m) + step]
    return flat, begin, size


def expand(sym: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of a stretch of symbols."""
    sym = sym.astype(np.int64)
    big = sym >= base
    if not big.any():
        return sym
    flat, begin, size = expansions(rules, base)
    of = sym[big] - base
    m = np.ones(len(sym), np.int64)
    m[big] = size[of]
    out = np.repeat(sym, m)
    m = size[of]
    out[np.repeat(big, np.where(big, size[np.where(big, sym - base, 0)], 1))] = flat[np.arange(int(m.sum())) + np.repeat(begin[of] - (np.cumsum(m) - m), m)]
    return out


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).astype("<i8").tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i8")


def shards(docs: DataFrame, tokenizer: str, end: int = END, shard_ids: int = SHARD_IDS, parts: int | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per shard (``SHARD_SCHEMA``), shards in (part, shard) order hold documents in doc_id order."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts is None:
        total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-total // PART_BYTES))
    src = src.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    src = src.withColumn("part", F.spark_partition_id())

    def run(batches):
        give_back()
        encode, held, n, shard = encoder(tokenizer), [], 0, 0

        def flush():
            nonlocal held, n, shard
            doc_ids = np.concatenate([h[0] for h in held])
            null = np.concatenate([h[1] for h in held])
            ids, lens = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            base = int(max(ids.max(initial=0), end)) + 1
            sym, per_doc, rules, size = compress(ids, lens, base)
            bits = int(base + len(rules)).bit_length()
            width = 2 if bits <= 16 else 4
            row = [held[0][4], shard, None if null[0] else int(doc_ids[0]), len(lens), len(ids), base, _pack(np.stack([doc_ids, null])), _pack(per_doc),
                   _pack(np.concatenate([[0], np.cumsum(lens)])), _pack(rules), _pack(size), sym.astype("<u2" if width == 2 else "<u4").tobytes(), width]
            held, n, shard = [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

        for chunk, texts in chunks(batches, limit=CHUNK_BYTES):
            found = [encode(part) for _, part in chunks([chunk], limit=ENCODE_BYTES)]
            ids, lens = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            del found
            ends = np.cumsum(lens + 1) - 1
            out = np.full(len(ids) + len(lens), end, np.int32)
            mask = np.ones(len(out), bool)
            mask[ends] = False
            out[mask] = ids
            d = column(chunk, "doc_id")
            held.append((pc.fill_null(d, 0).to_numpy(zero_copy_only=False).astype(np.int64), d.is_null().to_numpy(zero_copy_only=False).astype(np.int64), out, lens + 1,
                         column(chunk, "part")[0].as_py()))
            n += len(out)
            if n >= shard_ids:
                yield flush()
        if held:
            yield flush()
        encode = None
        give_back()

    return src.mapInArrow(run, SHARD_SCHEMA)


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int32()]
_NAMES = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write ``docs`` as compressed shards to ``path``.

    Null text is empty and has the end id alone; null doc_ids come first; rows that repeat a doc_id stand side by side,
    in order of their texts. An empty table writes no shard. Columns other than doc_id and text are ignored.
    """
    shards(docs, tokenizer, **options).write.parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """Ids before each shard: sums within groups of parts, then over the groups (one row per shard, no texts or ids)."""
    one = files.select("part", "shard", "n_ids", F.floor(F.col("part") / 1024).alias("many"))
    totals = one.groupBy("many").agg(F.sum("n_ids").alias("n"))
    before = totals.select("many", (F.sum("n").over(Window.orderBy("many")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("many").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    return one.withColumn("inner", inner).join(before, "many").select("part", "shard", (F.col("inner") + F.col("before")).alias("shard_start"))


def document(row: dict, i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Random access: ids ``lo`` to ``hi`` of document ``i`` of a shard. Expansion lengths tell which of its symbols to expand."""
    counts = _unpack(row["doc_symbols"])
    rules, size, base = _unpack(row["rules"]).reshape(-1, 2), _unpack(row["expansion"]), row["base"]
    sym = np.frombuffer(row["symbols"], "<u2" if row["width"] == 2 else "<u4", int(counts[i]), int(counts[:i].sum()) * row["width"]).astype(np.int64)
    ends = np.cumsum(np.where(sym >= base, size[np.maximum(sym - base, 0)] if len(size) else 1, 1))
    hi = int(ends[-1]) if hi is None else min(hi, int(ends[-1]))
    first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left"))
    skipped = int(ends[first - 1]) if first else 0
    return expand(sym[first:last + 1], rules, base)[lo - skipped:hi - skipped]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Shard files -> ``(doc_id, start, n_tokens, ids_crc32, part, shard)``; ``start`` counts the ids of all documents before."""
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches):
        give_back()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rules = _unpack(row["rules"]).reshape(-1, 2)
                doc_ids, null = _unpack(row["doc_ids"]).reshape(2, -1)
                counts, starts = _unpack(row["doc_symbols"]), _unpack(row["doc_starts"])
                sym = np.frombuffer(row["symbols"], "<u2" if row["width"] == 2 else "<u4")
                ids = expand(sym, rules, row["base"]).astype("<u4")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, mask=null.astype(bool)), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(counts), row["part"], np.int32)), pa.array(np.full(len(counts), row["shard"], np.int32))],
                    names=["doc_id", "inner", "n_tokens", "ids_crc32", "part", "shard"])
        give_back()

    docs = files.mapInArrow(decode, "doc_id long, inner long, n_tokens long, ids_crc32 long, part int, shard int")
    return docs.join(_starts(files), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")
