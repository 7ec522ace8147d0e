"""Language identification by unigram pieces, summed over all segmentations.

The pieces come from a fixed public vocabulary (every byte is one, so any text can be segmented). Each language
has a probability per piece, trained by expectation maximisation on a bounded sample of labelled rows. A word's
probability is the sum over all its segmentations (forward algorithm); a text's is the product over its words.
Words are runs of letters, lower-cased, scored once per chunk however often they occur.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clampspark.llm.text import LETTER, chunks, column, mix, row_filter, whole, words

UNIT_BYTES = 48      # bytes of a word worked on at a time; the forward columns are carried on to the next ones
SHORT = 8            # longer pieces are looked up only where their last bytes are those of such a piece
ROWS = 1 << 14       # words times languages in one block
SAMPLE_DOCS = 1500   # training rows per language, about (bounded sample)
ROUNDS = 2           # expectation-maximisation rounds
SCALE = 64.0         # per byte, keeps products in range

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def vocabulary(path: str) -> list[bytes]:
    """Every piece of a rank file that is letters with at most a space before them, of any length, and every byte."""
    pieces = {bytes([b]) for b in range(1, 256)}
    with open(path, "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0])
            if b"\0" not in piece and all(LETTER[c] for c in piece[piece[:1] == b" ":]):
                pieces.add(piece.lower() if piece.isascii() else piece)
    return sorted(pieces)


class Pieces:
    """The vocabulary by a 64-bit hash of each piece that is quick to get for any stretch of a word."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.longest = int(self.size.max(initial=1))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]))
        keys = np.array([self._key(x) for x in pieces], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.find = Lookup(keys)
        long = self.size > SHORT
        self.tails = Lookup(np.unique(np.array([self._key(x[-SHORT:]) for x in pieces if len(x) > SHORT], np.uint64))) if long.any() else None
        self.short_sizes = [n for n in range(1, min(SHORT, self.longest) + 1)]
        self.long_sizes = sorted(set(self.size[long].tolist()))

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + int(_BYTE[b])) & 0xFFFFFFFFFFFFFFFF
        return h

    def __len__(self):
        return len(self.size)


class Lookup:
    """Hash table over packed pieces: id, or -1."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        self.probes = 1
        home = self._home(keys)
        for i, h in enumerate(home.tolist()):
            n = 1
            while self.table[h] >= 0:
                h = (h + 1) & (len(self.table) - 1)
                n += 1
            self.table[h] = i
            self.probes = max(self.probes, n)

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.table[at]
        hit = (got >= 0) & (self.keys[got] == keys)
        out = np.where(hit, got, -1)
        todo = np.flatnonzero((got >= 0) & ~hit)
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
            got = self.table[at[todo]]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            todo = todo[(got >= 0) & ~hit]
        return out


class Block:
    """Distinct words with a leading space, longest first, worked on in waves of ``UNIT_BYTES`` bytes.

    A wave's buffers begin with the last columns of the wave before it, as many as the longest piece has bytes, so segmentations
    run across waves as if there were none. Columns are scaled anew at each wave.
    """

    def __init__(self, words_: list[bytes], pieces: Pieces):
        self.pieces, self.n = pieces, len(words_)
        self.lens = np.array([len(w) + 1 for w in words_], np.int64)
        self.buf = np.frombuffer(b"".join(b" " + w for w in words_) + bytes(UNIT_BYTES), np.uint8)
        self.off = np.cumsum(self.lens) - self.lens
        self.unit = int(min(UNIT_BYTES, self.lens.max(initial=1)))
        self.back = pieces.longest
        self.waves = -(-int(self.lens.max(initial=1)) // self.unit)

    def active(self, byte: int) -> int:
        """Words longer than ``byte`` bytes; they come first."""
        return int(np.searchsorted(-self.lens, -byte, "left"))

    def arcs(self, w: int, hashes: np.ndarray):
        """Pieces that end in wave ``w``: ``(end, size, rows, ids)``, ends rising; ``rows`` is a slice or an index."""
        p, back, base = self.pieces, self.back, w * self.unit
        m = self.active(base)
        mat = self.buf[self.off[:m, None] + base + np.arange(self.unit)]
        for end in range(1, int(min(self.unit, self.lens[0] - base)) + 1):
            n = self.active(base + end - 1)
            hashes[:n, back + end] = hashes[:n, back + end - 1] * _BASE + _BYTE[mat[:n, end - 1]]
            here, near = hashes[:n, back + end], None
            for size in p.short_sizes:
                if size > base + end:
                    break
                key = here - hashes[:n, back + end - size] * p.power[size]
                yield end, size, slice(0, n), p.find(key)
                if size == SHORT and p.tails is not None:
                    near = np.flatnonzero(p.tails(key) >= 0)
            if near is not None and len(near):
                for size in p.long_sizes:
                    if size > base + end:
                        break
                    ids = p.find(here[near] - hashes[near, back + end - size] * p.power[size])
                    hit = ids >= 0
                    if hit.any():
                        yield end, size, near[hit], ids[hit]

    def forward(self, probs: np.ndarray, store: list | None = None) -> np.ndarray:
        """Log probability of each word (rows) under each language (columns); ``probs[id, lang]``, a last row of zeros.

        ``store`` receives per wave the scaled columns, the arcs, and the factor the carried columns were divided by.
        """
        back, width, k = self.back, self.back + self.unit + 1, probs.shape[1]
        alpha, hashes = np.zeros((width, self.n, k)), np.zeros((self.n, width), np.uint64)
        out, logs = np.zeros((self.n, k)), np.zeros((self.n, k))
        steps = SCALE ** np.arange(back + 1)
        alpha[back] = 1.0
        for w in range(self.waves):
            m, scale = self.active(w * self.unit), np.ones((self.n, k))
            if w:
                alpha[:back + 1, :m], hashes[:m, :back + 1] = alpha[self.unit:, :m].copy(), hashes[:m, self.unit:].copy()
                alpha[back + 1:] = 0.0
                scale[:m] = alpha[:back + 1, :m].max(0)
                scale[scale <= 0] = 1.0
                alpha[:back + 1, :m] /= scale[:m]
                logs += np.log(scale)
            arcs = []
            for end, size, rows, ids in self.arcs(w, hashes):
                alpha[back + end, rows] += alpha[back + end - size, rows] * probs[ids] * steps[size]
                if store is not None:
                    arcs.append((end, size, rows, ids))
            done = np.arange(self.active((w + 1) * self.unit), m)
            last = alpha[back + self.lens[done] - w * self.unit, done]
            out[done] = np.log(np.maximum(last, 1e-300)) + logs[done] - self.lens[done, None] * np.log(SCALE)
            if store is not None:
                store.append((alpha[:, :m].copy(), arcs, scale))
        return out

    def counts(self, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece under one language's ``probs``, words counted ``weight`` times."""
        store: list = []
        self.forward(probs[:, None], store)
        back, out = self.back, np.zeros(len(probs))
        steps, beta = SCALE ** np.arange(back + 1), np.zeros((self.back + self.unit + 1, self.n))
        for w in range(self.waves - 1, -1, -1):
            alpha, arcs, _ = store[w]
            m, further = self.active(w * self.unit), self.active((w + 1) * self.unit)
            if w < self.waves - 1:
                beta[self.unit:, :further] = beta[:back + 1, :further] / store[w + 1][2][:further, 0]
                beta[:self.unit] = 0.0
            done = np.arange(further, m)
            beta[:, done] = 0.0
            at = back + self.lens[done] - w * self.unit
            beta[at, done] = 1.0 / np.maximum(alpha[at, done, 0], 1e-300)
            for end, size, rows, ids in reversed(arcs):
                flow = probs[ids] * steps[size] * beta[back + end, rows]
                used = alpha[back + end - size, rows, 0] * flow * weight[rows]
                out += np.bincount(np.where(ids < 0, len(probs) - 1, ids), used, len(probs))
                beta[back + end - size, rows] += flow
        out[-1] = 0
        return out


def _blocks(distinct: pa.Array, langs: int):
    """Places of distinct words in blocks of bounded size, longest first, each with its words."""
    order = np.argsort(-pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64), kind="stable")
    step = max(64, ROWS // max(1, langs))
    for at in range(0, len(order), step):
        part = order[at:at + step]
        yield part, distinct.take(pa.array(part)).to_pylist()


class Model:
    def __init__(self, langs: list[str], vocab: list[bytes], probs: np.ndarray):
        self.langs, self.vocab, self.probs = langs, vocab, probs

    def word_scores(self, distinct: pa.Array, pieces: Pieces) -> np.ndarray:
        out = np.zeros((len(distinct), len(self.langs)))
        for at, words_ in _blocks(distinct, len(self.langs)):
            out[at] = Block(words_, pieces).forward(self.probs)
        return out


def expected_counts(distinct: pa.Array, counts: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece when words (with their counts) are segmented under one language's ``probs``."""
    out = np.zeros(len(probs))
    for at, words_ in _blocks(distinct, 4):
        out += Block(words_, pieces).counts(probs, counts[at])
    return out


def train(docs: DataFrame, vocab_path: str, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, keep: str | None = None) -> Model:
    """``docs(doc_id, text, lang)``; ``keep``: SQL condition on training rows.

    About ``sample_docs`` rows per language are read, chosen by a hash of doc_id, so that reruns agree. Piece counts are
    summed by Spark; the driver holds one number per piece and language. A language whose rows hold no letters is learned
    with its prior alone. Null lang or null text rows are not used; without any labelled row the model has no language.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    if keep:
        rows = rows.where(keep)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs, vocab = sorted(sizes), vocabulary(vocab_path)
    probs = np.zeros((len(vocab) + 1, len(langs)))
    if not langs:
        return Model([], vocab, probs)
    cut = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / sizes[k]))])
    part = F.pmod(F.xxhash64(F.lit("lang sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(part < cut[F.col("lang")]).select("lang", F.lower("text").alias("text"))
    size = np.array([len(x) for x in vocab])
    probs[:-1] = (0.02 ** np.minimum(size, 4) / size)[:, None]
    for _ in range(rounds):
        now = probs.copy()

        def count(batches):
            pieces = Pieces(vocab)
            for chunk, texts in chunks(batches):
                w = words(texts, LETTER)
                lang = np.array([langs.index(x) for x in column(chunk, "lang").to_pylist()])
                of = lang[w.doc] if len(w.ids) else np.zeros(0, np.int64)
                for k in np.unique(of):
                    ids, n = np.unique(w.ids[of == k], return_counts=True)
                    got = expected_counts(w.distinct.take(pa.array(ids)), n.astype(float), pieces, now[:, k])
                    hit = np.flatnonzero(got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(hit.astype(np.int32)), pa.array(got[hit])],
                                                     names=["k", "piece", "n"])

        got = sample.mapInArrow(count, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        probs[:] = 0
        probs[got["piece"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
        probs[:-1] += 0.02
        probs /= probs.sum(0)
        probs[-1] = 0
    return Model(langs, vocab, probs)


def _predictor(model: Model):
    """Function from (lower-cased texts, whether each has a letter) to (languages, scores, numbers of words)."""
    langs, pieces = model.langs, Pieces(model.vocab)

    def predict(texts: pa.Array, letters: list):
        w = words(texts, LETTER)
        n = np.diff(w.bounds)
        total = np.zeros((len(n), max(1, len(langs))))
        if langs and len(w.ids):
            ll = np.zeros((len(w.ids) + 1, len(langs)))
            np.cumsum(model.word_scores(w.distinct, pieces)[w.ids], 0, out=ll[1:])
            total = ll[w.bounds[1:]] - ll[w.bounds[:-1]]
        total = total * (np.minimum(n, 16) / np.maximum(n, 1))[:, None]
        best = total.argmax(1)
        p = np.exp(total - total.max(1, keepdims=True))
        p = p[np.arange(len(best)), best] / p.sum(1)
        known = np.array(letters, bool) & (n > 0) & bool(langs)
        return [langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, p, 0.0), n

    return predict


_LETTERS = r"coalesce(text rlike '\\p{L}', false)"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, lang_pred, score, n_letter_words)``, one row per input row.

    ``score`` is the posterior of ``lang_pred`` under equal priors with the log likelihood per word, capped at
    a weight of 16 words, so that long texts do not all end at 1. Null text, text without a letter, or a model without
    languages: ``und`` with score 0. Ties go to the first language in order. Columns other than doc_id and text are ignored.
    """
    def run(batches):
        predict = _predictor(model)
        for chunk, texts in chunks(batches):
            langs, scores, n = predict(texts, column(chunk, "letters").to_pylist())
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(n.astype(np.int64))],
                                             names=["doc_id", "lang_pred", "score", "n_letter_words"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), F.expr(_LETTERS).alias("letters"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, n_letter_words long")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whatever their names, whose language is told with a score of at least ``least``; no shuffle.

    ``und`` has score 0, so null texts and texts without a letter go. Repeated rows and null doc_ids are judged each on its own; an empty table stays empty.
    """
    def make():
        predict = _predictor(model)

        def mask(texts: pa.Array) -> np.ndarray:
            return predict(whole(texts), texts.is_valid().to_pylist())[1] >= least
        return mask

    # A text without a letter is sent as null.
    return docs.where(row_filter(make)(F.when(F.expr(_LETTERS), F.lower("text"))))
