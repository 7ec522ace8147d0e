"""Registered queries 11 to 13 over small tables, against plain Python: ties, nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from clampspark.llm import QUERIES, load_all, packing, structure, whitening
from clampspark.llm.queries import vocab

load_all()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    words = ["It's", "naïve", "Straße", "x<|endoftext|>y", "ΣΑΣ", "éa", "3.14", "don't!!", "\U0001f600", "中文字", "a b", "\x1c"] + [f"w{i}" for i in range(50)]
    docs = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(0, 300)))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, " \t\n"), (42, "same id"), (None, "no id"), (43, "long words " * 60_000), (44, docs[3][1])]
    spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id bigint, text string, length int, start int, _part int").repartition(3).write.parquet(f"{d}/documents.parquet")

    g = np.random.default_rng(4)
    e = (g.standard_normal((300, 6)) @ g.standard_normal((6, 6))).astype(np.float32)
    vecs = [(i, v.tolist()) for i, v in enumerate(e)] + [(1000 + i, e[5].tolist()) for i in range(400)]
    vecs += [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [1.0, 2.0]), (None, e[9].tolist()), (7, e[8].tolist())]
    spark.createDataFrame([(*r, 9, 9) for r in vecs], "vec_id bigint, embedding array<float>, x int, _key int").repartition(3).write.parquet(f"{d}/embeddings.parquet")

    texts = ["Yes.", "no", "  ", "", None, "Go!\n", "What?  ", "a. b"]
    conv = []
    for c in range(150):
        for t in range(rng.randrange(1, 9)):
            conv.append((c if c else None, None if rng.random() < 0.05 else t + (t > 4), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    conv += [(900, t, "user" if t % 2 else "assistant", f"line {t % 700}.") for t in range(2600)]
    conv += [(901, t, ["user", "assistant"][t % 2], f"fine {t}.") for t in range(300)]
    spark.createDataFrame([(*r, 1, 2) for r in conv], "conv_id bigint, turn bigint, role string, text string, pos int, place int").repartition(3).write.parquet(f"{d}/conversations.parquet")
    return d, docs, vecs, conv


def test_power_of_two(spark, tables):
    from tokenizers import Tokenizer
    d, docs, _, _ = tables
    tok = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    want = []
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        while at < len(ids):
            n = min(2048, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((i, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids), 0))
            at += n
    rows = QUERIES["op11_power_of_two"](spark, d).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows), key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in rows}) == len(rows) and {1, 2, 2048} <= {r.length for r in rows}
    assert sorted(r.length for r in sorted(rows, key=lambda r: r.sequence_id)) == [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]


def test_words_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    rng = random.Random(12)
    bits = ["a", "Word", "12", "7", ".", "..", "'", "'s", "'T", " ", "\n", "\t", "é", "ÀÉ", "×", "÷", "İ", "ß", "Ǆ", "中文", "\u00a0", "\u3000", "e\u0301", "\u0301", "\U0001f600",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "<", "_", "-", "\x1c", "\x00", "\x85", "½", "٣", "ΣΑΣ", "don't", "\u212a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(6000)] + ["x" * 50_000, ""]
    encode = packing.encoder(vocab("word_bpe_49k.json"))
    for at in range(0, len(texts), 1500):
        part = texts[at:at + 1500]
        ids, lens = encode(pa.array(part, pa.large_string()))
        ends = np.cumsum(lens)
        for t, a, b in zip(part, ends - lens, ends):
            assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_buckets_on_disk(spark, tables, tmp_path, monkeypatch):
    d, docs, _, _ = tables
    monkeypatch.setattr(packing, "KNOWN_WORDS", 30)  # forgets its words again and again
    packing.write(spark.read.parquet(f"{d}/documents.parquet"), str(tmp_path / "b"), vocab("word_bpe_49k.json"), longest=64)
    got = packing.batches(spark, str(tmp_path / "b"), 256, 64).collect()
    sizes = [sum(1 for r in got if r.batch_id == b) for b in {r.batch_id for r in got}]
    assert max(sizes) == 4 and sum(s < 4 for s in sizes) <= 3 and all(len(r.ids) == 256 for r in got)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pieces(none, vocab("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(none, "x", longest=48)


def test_whitening(spark, tables):
    d, _, vecs, _ = tables
    rows = QUERIES["op12_qdwh_whitening"](spark, d).collect()
    good = [(i, v) for i, v in vecs if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in good}
    fit = np.array(sorted({tuple(np.floor(256 * np.array(v, float)).astype(int)) for _, v in good}))
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    assert len(rows) == 4 * len(good) and {r.n for r in rows} == {n}
    sign = {}
    for r in rows:
        if r.vec_id == 7:
            continue  # given twice
        v, k = x[r.vec_id], r.component - 1
        want = (v - s / n) @ q[:, k] / np.sqrt(e[k])
        if abs(want) > 1e-3:
            assert sign.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-9 * max(1, abs(want))
        assert r.deviation == int(((n * v - s) ** 2).sum()) == int(r.deviation_text)
        assert abs(r.explained - e[k] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9


@pytest.mark.parametrize("kind", ["random", "low rank", "clusters", "diagonal", "ones", "one", "zero"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_divide_and_conquer(kind, n):
    g = np.random.default_rng(n)
    q = np.linalg.qr(g.standard_normal((n, n)))[0]
    low = g.standard_normal((2, n))
    a = {"random": q * g.uniform(0, 9, n) @ q.T, "low rank": low.T @ low, "clusters": q * np.repeat([5.0, 1.0], [n // 2, n - n // 2]) @ q.T,
         "diagonal": np.diag(np.arange(n) * 1.0), "ones": np.ones((n, n)), "one": np.diag([0.0] * (n - 1) + [1.0]), "zero": np.zeros((n, n))}[kind]
    e, v = whitening.eigen(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * n) and np.allclose(a @ v, v * e, atol=1e-11 * n) and np.allclose(v.T @ v, np.eye(n), atol=1e-11)
    top, w = whitening.eigen(a, 3)
    assert np.allclose(top, e[:3], atol=1e-12 * n) and w.shape[1] == min(3, n)


def test_whitening_edges(spark):
    def run(rows):
        x = whitening.vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
        m = whitening.fit(x)
        return m, [] if m is None else whitening.apply(x, m).collect()
    assert run([])[0] is None and run([(1, None)])[0] is None
    assert run([(1, [1.0, 2.0])] * 3)[1] == []                       # no variance, no component
    m, rows = run([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])
    assert m.n == 2 and [r.component for r in rows] == [1, 1, 1] and m.identity_error < 1e-12
    m, rows = run([(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [3e14, 5.0])])
    assert all(r.deviation is None and int(r.deviation_text) > 1 << 63 for r in rows if r.vec_id > 1) and len(rows) >= 3


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how:
            x = "" if how == 1 else "".join(k for k in x if k not in ".!?") if how == 2 else x
            out[c] += [(t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)
    return {c: sorted(v, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        core = x.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, fault):
    """Least (cost, audit) by Dijkstra's search over (rows done, last output): no matrices, no grammar."""
    nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for to, full in (("u", "user"), ("a", "assistant")):
            if (state, to) in nxt:
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, f"{full}:")))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault[i] in ("", "truncated"):
                more = fault[i] == "truncated"
                if (state, r[:1]) in nxt:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[:1], (*out, f"{r}:{x}")))
                for to, full in (("u", "user"), ("a", "assistant")):
                    if (state, to) in nxt:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*out, f"{full}:{x}")))


def want_repair(conv):
    want = {}
    for c, rows in damage(conv).items():
        f = faults(rows)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, out = cheapest(rows, f)
        want[c] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return want


def test_grammar_repair(spark, tables):
    d, _, _, conv = tables
    rows = QUERIES["op13_grammar_repair"](spark, d).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    want = want_repair(conv)
    assert len(rows) == len(want) == len(got)
    assert got == want


def test_repair_across_segments(spark, tables):
    """Segments of three rows and many range partitions change nothing; repaired rows carry their edits."""
    d, _, _, conv = tables
    df = spark.read.parquet(f"{d}/conversations.parquet")
    landed, edits = structure.analyse(structure.damaged(df), parts=7, size=3)
    want = want_repair(conv)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in structure.digests(df, landed, edits).collect()}
    assert got == want
    out = {}
    for r in sorted(structure.repaired(landed, edits).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(out.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_repair_of_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    landed, edits = structure.analyse(structure.damaged(df))
    assert structure.digests(df, landed, edits).count() == 0 and structure.repaired(landed, edits).count() == 0


def test_shared_rules():
    """Equal strings share one matrix, and the grammar gives what the plain product gives."""
    g = np.random.default_rng(2)
    strings = [g.choice([4, 8, 5, 0, 9, 13, 6], n) for n in g.integers(1, 40, 200)]
    strings += strings[:50]
    ms = structure.matrices(strings)
    assert ms[0] is ms[200]
    for s, m in zip(strings, ms):
        p = structure.terminal(int(s[0]))
        for k in s[1:]:
            p = structure.product(p, structure.terminal(int(k)))
        assert [[e and (e[0], structure.flat(e[1])) for e in row] for row in m] == [[e and (e[0], structure.flat(e[1])) for e in row] for row in p]
