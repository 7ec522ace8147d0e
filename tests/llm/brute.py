"""Plain Python versions of the operators' results, on lists of rows."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

SHAPES = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
          ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def secrets(text):
    """[(start, place, kind, end)] of the three base kinds, and the digest."""
    text = text or ""
    out = sorted((m.start(), i, kind, m.end()) for i, (kind, p, g, least) in enumerate(SHAPES) for m in p.finditer(text) if len(m[g]) >= least)
    return out, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in out).encode()).hexdigest()


def tokens(rows, tok, end=2):
    """rows: (doc_id, text) in order -> (doc_id, start, n_tokens, crc)."""
    out, at = [], 0
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def edited(rows):
    """rows: (doc_id, text) -> {doc_id: (n_chars, sha of the edited text)} for distinct ids."""
    rows = sorted(rows, reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        out[i] = (n, hashlib.sha256((t[:n - n // 2] + u[:n // 2]).encode()).hexdigest())
    return out


def simhash(text, k=3, seed=42):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[a:a + k]), seed) for a in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near(rows, budget=2):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component)}"""
    ids = sorted(i for i, _ in rows)
    fp = {i: simhash(t) for i, t in rows}
    f = np.array([fp[i] for i in ids], np.uint64)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for i, v in zip(ids, f):
        for b in np.flatnonzero(np.bitwise_count(v ^ f) <= budget):
            x, y = find(i), find(ids[b])
            up[max(x, y)] = min(x, y)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def repeats(rows, width=13):
    """rows: (doc_id, text) -> sorted [(doc_id, n_words, n_removed, sha of kept)]"""
    first, split = {}, []
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", t or "")
        split.append((i, w))
        for a in range(len(w) - width + 1):
            k = tuple(w[a:a + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a:a + width])] < i:
                gone[a:a + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def chats(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: (n_turns, sha, loss chars, loss sha)}"""
    by = {}
    for c, n, r, t in rows:
        by.setdefault(c, []).append((n, r or "", t or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in ts)
        out[c] = (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: size} -> {source: target} by handing the excess on, round after round."""
    src = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {x: weights[k % len(weights)] for k, x in enumerate(src)}
    out, free, budget = {}, set(src), share * sum(sizes.values())
    while free:
        rest, total = budget - sum(out.values()), sum(w[x] for x in free)
        over = [x for x in free if rest * w[x] / total > most * sizes[x]]
        if not over:
            return out | {x: rest * w[x] / total for x in free}
        for x in over:
            out[x] = most * sizes[x]
            free.discard(x)
    return out


def jaccard_groups(rows, k=5):
    """rows: (doc_id, text) -> {doc_id: smallest doc_id reachable over pairs of similarity 4/5 or more}"""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a:a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    has = {}
    for i, s in sets.items():
        for x in s or {()}:
            has.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in {(a, b) for ids in has.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}
