"""The tries and parity bitmaps before the comparison of whole sets."""

import random
from fractions import Fraction

import numpy as np

from clampspark.llm import similar

from . import brute

LIMIT = Fraction(4, 5)


def _copies(n: int, words: int = 200):
    """``n`` texts, each with one of which the last three words differ."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(9000)}" for _ in range(words)]
        rows += [(i, " ".join(w)), (1000 + i, " ".join([*w[:-3], "x", "y", "z"]))]
    return rows


def test_near_copies_meet_in_the_tries(spark):
    rows = _copies(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marks = similar._digests(docs, 5).where("block IS NULL")
    met = {tuple(r) for r in similar._trie_pairs(marks.select("doc_id", *similar.SKETCH)).collect()}
    assert len(met & {(i, 1000 + i) for i in range(60)}) >= 58
    assert all(u < v for u, v in met)


def test_tries_alone_link_near_copies(spark, monkeypatch):
    """Without the prefix filter the tries still bring the pairs; with it the groups are those of brute force."""
    rows = _copies(30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.groups(docs).collect()} == brute.jaccard_groups(rows)
    monkeypatch.setattr(similar, "_candidates", lambda prefixes, *_: prefixes.sparkSession.createDataFrame([], "u bigint, v bigint"))
    linked = sum(r.doc_id != r.component_id for r in similar.groups(docs).collect())
    assert linked >= 29


def test_parity_bitmaps_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(3)
    rows, pairs, near = [], [], set()
    for i in range(300):
        n = int(rng.integers(1, 900))
        common = int(n * rng.uniform(0.5, 1))
        both = rng.integers(0, 1 << 63, common, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(k), dtype=np.uint64)])) for k in ((n - common) // 2, (n - common + 1) // 2))
        for k, s in enumerate((x, y)):
            rows.append((2 * i + k, len(s), *similar._parity(s).tolist()))
        pairs.append((2 * i, 2 * i + 1))
        both = len(np.intersect1d(x, y))
        if both * 5 >= (len(x) + len(y) - both) * 4:
            near.add(pairs[-1])
    pairs += [(2 * i, 2 * i + 3) for i in range(299)]
    marks = spark.createDataFrame(rows, "doc_id bigint, n bigint, " + ", ".join(f"{p} bigint" for p in similar.PARITY))
    left = {tuple(r) for r in similar._alike(spark.createDataFrame(pairs, "u bigint, v bigint"), marks, LIMIT).collect()}
    assert near <= left and len(near) > 50
    assert len(left) < len(pairs) / 2
