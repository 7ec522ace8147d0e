"""What a Python worker holds while it encodes documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clampspark.llm import repair
from clampspark.llm.queries import vocab


@pytest.fixture
def task(spark, monkeypatch):
    """The function that runs in the tasks of ``repair.shards``."""
    caught = []
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f))
    repair.shards(docs, vocab("byte_bpe_50k.json"), parts=1)
    return caught[0]


def test_little_text_is_encoded_at_a_time(task, monkeypatch):
    sizes, returned = [], []

    def encoder(path):
        def encode(texts):
            sizes.append(sum(len(t) for t in texts.to_pylist()))
            return np.arange(sum(map(len, texts.to_pylist())), dtype=np.int32) % 7, np.array([len(t) for t in texts.to_pylist()], np.int64)
        return encode

    monkeypatch.setattr(repair, "encoder", encoder)
    monkeypatch.setattr(repair, "give_back", lambda: returned.append(1), raising=False)
    texts = ["x" * 300_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts), pa.array([0] * 20, pa.int32())], names=["doc_id", "text", "part"])
    out = list(task([batch]))
    assert max(sizes) <= 1 << 20 and sum(sizes) == 6_000_000
    assert sum(b.column(3)[0].as_py() for b in out) == 20
    assert len(returned) == 2


def test_a_worker_does_not_grow_with_its_tasks(task):
    def held() -> float:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    rng, sizes = random.Random(3), []
    for _ in range(16):
        texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(100)) for _ in range(120)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(texts), pa.array([0] * 120, pa.int32())], names=["doc_id", "text", "part"])
        assert sum(b.num_rows for b in task([batch])) == 1
        sizes.append(held())
    assert sizes[-1] - sizes[3] < 16, sizes
