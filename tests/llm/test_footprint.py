"""What the corpus stages shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from clampspark.llm import mixing, similar

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 977}" for j in range(40 + i % 7)), "en", f"s{i % 3}", 1) for i in range(60)]
    return spark.createDataFrame(rows + [(100 + r[0], *r[1:]) for r in rows[:9]], COLUMNS).repartition(3)


def text_exchanges(df) -> int:
    """Exchanges in the plan whose rows hold the documents' columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if re.search(r"(?<!Broadcast)Exchange (hash|range|Round)", line)]
    return sum("whole#" in "".join(lines[i + 1:i + 3]) for i in at)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_mix_shuffles_documents_once(docs, no_broadcast):
    assert text_exchanges(mixing.apply(docs)) == 1


def test_nulls_and_repeats_keep_their_copies(spark, docs):
    odd = spark.createDataFrame([(None, "a b c", "en", None, 1), (None, "a b d", "en", None, 1), (7, "x y z", "en", None, 1), (7, "x y z", "en", None, 1), (7, None, None, "s0", 0)], COLUMNS)
    rows = docs.union(odd)
    want = mixing.mix(rows).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    size = F.coalesce(F.expr(f"regexp_count(text, '{mixing.WORD}')"), F.lit(0)).cast("long").alias("size")
    got = mixing.apply(rows).groupBy("doc_id", "source", size).agg(F.count(F.lit(1)).alias("n")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_near_duplicates_shuffle_no_document(docs, no_broadcast):
    out = similar.representatives(docs)
    assert text_exchanges(out) == 0
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))


def test_repeated_rows_go_however_many_ids_travel(spark, docs, monkeypatch):
    more = [(3, "another text of this number altogether", "en", "s0", 1), (None, "p q r s t u", "en", "s0", 1), (None, "p q r s t u", "en", "s0", 1), (None, None, None, None, 0)]
    rows = docs.union(docs.where("doc_id < 5")).union(spark.createDataFrame(more, COLUMNS))
    found = []
    for sent in (similar.IDS_SENT, 0):
        monkeypatch.setattr(similar, "IDS_SENT", sent)
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in similar.representatives(rows).collect()))
    assert found[0] == found[1]
    assert len(found[0]) == 60 + 1 + 2
