"""Steps that meet very many small keys: files, runs, states, stimuli."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clampspark.operators.ordered import running, running_by_size
from clampspark.plans import steps
from clampspark.session import small_files
from clampspark.streaming.live import _Alerts
from registry import catalog, stimuli


def test_small_files_spread_over_tasks(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 200).alias("k"), F.col("id").cast("string").alias("value")).coalesce(1)
    writer, n = small_files(df, [F.col("k")], per_task=20)
    writer.partitionBy("k").text(str(tmp_path / "out"))
    names = [f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part-")]
    assert n == len(names) == 200
    assert len({f[:10] for f in names}) > 5
    assert spark.read.text(str(tmp_path / "out")).count() == 1000


def test_csv_has_one_file_per_recording(spark, tmp_path):
    cols = {"stimulus_name": "a", "t_start_s": 1.0, "t_end_s": 2.0, "n_steps": 3, "min_amp_pA": 1.0, "max_amp_pA": 2.0, "rmp_mV": -70.0, "input_resistance_MOhm": 5.0}
    df = spark.range(60).repartition(7).select((F.col("id") % 6).alias("recording_id"), F.floor(F.col("id") / 6).alias("staircase_index"), *[F.lit(v).alias(c) for c, v in cols.items()])
    assert steps.write_csv(df, ["recording_id"], str(tmp_path / "csv"))
    files = {r: [f for f in fs if f.endswith(".csv")] for r, _, fs in os.walk(tmp_path / "csv") if "recording_id_part=" in r}
    assert len(files) == 6 and all(len(f) == 1 for f in files.values())
    assert not steps.write_csv(df.limit(0), ["recording_id"], str(tmp_path / "none"))


def _staircases(spark, rows, key):
    cols = ("staircase_index bigint, stimulus_name string, t_start_s double, t_end_s double, n_steps bigint, min_amp_pA double, max_amp_pA double, "
            f"rmp_mV double, input_resistance_MOhm double, recording_id {key}")
    return spark.createDataFrame(rows, cols).repartition(5)


def _lines(path):
    """Lines below each innermost folder, and the files."""
    found = {}
    for r, _, fs in os.walk(path):
        for f in fs:
            if f.endswith(".csv"):
                text = open(f"{r}/{f}", newline="").read()
                assert text.endswith("\n")
                found.setdefault(os.path.basename(r), []).append(sorted(text.split("\n")))
    return found


def test_csv_folders_lie_in_few_folders(spark, tmp_path):
    rows = [(i // 400, "a", 1.0, 2.0, 3, 1.0, 2.0, -70.0, 5.0, i % 400) for i in range(1000)]
    assert steps.write_csv(_staircases(spark, rows, "bigint"), ["recording_id"], str(tmp_path / "csv"))
    assert len([x for x in os.listdir(tmp_path / "csv") if "=" in x]) <= 20
    assert len(_lines(tmp_path / "csv")) == 400
    # Nothing came by Spark's writer, which on a mounted store starts a program for every file.
    assert not [f for _, _, fs in os.walk(tmp_path / "csv") for f in fs if f.endswith(".crc")]
    got = sorted((r.recording_id, r.staircase_index, r.n_steps) for r in steps.read_csv(spark, str(tmp_path / "csv"), ["recording_id"]).collect())
    assert got == sorted((i % 400, i // 400, 3) for i in range(1000))


def test_csv_is_as_spark_writes_it(spark, tmp_path, monkeypatch):
    odd = [None, "", "a,b", 'say "x"', " lead and trail ", "\\", "é", "#", "null"]
    keys = [None, "a", "a b", "x/y=z%", "q:?*[]{}^'\"#\\", "é", "..", "\x7f\t"]
    rows = [(i, odd[i % 9], float(i) / 3, 1e300 * i, None if i % 4 == 0 else i, -0.0, float("nan") if i % 5 == 0 else 1e-9, None, float("inf"), keys[i % 8]) for i in range(144)]
    df = _staircases(spark, rows, "string")
    assert steps.write_csv(df, ["recording_id"], str(tmp_path / "own"))
    monkeypatch.setattr(steps, "mounted_path", lambda *_: None)
    assert steps.write_csv(df, ["recording_id"], str(tmp_path / "spark"))
    assert _lines(tmp_path / "own") == _lines(tmp_path / "spark")
    assert len(_lines(tmp_path / "own")) == 8


def test_csv_in_parts_and_in_other_stores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(steps, "CSV_ROWS", 10)
    rows = [(i, "two\nlines", 1.0, 2.0, 3, 1.0, 2.0, None, 5.0, k) for k, n in ((None, 3), (7, 25), (-8, 1)) for i in range(n)]
    want = sorted([(k, i, "two\nlines", None) for i, *_, k in rows], key=str)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.many.link./out", f"file://{tmp_path}")
    for path in (str(tmp_path / "own"), f"file://{tmp_path}/uri", "viewfs://many/out/spark"):
        assert steps.write_csv(_staircases(spark, rows, "bigint"), ["recording_id"], path)
        back = steps.read_csv(spark, path, ["recording_id"])
        assert sorted([(r.recording_id, r.staircase_index, r.stimulus_name, r.rmp_mV) for r in back.collect()], key=str) == want
        files = {k: len(v) for k, v in _lines(tmp_path / path.rsplit("/", 1)[1]).items()}
        # Spark's writer puts the parts that one task holds into one file.
        assert files == {"recording_id_part=__HIVE_DEFAULT_PARTITION__": 1, "recording_id_part=7": 1 if path.startswith("viewfs") else 3, "recording_id_part=-8": 1}
    with pytest.raises(FileExistsError):
        steps.write_csv(_staircases(spark, rows, "bigint"), ["recording_id"], str(tmp_path / "own"))
    assert not steps.write_csv(_staircases(spark, [], "bigint"), ["recording_id"], str(tmp_path / "none"))
    assert steps.read_csv(spark, str(tmp_path / "none"), ["recording_id"]).count() == 0


def test_sidecars_lie_in_few_folders(spark, tmp_path):
    rows = [(i, f"s{i}", i % 25, float(i)) for i in range(1, 601)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    back = catalog.sidecars(spark, str(tmp_path))
    files = [r[0] for r in back.select("metadata_file").collect()]
    assert len(set(files)) == 600 and len({os.path.dirname(f) for f in files}) <= catalog.FOLDERS
    got = {r.id: r for r in catalog.scan_sidecars(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 601)) and got[9].damaged and got[3].clamp_mode == "voltage_clamp" and got[4].expt_id == "s4"


def test_running_by_size(spark):
    rows = [(None if k == 3 else k, i, i * k % 7) for k, n in ((0, 50), (1, 3), (2, 400), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, at bigint, v bigint").repartition(5)
    for inclusive in (True, False):
        values = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "near": ("last", F.when(F.col("v") > 2, F.col("at")))}
        want = sorted(running(df, ["k"], ["at"], F.floor(F.col("at") / 16), values, inclusive).collect(), key=str)
        for most in (1, 45, 1000):
            assert sorted(running_by_size(df, ["k"], ["at"], F.floor(F.col("at") / 16), values, inclusive, most).collect(), key=str) == want
    wide = running_by_size(df, ["k"], ["at"], F.floor(F.col("at") / 16), {"n": ("sum", F.lit(1).cast("bigint"))}, False)
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()


class _State:
    def __init__(self):
        self.value, self.asked = {}, 0

    def exists(self):
        return bool(self.value)

    def get(self):
        return self.value["v"]

    def update(self, v):
        self.value["v"] = v

    def containsKey(self, k):
        self.asked += 1
        return k in self.value

    def getValue(self, k):
        return self.value[k]

    def updateValue(self, k, v):
        self.value[k] = v

    def removeKey(self, k):
        del self.value[k]


class _Handle:
    def getValueState(self, *_):
        return _State()

    getMapState = getValueState


def test_chunks_in_order_do_not_ask_the_map():
    p = _Alerts(5, 3, 10)
    p.init(_Handle())

    def batch(*seqs):
        frame = pd.DataFrame({"chunk_seq": seqs, "available": [9] * len(seqs)})
        return [tuple(r) for f in p.handleInputRows((1,), iter([frame]), None) for r in f[["chunk_seq", "kind"]].itertuples(index=False)]

    assert batch(*range(100)) == [(i, "chunk") for i in range(0, 100, 3)]
    assert p.early.asked == 0
    assert batch(102, 102, 99, 104) == [(99, "late"), (102, "late")] and p.early.asked == 0
    assert batch(100, 101, 102) == [(102, "chunk"), (102, "late")]
    assert list(p.early.value) == [(104,)] and batch(103) == [] and not p.early.value
    assert batch(105) == [(105, "chunk")]


def test_only_used_stimuli_are_laid_out(spark, tmp_path):
    cols = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame([(i, f"n{i}", "b", ("ECONOMY", "LARGE", "PROMO")[i % 3], 5 + i) for i in range(30)], cols).write.parquet(str(tmp_path / "part.parquet"))
    used = spark.createDataFrame([(3,), (7,), (7,), (99,), (None,)], "stimulus_index bigint")
    every = stimuli.segments(spark, str(tmp_path))
    got = stimuli.segments(spark, str(tmp_path), used)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.where("stimulus_index IN (3, 7)").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")
