"""Splittable CSV and JSON scans against readers of whole files, with ranges of few bytes."""

import json
import os
import random
import re
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.operators.ranking import global_rank
from runlens.sinks import files as W
from runlens.sources import files as SRC
from runlens.sources.ordered import csv_records, json_strings


@pytest.fixture(params=[37, 200, 1 << 27])
def ranges(spark, request):
    """Bytes of a range."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def _dir():
    return tempfile.mkdtemp(prefix="runlens-test-")


def field(rng):
    return rng.choice(["", "x", "a,b", 'say "yes"', "two\nlines", "\n\n", '"', '""', "é😀\u3000", "tab\t", "long " * 40, " spaced ", 'end"\n', ",,", "#", "\n,\n\"\n"])


def write_csv(path, rows, columns, **kw):
    pd.DataFrame(rows, columns=columns).to_csv(path, index=False, encoding="utf-8-sig", **kw)


def test_records_equal_the_one_task_reader(spark, ranges):
    rng = random.Random(ranges)
    d, columns, want = _dir(), ["a", "b", "c"], {}
    for n in range(4):
        rows = [[field(rng) for _ in columns] for _ in range(rng.choice([0, 1, 60]))]
        write_csv(f"{d}/{n}.csv", rows, columns, lineterminator="\r\n" if n == 2 else "\n", quoting=n % 2)
        want[f"{n}.csv"] = 1 + len(rows)
    records = csv_records(spark, d).withColumn("f", F.element_at(F.split("f", "/"), -1)).cache()
    by_file = {}
    for r in records.collect():
        by_file.setdefault(r.f, []).append(r.row)
    assert {f: sorted(rows) for f, rows in by_file.items()} == {f: list(range(n)) for f, n in want.items()}
    for f in want:
        whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(f"{d}/{f}")
        parsed = records.where((F.col("f") == f) & (F.col("row") > 0)).select("row", F.from_csv("text", "a string, b string, c string", {"escape": '"'}).alias("r"))
        got = [tuple(x) for x in parsed.orderBy("row").select("r.*").collect()]
        assert got == [tuple(x) for x in whole.collect()]


def test_a_file_is_read_by_many_tasks(spark):
    d = _dir()
    write_csv(f"{d}/x.csv", [["line\n" * 20, "b"] for _ in range(200)], ["a", "b"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        from runlens.sources.ordered import pieces

        assert pieces(spark, d, "\n").rdd.getNumPartitions() > 8
        assert csv_records(spark, d).count() == 201
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_runs_of_files_with_other_columns(spark, ranges):
    """Columns are found by each file's header; order is by time, name and row."""
    d = _dir()
    write_csv(f"{d}/b.csv", [["sceneA", 'x\n"y"', 95, "True", ""], ["sceneB", "", 3.0, "False", "late"]],
              ["scene_id", "output_content", S.DIMENSIONS[0][1], "success", "error"])
    write_csv(f"{d}/a.csv", [["group1", "sceneC", 0.3, 12]], ["group", "scene_id", "temperature", "input_tokens"])
    for name, t in [("b.csv", 1000), ("a.csv", 2000)]:
        os.utime(f"{d}/{name}", (t, t))
    rows = SRC.read_runs_csv(spark, d).orderBy("run_seq").collect()
    assert [r.run_seq for r in rows] == [0, 1, 1 << 33]
    assert [r.scene_id for r in rows] == ["sceneA", "sceneB", "sceneC"]
    assert rows[0].output_content == 'x\n"y"' and rows[0][S.DIM_COLS[0]] == 95.0 and rows[0].success is True and rows[0].error is None
    assert rows[1].output_content is None and rows[1].error == "late"
    assert rows[2].group_id == "group1" and rows[2].temperature == 0.3 and rows[2].input_tokens == 12
    assert SRC.read_runs_csv(spark, d, with_file_order=False).where("run_seq is not null").count() == 0


def test_exported_runs_come_back(spark, ranges):
    rng = random.Random(3)
    rows = [(i * 7, f"scene{i % 3}", field(rng) or None, i % 2 == 0, i / 4) for i in range(90)]
    df = spark.createDataFrame(rows, "run_seq bigint, scene_id string, output_content string, success boolean, elapsed_time double").repartition(3)
    path = f"{_dir()}/csv"
    W.export_csv(df, path)
    back = SRC.read_runs_csv(spark, path).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_too_many_columns(spark):
    d = _dir()
    write_csv(f"{d}/x.csv", [list(range(140))], [f"c{i}" for i in range(140)])
    with pytest.raises(Exception, match="at most"):
        SRC.read_runs_csv(spark, d).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_progress_of_any_size(spark, ranges, indent):
    rng = random.Random(5)
    keys = ["a", "", 'q"uote', "back\\", "\\\\", '\\"', "com,ma", "[x]", "é😀", "new\nline", "main_sceneA_scheme1_qwen14b_P1_0"]
    keys += [f"sens_sceneB_{i}_" + "x" * rng.randint(0, 30) for i in range(80)]
    d = _dir()
    with open(f"{d}/progress.json", "w", encoding="utf-8") as f:
        json.dump({"note": "none", "completed": keys, "other": {"a": "b"}, "n": 3, "last": "z"}, f, ensure_ascii=False, indent=indent)
    with open(f"{d}/empty.json", "w") as f:
        json.dump({"completed": []}, f)
    assert sorted(r.run_key for r in SRC.read_progress(spark, d).collect()) == sorted(keys)


def test_several_documents_in_a_file(spark, ranges):
    d = _dir()
    with open(f"{d}/p.json", "w") as f:
        for i in range(20):
            f.write(json.dumps({"completed": [f"k{i}.{j}" for j in range(i)]}) + "\n")
    assert sorted(r.text for r in json_strings(spark, d).collect()) == sorted(f"k{i}.{j}" for i in range(20) for j in range(i))


@pytest.mark.parametrize("read", [csv_records, json_strings])
def test_pieces_stay_where_they_are_read(spark, read):
    """No piece of a file is shuffled or sorted: a task's memory doesn't grow with a range."""
    d = _dir()
    write_csv(f"{d}/x.csv", [["a\nb", "c"]], ["a", "b"])
    formatted = read(spark, d)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"^\(\d+\) (\w+).*\n(?:Left keys.*\n|Right keys.*\n|Output.*\n)*Input \[\d+\]: (.*)$", formatted, re.M)
    moved = [(node, columns) for node, columns in nodes if node in ("Exchange", "Sort", "Window", "SortMergeJoin")]
    assert moved and not [x for x in moved if re.search(r"\b(piece|value)#", x[1])]


@pytest.mark.parametrize("rows", [1, 2, 7])
def test_texts_over_several_batches(spark, rows):
    """Records and strings that span batches, with ranges within and beyond them."""
    rng = random.Random(rows)
    d, p = _dir(), _dir()
    values = [[field(rng), field(rng)] for _ in range(60)]
    write_csv(f"{d}/x.csv", values, ["a", "b"])
    keys = [field(rng) for _ in range(60)]
    with open(f"{p}/progress.json", "w", encoding="utf-8") as f:
        json.dump({"completed": keys, "other": {"a": "b"}}, f, indent=1)
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": None}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for size in (90, 1 << 27):
            for k, v in names.items():
                spark.conf.set(k, v or str(size))
            got = [tuple(r.r) for r in csv_records(spark, d).where("row > 0").orderBy("row").select(F.from_csv("text", "a string, b string", {"escape": '"'}).alias("r")).collect()]
            whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{d}/x.csv")
            assert len(got) == 60 and got == [tuple(r) for r in whole.collect()]
            assert sorted(r.run_key for r in SRC.read_progress(spark, p).collect()) == sorted(keys)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_of_one_second(spark):
    """Any number of files may bear one time; run_seq follows (time, path)."""
    d = _dir()
    names = [f"run{i:04d}.json" for i in range(300)]
    for i, name in enumerate(names):
        with open(f"{d}/{name}", "w") as f:
            json.dump({"scene_id": f"s{i}", "success": True}, f, indent=2)
        os.utime(f"{d}/{name}", (1000 + i // 200, 1000 + i // 200))
    rows = SRC.read_raw_outputs(spark, d).select("file_name", "run_seq").collect()
    assert {r.file_name: r.run_seq for r in rows} == {n: (1000 + i // 200 << 32) + i % 200 for i, n in enumerate(names)}


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("k")).repartition(7)
    got = {(r.k, r.x): r.place for r in global_rank(df, ["k", "x"], "place").collect()}
    assert got == {kx: i for i, kx in enumerate(sorted(got))} and len(got) == 5000
    assert global_rank(df.limit(0), ["x"]).count() == 0


def test_merged_raw_documents(spark):
    """Second and third writes of overlapping names equal one write of all; untouched scenes are not rewritten."""
    def runs(rows):
        df = spark.createDataFrame(rows, "run_seq bigint, scene_id string, scheme string, param_set string, model string, repeat_idx int, output_content string")
        return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.RUNS.fields if f.name not in df.columns])

    first = [(i, "s1" if i % 2 else "s2", "a b", "P1", "m-1", i % 5, f"v{i}") for i in range(20)] + [(90, None, "x", None, "m", 1, "n"), (91, "s1", "x", None, "m", 1, "n")]
    second = [(i, "s1", "a b", "P1", "m-1", i % 5, f"w{i}") for i in range(30, 36)] + [(5, "s1", "a b", "P1", "m-1", 0, "older"), (92, "s1", "x", "P1", "m", 1, "o")]
    path, whole = f"{_dir()}/raw", f"{_dir()}/raw"
    W.merge_raw_outputs(runs(first), path)
    files = {f for _, _, fs in os.walk(f"{path}/scene_id=s2") for f in fs}
    W.merge_raw_outputs(runs(second), path)
    assert {f for _, _, fs in os.walk(f"{path}/scene_id=s2") for f in fs} == files
    W.write_raw_outputs(runs(first + second), whole)
    read = lambda p: sorted(map(str, spark.read.schema(W.RAW_DOCUMENTS).json(p).collect()))
    assert read(path) == read(whole) and len(read(path)) > 12
    names = {r.file_key for r in spark.read.schema(W.RAW_DOCUMENTS).json(path).collect()}
    assert {"s1_x_None_m_1", "s1_x_P1_m_1", "None_x_None_m_1"} <= names  # a missing part is part of the name
