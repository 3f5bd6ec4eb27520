"""File round trips: run CSV, raw JSON documents, progress file, listing,
streaming ingest, report folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.operators import reports as R
from runlens.sinks import files as W
from runlens.sources import files as SRC
from runlens.sources import testdata as TD
from runlens.streaming.ingest import start_ingest

from conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="runlens-test-")


def test_csv_with_bom_and_line_breaks(spark):
    d = _tmp()
    p = os.path.join(d, "all_scores.csv")
    header = ["scene_id", "scene_name", "scheme", "model", "param_set", "temperature", "top_p", "repeat_idx",
              "input_tokens", "output_tokens", "elapsed_time", "output_content", "json_valid", "success",
              "error"] + [k for _, k, _ in S.DIMENSIONS]
    rows = [["sceneA", "场景A", "方案1", "Qwen3-14B", "P1", "0.0", "1.0", "1", "322", "1934", "59.57",
             '"{\n  ""test_items"": []\n}"', "True", "True", ""] + ["95"] * 6,
            ["sceneA", "场景A", "方案1", "Qwen3-14B", "P1", "", "", "2", "0", "0", "0", '""', "", "False",
             "timeout"] + ["0"] * 6]
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")
    df = SRC.read_runs_csv(spark, p).orderBy("repeat_idx").collect()
    assert len(df) == 2
    assert df[0].scene_id == "sceneA" and df[0].output_content == '{\n  "test_items": []\n}'
    assert df[0].format_compliance == 95.0 and df[0].json_valid is True and df[0].elapsed_time == 59.57
    assert df[1].temperature is None and df[1].success is False and df[1].error == "timeout"


def test_raw_outputs_round_trip_and_listing(spark):
    d = _tmp()
    runs = R.with_repeat_idx(TD.runs(spark, SF_SMALL)).withColumn("output_content", F.lit("{}")) \
        .withColumn("json_valid", F.lit(True))
    W.write_raw_outputs(runs, os.path.join(d, "raw"))
    back = SRC.read_raw_outputs(spark, os.path.join(d, "raw"), one_document_per_file=False)
    n_keys = runs.select(W.raw_file_key(runs)).distinct().count()
    assert back.count() == n_keys
    assert set(back.columns) >= set(S.RUNS.fieldNames())
    names = SRC.list_raw_output_names(spark, os.path.join(d, "raw"))
    assert names.count() >= 1


def test_progress_file(spark):
    d = _tmp()
    p = os.path.join(d, "progress.json")
    with open(p, "w") as f:
        json.dump({"completed": ["main_sceneA_scheme1_qwen14b_P1_0", "main_sceneA_scheme1_qwen14b_P1_1"]}, f)
    assert sorted(r.run_key for r in SRC.read_progress(spark, p).collect())[1].endswith("_1")


def _write_docs(raw, ids):
    for i in ids:
        doc = {"group": "group1", "scene_id": "sceneA", "scheme": "方案2-结构化上下文", "model": "Qwen/Qwen3-14B",
               "temperature": 0.3, "top_p": 1.0, "repeat_idx": i + 1, "output_content":
               '{"test_items":[{"name":"a","methods":[],"requirements":[],"criteria":[]}]}',
               "success": True, "error": None, **{k: 90 + i for _, k, _ in S.DIMENSIONS}}
        with open(os.path.join(raw, f"group1_sceneA_x_T0.3_Qwen_Qwen3_14B_{i + 1}.json"), "w") as f:
            json.dump(doc, f, ensure_ascii=False, indent=2)


def test_streaming_ingest_exactly_once(spark):
    d = _tmp()
    raw = os.path.join(d, "raw")
    os.makedirs(raw)
    _write_docs(raw, range(5))
    table, ckpt = os.path.join(d, "runs"), os.path.join(d, "ckpt")
    start_ingest(spark, raw, table, ckpt).awaitTermination()
    start_ingest(spark, raw, table, ckpt).awaitTermination()  # nothing new: no duplicates
    t = spark.read.parquet(table)
    assert t.count() == 5
    assert t.where("structure_valid AND field_names_valid").count() == 5
    assert sorted(r.format_compliance for r in t.collect()) == [90.0, 91.0, 92.0, 93.0, 94.0]
    _write_docs(raw, range(5, 8))                               # three runs finish later
    start_ingest(spark, raw, table, ckpt).awaitTermination()     # only the new files are read
    assert spark.read.parquet(table).count() == 8


def test_write_reports(spark):
    d = _tmp()
    written = W.write_reports(TD.runs(spark, SF_SMALL), os.path.join(d, "reports"))
    assert {"summary_statistics", "main_results", "main_summary", "param_sensitivity",
            "overall_statistics", "detail", "scene_sheets"} <= set(written)
    back = spark.read.option("header", True).csv(written["summary_statistics"])
    assert back.count() == TD.runs(spark, SF_SMALL).select("scene_name", "model", "scheme", "param_set") \
        .distinct().count()


def test_read_pretty_printed_raw_documents(spark):
    d = _tmp()
    raw = os.path.join(d, "raw")
    os.makedirs(raw)
    _write_docs(raw, range(4))
    back = SRC.read_raw_outputs(spark, raw)               # one indented object per file
    assert back.count() == 4
    assert back.where("group_id = 'group1' AND format_compliance >= 90").count() == 4
    assert set(r.file_name for r in back.collect()) == {f"group1_sceneA_x_T0.3_Qwen_Qwen3_14B_{i}.json"
                                                        for i in range(1, 5)}


def test_cli_reports_and_pending(spark):
    from runlens.__main__ import main

    d = _tmp()
    runs_path = os.path.join(d, "runs")
    W.write_runs(TD.runs(spark, SF_SMALL), runs_path, mode="overwrite")
    main(["reports", "--runs", runs_path, "--out", os.path.join(d, "rep")])
    assert os.path.isdir(os.path.join(d, "rep", "summary_statistics"))
    main(["pending", "--runs", runs_path, "--out", os.path.join(d, "pending")])
    pend = spark.read.option("header", True).csv(os.path.join(d, "pending"))
    assert 0 < pend.count() < 210


def test_bucketed_inputs_join_without_exchange(spark):
    from runlens.operators.assemble import assemble_runs

    d = _tmp()
    W.write_bucketed(TD.outputs(spark, SF_SMALL), "rl_outputs", os.path.join(d, "outputs"), buckets=8)
    W.write_bucketed(TD.judge_replies(spark, SF_SMALL), "rl_replies", os.path.join(d, "replies"), buckets=8)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the sort-merge path
    try:
        runs = assemble_runs(spark.table("rl_outputs"), spark.table("rl_replies"))
        p = runs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert runs.count() == TD.outputs(spark, SF_SMALL).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.sql("DROP TABLE IF EXISTS rl_outputs")
        spark.sql("DROP TABLE IF EXISTS rl_replies")


def test_raw_outputs_last_write_wins_on_equal_names(spark):
    d = _tmp()
    rows = [(1, "sceneA", "场景A", "方案1-纯提示词", "Qwen3-14B", "P1", 1, 10.0),
            (5, "sceneA", "场景A", "方案1-纯提示词", "Qwen3-14B", "P1", 1, 50.0),   # same file name, later
            (3, "sceneA", "场景A", "方案1-纯提示词", "Qwen3-14B", "P1", 2, 30.0)]
    df = spark.createDataFrame(rows, "run_seq long, scene_id string, scene_name string, scheme string, "
                                     "model string, param_set string, repeat_idx int, format_compliance double")
    for c in S.RUNS.fieldNames():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(S.RUNS[c].dataType))
    W.write_raw_outputs(df, os.path.join(d, "raw"))
    back = {r.repeat_idx: r.format_compliance
            for r in SRC.read_raw_outputs(spark, os.path.join(d, "raw"), one_document_per_file=False).collect()}
    assert back == {1: 50.0, 2: 30.0}


def test_csv_export_round_trip_gives_same_reports(spark):
    d = _tmp()
    runs = TD.runs(spark, SF_SMALL)
    W.export_csv(runs, os.path.join(d, "scores"))
    back = SRC.read_runs_csv(spark, os.path.join(d, "scores"))
    a = [tuple(r) for r in R.summary_statistics(runs).collect()]
    b = [tuple(r) for r in R.summary_statistics(back).collect()]
    assert a == b
    assert back.count() == runs.count()


def test_cli_orthogonal_reports(spark):
    from runlens.__main__ import main

    d = _tmp()
    runs_path = os.path.join(d, "oruns")
    W.write_runs(TD.orthogonal_runs(spark, SF_SMALL), runs_path, mode="overwrite")
    main(["reports", "--orthogonal", "--runs", runs_path, "--out", os.path.join(d, "rep")])
    back = spark.read.option("header", True).csv(os.path.join(d, "rep", "group_statistics"))
    assert back.count() == 8
    assert os.path.isdir(os.path.join(d, "rep", "interaction"))


def test_cli_orthogonal_pending(spark):
    from runlens.__main__ import main

    d = _tmp()
    runs_path = os.path.join(d, "oruns")
    W.write_runs(TD.orthogonal_runs(spark, SF_SMALL), runs_path, mode="overwrite")
    main(["pending", "--orthogonal", "--runs", runs_path, "--out", os.path.join(d, "pending")])
    pend = spark.read.option("header", True).csv(os.path.join(d, "pending"))
    assert 0 < pend.count() < 840
    assert pend.where("design NOT IN ('group1', 'group2', 'group3', 'group4')").count() == 0
