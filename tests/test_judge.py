"""Judge replies, prompt rendering, prompt text and message lists."""

import pytest
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.judge import DEFAULT_JUDGE_TEMPLATE, judge_prompt, parse_judge_replies, render_template
from runlens.functions.text import chat_messages, prompt_text
from runlens.operators.assemble import assemble_runs

KEYS = [k for _, k, _ in S.DIMENSIONS]


def _reply(values, wrap=None):
    body = "{" + ", ".join(f'"{k}": {v}' for k, v in zip(KEYS, values) if v is not None) + "}"
    return wrap.format(body) if wrap else body


CASES = [
    (_reply([95, 90, 85, 80, 75, 70]), True, [95.0, 90.0, 85.0, 80.0, 75.0, 70.0]),
    (_reply(['"95"', '"90.5"', 85, 80, 75, 70]), True, [95.0, 90.5, 85.0, 80.0, 75.0, 70.0]),
    (_reply(['"95分"', 90, 85, 80, 75, 70]), True, [0.0, 90.0, 85.0, 80.0, 75.0, 70.0]),
    (_reply([95, 90, 85, 80, 75, None]), True, [95.0, 90.0, 85.0, 80.0, 75.0, 0.0]),
    (_reply([95, 90, 85, 80, 75, 70], "Here you go:\n{}\nThanks."), True, [95.0, 90.0, 85.0, 80.0, 75.0, 70.0]),
    ("I cannot score this.", False, [0.0] * 6),
    ("{broken", False, [0.0] * 6),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse_reply(spark, i):
    text, ok, scores = CASES[i]
    r = parse_judge_replies(spark.createDataFrame([(text,)], "reply string"), "reply", "j").first().j
    assert r.judge_ok == ok
    assert [r[c] for c in S.DIM_COLS] == scores


def test_render_keeps_placeholders_inside_values(spark):
    df = spark.createDataFrame([("out {json_valid} here", True)], "o string, b boolean")
    r = df.select(render_template("A {x} B {y} {{z}}", {"x": F.col("o"), "y": F.lit("Y")}).alias("t")).first().t
    assert r == "A out {json_valid} here B Y {z}"
    checks = {"json_valid": F.col("b"), "json_valid_detail": F.lit("d"), "structure_valid": F.lit(False),
              "structure_detail": F.lit("s"), "field_names_valid": F.lit(True), "field_names_detail": F.lit("f"),
              "data_types_valid": F.lit(None).cast("boolean"), "data_types_detail": F.lit("t")}
    t = df.select(judge_prompt(DEFAULT_JUDGE_TEMPLATE, F.lit("P"), F.col("o"), checks).alias("t")).first().t
    expected = DEFAULT_JUDGE_TEMPLATE.format(
        input_prompt="P", output_content="out {json_valid} here", json_valid=True, json_valid_detail="d",
        structure_valid=False, structure_detail="s", field_names_valid=True, field_names_detail="f",
        data_types_valid=None, data_types_detail="t")
    assert t == expected


def test_prompt_text_and_messages(spark):
    df = spark.createDataFrame([("", "u1"), ("sys", "u2"), (None, "u3")], "s string, u string")
    r = df.select(prompt_text("s", "u").alias("p"), chat_messages("s", "u").alias("m")).collect()
    assert [x.p for x in r] == ["u1", "sys\nu2", "u3"]
    assert [[m.role for m in x.m] for x in r] == [["user"], ["system", "user"], ["user"]]


def test_assemble_failed_and_unscored(spark):
    outs = spark.createDataFrame([(1, True, '{"test_items":[]}'), (2, False, ""), (3, True, "x")],
                                 "run_seq long, success boolean, output_content string")
    judg = spark.createDataFrame([(1, _reply([95, 90, 85, 80, 75, 70]))], "run_seq long, reply string")
    r = {x.run_seq: x for x in assemble_runs(outs, judg).collect()}
    assert r[1].format_compliance == 95.0 and r[1].json_valid is True
    assert r[2].success is False and r[2].no_hallucination == 0.0 and r[2].json_valid is None
    assert r[3].success is True and r[3].judge_ok is False and r[3].format_compliance == 0.0


def test_scores_that_are_no_finite_number(spark):
    key = S.DIMENSIONS[0][1]
    texts = {'{"%s": null}': (True, None, True), '{"%s": "NaN"}': (True, 0.0, False), '{"%s": "Infinity"}': (True, 0.0, False),
             '{"%s": [1]}': (True, 0.0, False), '{"%s": "95分"}': (True, 0.0, False), '{"other": 1}': (True, 0.0, True), '{"%s": 1e2}': (True, 100.0, True),
             "95": (False, 0.0, False), "[1, 2]": (False, 0.0, False), '"ok"': (False, 0.0, False), "null": (False, 0.0, False), '{"%s": 1} {': (False, 0.0, False)}
    df = spark.createDataFrame([(i, t % key if "%s" in t else t) for i, t in enumerate(texts)], "i int, reply string")
    got = {r.i: (r.j.judge_ok, r.j[S.DIMENSIONS[0][0]], r.j.scores_readable) for r in parse_judge_replies(df, "reply", "j").collect()}
    want = list(texts.values())
    assert {i: g for i, g in got.items() if i != len(want) - 1} == {i: w for i, w in enumerate(want) if i != len(want) - 1}


def test_failed_rows_get_their_defaults(spark):
    from runlens.operators.assemble import failed_row_defaults

    df = spark.createDataFrame([(1, False, 0.7, 1.0, None, None, 3.0), (2, True, 0.7, 1.0, 5, 1.5, 3.0)],
                               "run_seq long, success boolean, temperature double, top_p double, input_tokens long, elapsed_time double, item_validity double")
    a = failed_row_defaults(df).orderBy("run_seq").collect()
    assert tuple(a[0])[2:] == (None, None, 0, 0.0, 0.0) and tuple(a[1])[2:] == (0.7, 1.0, 5, 1.5, 3.0)
    o = failed_row_defaults(df, orthogonal=True).orderBy("run_seq").collect()
    assert tuple(o[0])[2:] == (0.7, None, None, None, 0.0)
