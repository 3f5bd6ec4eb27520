"""Configuration files -> dimension tables; prompt attachment."""

import os
import tempfile

from runlens.operators.assemble import with_prompts
from runlens.sources import config as C

CONFIG = """
models:
  m_a: {name: "Model-A", max_tokens: 100, timeout: 10}
  m_b: {name: "Model-B", max_tokens: 200, timeout: 20}
parameter_sets:
  P1: {temperature: 0, top_p: 1.0}
  P2: {temperature: 0.7, top_p: 0.9}
evaluation_dimensions:
  - {name: "格式合规率", weight: 0.15}
  - {name: "无幻觉率"}
"""

SCENE = """
scene_name: "Scene X"
scene_id: "sceneX"
scheme1:
  name: "Scheme one"
  system: ""
  user: |
    Do the thing.
scheme2:
  name: "Scheme two"
  system: "Be careful."
  user: "Do it well."
evaluation_prompt: "Score {output_content} for {input_prompt} {{json}}"
"""


def test_config_to_dimensions(spark):
    d = tempfile.mkdtemp(prefix="runlens-cfg-")
    p = os.path.join(d, "settings.yaml")
    with open(p, "w", encoding="utf-8") as f:
        f.write(CONFIG)
    cfg = C.load_yaml(p)
    m = {r.model_key: (r.model, r.timeout) for r in C.models_from_config(spark, cfg).collect()}
    assert m == {"m_a": ("Model-A", 10), "m_b": ("Model-B", 20)}
    ps = {r.param_set: (r.temperature, r.top_p) for r in C.param_sets_from_config(spark, cfg).collect()}
    assert ps == {"P1": (0.0, 1.0), "P2": (0.7, 0.9)}
    dims = C.dimensions_from_config(spark, cfg).orderBy("dim_order").collect()
    assert [(x.dimension, x.weight) for x in dims] == [("format_compliance", 0.15), ("no_hallucination", None)]


def test_scene_files_and_prompts(spark):
    d = tempfile.mkdtemp(prefix="runlens-scene-")
    p = os.path.join(d, "sceneX_file.yaml")
    with open(p, "w", encoding="utf-8") as f:
        f.write(SCENE)
    scenes, prompts = C.scenes_from_files(spark, [p])
    assert scenes.first().scene_id == "sceneX"
    assert C.scenes_from_files(spark, [p], key_by_file=True)[0].first().scene_id == "sceneX_file"
    assert prompts.count() == 2
    runs = spark.createDataFrame([(1, "sceneX", "scheme1"), (2, "sceneX", "scheme2"), (3, "sceneY", "scheme1")],
                                 "run_seq long, scene_id string, scheme_key string")
    r = {x.run_seq: x for x in with_prompts(runs, prompts).collect()}
    assert r[1].input_prompt == "Do the thing." and [m.role for m in r[1].messages] == ["user"]
    assert r[2].input_prompt == "Be careful.\nDo it well." and len(r[2].messages) == 2
    assert r[3].input_prompt == ""


def test_render_scene_template_from_yaml(spark):
    from pyspark.sql import functions as F

    from runlens.functions.judge import judge_prompt

    d = tempfile.mkdtemp(prefix="runlens-scene-")
    p = os.path.join(d, "sceneX.yaml")
    template = ("In: {input_prompt} Out: {output_content} J={json_valid}({json_valid_detail}) "
                "S={structure_valid}({structure_detail}) F={field_names_valid}({field_names_detail}) "
                "T={data_types_valid}({data_types_detail}) reply {{'score': n}}")
    with open(p, "w", encoding="utf-8") as f:
        f.write(SCENE.replace('evaluation_prompt: "Score {output_content} for {input_prompt} {{json}}"',
                              f'evaluation_prompt: "{template}"'))
    _, prompts = C.scenes_from_files(spark, [p])
    row = prompts.where("scheme_key = 'scheme2'").first()
    checks = {"json_valid": F.lit(True), "json_valid_detail": F.lit("ok"), "structure_valid": F.lit(False),
              "structure_detail": F.lit("s"), "field_names_valid": F.lit(False), "field_names_detail": F.lit("f"),
              "data_types_valid": F.lit(True), "data_types_detail": F.lit("t")}
    out = spark.range(1).select(judge_prompt(row.evaluation_prompt, F.lit("P"), F.lit("{x}"), checks)).first()[0]
    expected = row.evaluation_prompt.format(
        input_prompt="P", output_content="{x}", json_valid=True, json_valid_detail="ok", structure_valid=False,
        structure_detail="s", field_names_valid=False, field_names_detail="f", data_types_valid=True,
        data_types_detail="t")
    assert out == expected and "{'score': n}" in out


def test_scenes_from_folder(spark):
    d = tempfile.mkdtemp(prefix="runlens-scenes-")
    for name in ("sA", "sB"):
        with open(os.path.join(d, f"{name}.yaml"), "w", encoding="utf-8") as f:
            f.write(SCENE)
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not a scene")
    scenes, prompts = C.scenes_from_folder(spark, d)
    assert sorted(r.scene_id for r in scenes.collect()) == ["sA", "sB"]
    assert prompts.count() == 4
