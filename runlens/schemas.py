"""Typed schemas and the fixed values of the experiment design.

Schemas are explicit ``StructType``s: the run table is never schema-inferred,
and a column a run does not carry is NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the experiment's configuration).
#
# Evaluation dimensions in report order: our column name, the key the judge
# model uses in its JSON reply, and the composite weight.
DIMENSIONS = [
    ("format_compliance", "格式合规率", 0.15),
    ("entry_correspondence", "条目对应率", 0.10),
    ("requirement_coverage", "需求覆盖率", 0.15),
    ("item_validity", "测试项有效性", 0.25),
    ("description_quality", "输出描述质量", 0.20),
    ("no_hallucination", "无幻觉率", 0.15),
]
# Key of the optional free-text note a judge reply may carry.
SCORE_NOTE_KEY = "评分说明"
# Suffix of the per-dimension explanation fields in a judge reply.
EXPLANATION_SUFFIX = "说明"

# Manual (human-written) baseline of the best-configuration comparison, in
# dimension order, and the composite the publication prints for it.
MANUAL_BASELINE = [100.0, 100.0, 96.5, 93.0, 92.5, 100.0]
MANUAL_BASELINE_COMPOSITE = 97.0

# Generator models: key, stored name, max tokens, timeout (s).
MODELS = [
    ("qwen14b", "Qwen3-14B", 4096, 120),
    ("qwen32b", "Qwen3-32B", 4096, 180),
]
# Names the orthogonal experiment stores for the same keys.
MODELS_ORTHOGONAL = [
    ("qwen14b", "Qwen/Qwen3-14B", 4096, 180),
    ("qwen32b", "Qwen/Qwen3-32B", 4096, 180),
]

# Exploratory parameter sets: name, temperature, top_p.
PARAM_SETS = [
    ("P1", 0.0, 1.0), ("P2", 0.1, 1.0), ("P3", 0.3, 1.0), ("P4", 0.5, 1.0),
    ("P5", 0.7, 1.0), ("P6", 1.0, 1.0), ("P7", 1.2, 1.0), ("P8", 1.0, 0.8),
    ("P9", 1.0, 0.9), ("P10", 0.5, 0.9), ("P11", 0.7, 0.9), ("P12", 1.2, 0.9),
]
# Orthogonal parameter sets.
PARAM_SETS_ORTHOGONAL = [
    ("T0", 0.0, 1.0), ("T1", 0.3, 1.0), ("T2", 0.6, 1.0), ("T3", 0.9, 1.0),
    ("T4", 1.2, 1.0),
]

# Scenes: id, name.
SCENES = [
    ("sceneA", "场景A-测控指令解码"),
    ("sceneB", "场景B-数据采集接口"),
    ("sceneC", "场景C-通信协议处理"),
]
# Prompt schemes: key, stored name (the same in every scene).
SCHEMES = [
    ("scheme1", "方案1-纯提示词"),
    ("scheme2", "方案2-结构化上下文"),
    ("scheme3", "方案3-增强型上下文"),
]
# Exploratory design.
REPEAT_TIMES = 5
MAIN_DESIGN = {"scenes": ["sceneA", "sceneB", "sceneC"],
               "schemes": ["scheme1", "scheme2", "scheme3"],
               "models": ["qwen14b", "qwen32b"], "param_set": "P1"}
SENSITIVITY_DESIGN = {"scene": "sceneA", "schemes": ["scheme1"],
                      "models": ["qwen14b", "qwen32b"],
                      "param_sets": [p[0] for p in PARAM_SETS]}

# Orthogonal design (fixed scene sceneA, top_p 1.0, 30 repeats).
ORTHOGONAL_REPEATS = 30
ORTHOGONAL_SCENE = "sceneA"
GROUP1 = {"models": ["qwen14b", "qwen32b"], "scheme": "scheme2",
          "temperatures": [0.0, 0.3, 0.6, 0.9, 1.2]}
GROUP2 = {"models": ["qwen14b", "qwen32b"],
          "schemes": ["scheme1", "scheme2", "scheme3"], "temperature": 0.3}
GROUP3 = {"models": ["qwen14b", "qwen32b"],
          "schemes": ["scheme1", "scheme2", "scheme3"], "temperature": 0.3}
GROUP4 = [("qwen14b", "scheme1", 0.0), ("qwen14b", "scheme2", 0.6),
          ("qwen14b", "scheme3", 1.2), ("qwen32b", "scheme1", 0.6),
          ("qwen32b", "scheme2", 1.2), ("qwen32b", "scheme3", 0.0)]
# End of fixed values.
# ---------------------------------------------------------------------------

DIM_COLS = [d[0] for d in DIMENSIONS]
DIM_KEYS = {d[0]: d[1] for d in DIMENSIONS}
DIM_WEIGHTS = {d[0]: d[2] for d in DIMENSIONS}

# One run of the experiment (exploratory and orthogonal share it; a column a
# script does not write is NULL).  ``run_seq`` is arrival order.
RUNS = T.StructType([
    T.StructField("run_seq", T.LongType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("design", T.StringType()),
    T.StructField("scene_id", T.StringType()),
    T.StructField("scene_name", T.StringType()),
    T.StructField("scheme", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("param_set", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("repeat_idx", T.IntegerType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("elapsed_time", T.DoubleType()),
    T.StructField("output_content", T.StringType()),
    T.StructField("json_valid", T.BooleanType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in DIM_COLS],
    T.StructField("score_note", T.StringType()),
])

# The same record as the raw per-run JSON files and the score CSV spell it.
RAW_RECORD = T.StructType([
    T.StructField("run_seq", T.LongType()),
    T.StructField("group", T.StringType()),
    T.StructField("design", T.StringType()),
    T.StructField("scene_id", T.StringType()),
    T.StructField("scene_name", T.StringType()),
    T.StructField("scheme", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("param_set", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("repeat_idx", T.IntegerType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("elapsed_time", T.DoubleType()),
    T.StructField("output_content", T.StringType()),
    T.StructField("json_valid", T.BooleanType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    *[T.StructField(d[1], T.DoubleType()) for d in DIMENSIONS],
    T.StructField(SCORE_NOTE_KEY, T.StringType()),
])

PLAN = T.StructType([
    T.StructField("design", T.StringType()),
    T.StructField("scene_id", T.StringType()),
    T.StructField("scheme_key", T.StringType()),
    T.StructField("model_key", T.StringType()),
    T.StructField("param_set", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("repeat_idx", T.IntegerType()),
    T.StructField("position", T.LongType()),
    T.StructField("run_key", T.StringType()),
])

MODELS_SCHEMA = "model_key string, model string, max_tokens int, timeout int"
PARAM_SETS_SCHEMA = "param_set string, temperature double, top_p double"
DIMENSIONS_SCHEMA = "dimension string, judge_key string, weight double, dim_order int"
SCENES_SCHEMA = "scene_id string, scene_name string"
SCHEMES_SCHEMA = "scheme_key string, scheme string, scheme_order int"
