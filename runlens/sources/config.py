"""Configuration -> small dimension DataFrames (models, parameter sets,
evaluation dimensions, scenes, schemes).

These tables have the size of the configuration.  Short ones are literal maps
in expressions; longer ones are joined, and Spark broadcasts them where their
size is below its threshold.  No size is refused.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas as S

# A literal map of more entries than this is slower per row than a join.
MAX_LITERAL_ROWS = 64


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def models(spark: SparkSession, orthogonal: bool = False) -> DataFrame:
    rows = S.MODELS_ORTHOGONAL if orthogonal else S.MODELS
    return _frame(spark, [list(r) for r in rows], S.MODELS_SCHEMA)


def param_sets(spark: SparkSession, orthogonal: bool = False) -> DataFrame:
    rows = S.PARAM_SETS_ORTHOGONAL if orthogonal else S.PARAM_SETS
    return _frame(spark, [list(r) for r in rows], S.PARAM_SETS_SCHEMA)


def dimensions(spark: SparkSession) -> DataFrame:
    rows = [[c, k, w, i + 1] for i, (c, k, w) in enumerate(S.DIMENSIONS)]
    return _frame(spark, rows, S.DIMENSIONS_SCHEMA)


def scenes(spark: SparkSession) -> DataFrame:
    return _frame(spark, [list(r) for r in S.SCENES], S.SCENES_SCHEMA)


def schemes(spark: SparkSession) -> DataFrame:
    rows = [[k, n, i + 1] for i, (k, n) in enumerate(S.SCHEMES)]
    return _frame(spark, rows, S.SCHEMES_SCHEMA)


# ---------------------------------------------------------------------------
# YAML configuration files (driver-side; the files are a few KB).

def load_yaml(path: str) -> dict:
    import yaml  # optional dependency, only for reading config files

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def models_from_config(spark: SparkSession, cfg: dict) -> DataFrame:
    """``models:`` mapping -> (model_key, model, max_tokens, timeout)."""
    rows = [[k, v.get("name"), v.get("max_tokens"), v.get("timeout")]
            for k, v in (cfg.get("models") or {}).items()]
    return _frame(spark, rows, S.MODELS_SCHEMA)


def param_sets_from_config(spark: SparkSession, cfg: dict) -> DataFrame:
    """``parameter_sets:`` mapping -> (param_set, temperature, top_p)."""
    rows = [[k, float(v["temperature"]), float(v.get("top_p", 1.0))]
            for k, v in (cfg.get("parameter_sets") or {}).items()]
    return _frame(spark, rows, S.PARAM_SETS_SCHEMA)


def dimensions_from_config(spark: SparkSession, cfg: dict) -> DataFrame:
    """``evaluation_dimensions:`` list -> (dimension, judge_key, weight, order).

    The judge key is the configured name; the column name is ours when the
    key is one of the six known dimensions.  A missing weight is NULL.
    """
    by_key = {k: c for c, k, _ in S.DIMENSIONS}
    rows = []
    for i, d in enumerate(cfg.get("evaluation_dimensions") or []):
        w = d.get("weight")
        rows.append([by_key.get(d["name"], d["name"]), d["name"],
                     None if w is None else float(w), i + 1])
    return _frame(spark, rows, S.DIMENSIONS_SCHEMA)


def scenes_from_files(spark: SparkSession, paths: list[str], key_by_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scene YAML files -> (scenes, scheme_prompts).

    ``key_by_file`` keys a scene by its file name (the orthogonal script's
    rule) instead of the ``scene_id`` field inside (the exploratory rule).
    ``scheme_prompts`` has one row per (scene, scheme) with the prompt parts
    and the judge template of the scene.
    """
    scene_rows, scheme_rows = [], []
    for p in paths:
        doc = load_yaml(p)
        sid = os.path.basename(p)[:-5] if key_by_file else doc.get("scene_id")
        scene_rows.append([sid, doc.get("scene_name")])
        for key, val in doc.items():
            if isinstance(val, dict) and "user" in val:
                scheme_rows.append([sid, key, val.get("name"), val.get("system") or "",
                                    val.get("user") or "", doc.get("evaluation_prompt")])
    sc = _frame(spark, scene_rows, S.SCENES_SCHEMA)
    sp = _frame(spark, scheme_rows,
                "scene_id string, scheme_key string, scheme string, system string, "
                "user string, evaluation_prompt string")
    return sc, sp


def scenes_from_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """S7 (orthogonal rule): every ``.yaml`` file of a folder, keyed by file name."""
    paths = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".yaml"))
    return scenes_from_files(spark, paths, key_by_file=True)


# ---------------------------------------------------------------------------
# J4-J6 lookups.  A dimension held as driver-side configuration (a few rows)
# becomes a literal map inside the expression: no exchange, no extra job.
# A dimension that is a DataFrame (e.g. read from files) is joined.

def lookup(key, pairs) -> "F.Column":
    """Value for ``key`` in a configuration mapping (NULL when absent).

    A map in the expression: meant for mappings of up to ``MAX_LITERAL_ROWS``
    entries (``with_lookup`` joins longer ones)."""
    items = list(pairs.items()) if isinstance(pairs, dict) else list(pairs)
    m = F.create_map(*[F.lit(x) for kv in items for x in kv])
    k = F.col(key) if isinstance(key, str) else key
    return m[k]


def join_dimension(df: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Join a dimension table; Spark broadcasts it below its size threshold."""
    return df.join(dim, on, how)


def with_lookup(df: DataFrame, key: str, pairs, name: str) -> DataFrame:
    """``df`` with ``name``: the value for column ``key`` in a mapping of any length."""
    items = list(pairs.items()) if isinstance(pairs, dict) else list(pairs)
    if len(items) <= MAX_LITERAL_ROWS:
        return df.withColumn(name, lookup(key, items))
    kind = "double" if isinstance(items[0][1], float) else "string"
    dim = df.sparkSession.createDataFrame([list(kv) for kv in dict(items).items()], f"{key} string, {name} {kind}")
    return df.join(dim, key, "left")


def enrich_from_config(base: DataFrame, orthogonal: bool = False) -> DataFrame:
    """J4-J6 for run rows keyed by scene_id / scheme_key / model_key /
    param_set: scene name, scheme name, model name, temperature, top_p."""
    models_ = S.MODELS_ORTHOGONAL if orthogonal else S.MODELS
    psets = S.PARAM_SETS_ORTHOGONAL if orthogonal else S.PARAM_SETS
    out = base
    for key, pairs, name in [
            ("scene_id", S.SCENES, "scene_name"), ("scheme_key", S.SCHEMES, "scheme"),
            ("model_key", [(k, n) for k, n, _, _ in models_], "model"),
            ("param_set", [(p, float(t)) for p, t, _ in psets], "temperature"),
            ("param_set", [(p, float(tp)) for p, _, tp in psets], "top_p")]:
        out = with_lookup(out, key, pairs, name)
    return out
