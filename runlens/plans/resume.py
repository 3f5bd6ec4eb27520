"""Resume: which planned runs are still to do.

The completed-key set is *derived from the run table* (so it cannot drift
from the results).  The pending runs are ``plan LEFT ANTI JOIN completed``,
after the completed keys are reduced to those that occur in the plan.  The
joins carry no hints: Spark broadcasts the plan's keys where their size is
below its threshold and shuffles both sides by key otherwise.

A key is NULL when one of its parts is: such a row completes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.jsontext import let
from runlens.operators.ranking import seq_rank
from runlens.plans.design import joined_key


def with_design(runs: DataFrame) -> DataFrame:
    """``runs`` with the design each run belongs to (``main`` or ``sens``).

    A recorded ``design`` is kept.  For rows without one, a parameter set
    other than P1 can only come from the sensitivity design; P1 runs of equal
    scene, scheme, model and repeat number are main first, then sensitivity,
    as the experiment runs them.
    """
    recorded = F.col("design") if "design" in runs.columns else F.lit(None).cast("string")
    open_rows = runs.withColumn("__design", recorded)
    part = ["scene_id", "scheme_key", "model_key", "param_set", "repeat_idx", "__design"]
    ranked = seq_rank(open_rows, part, "run_seq", "__nth")
    guess = F.when(F.col("param_set") != "P1", "sens").when(F.col("__nth") == 1, "main").otherwise("sens")
    return ranked.withColumn("design", F.coalesce("__design", guess)).drop("__design", "__nth")


def exploratory_key(runs: DataFrame) -> Column:
    """K1 for a run row of the exploratory experiment (repeat is 0-based in
    keys).  ``runs`` has a ``design`` column: see ``with_design``."""
    return joined_key("design", "scene_id", "scheme_key", "model_key", "param_set",
                      (F.col("repeat_idx") - 1).cast("string"))


def orthogonal_key(group: str = "group_id", model_name="model", scheme: str = "scheme_key") -> Column:
    """K1/K2: ``<group>_<scene>_<scheme>_T<temperature>_<model name>_<repeat>``.

    The canonical key uses the scheme *key*.  ``scheme="scheme"`` spells it
    as raw-output file names do (scheme name).
    """
    return joined_key(group, "scene_id", scheme, F.concat(F.lit("T"), F.col("temperature").cast("string")),
                      model_name, F.col("repeat_idx").cast("string"))


def file_name_key(file_name: Column) -> Column:
    """K4: key of a raw-output file name -- strip ``.json``; names with fewer
    than six ``_``-separated parts give NULL."""
    k = F.regexp_replace(file_name, r"\.json$", "")
    return F.when(file_name.endswith(".json") & (F.size(F.split(k, "_")) >= 6), k)


def canonical_key_from_file_name(file_name: Column, schemes=None, models=None) -> Column:
    """K4 -> K1: the plan's key of a raw-output file name.

    The file spells the scheme by name and the model with ``_`` for ``/``;
    the key has the scheme key and the model name.  ``schemes``: (key, name)
    pairs, ``models``: model names; by default the configuration's.  A name
    that is no run's file gives NULL.
    """
    from runlens.schemas import MODELS_ORTHOGONAL, SCHEMES
    from runlens.sources.config import lookup

    schemes = SCHEMES if schemes is None else schemes
    models = [m[1] for m in MODELS_ORTHOGONAL] if models is None else models
    # one pass of one pattern marks the borders of the parts
    parts = F.split(F.regexp_replace(file_name, r"^([^_]+)_([^_]+)_(.+)_(T[0-9.]+)_(.+)_([0-9]+)\.json$", "\x01".join(f"${i}" for i in range(1, 7))), "\x01")

    def key(part: Column) -> Column:
        scheme = F.coalesce(lookup(part[2], {n: k for k, n in schemes}), part[2])
        model = F.coalesce(lookup(part[4], {n.replace("/", "_"): n for n in models}), part[4])
        return F.when(F.size(part) == 6, joined_key(part[0], part[1], scheme, part[3], model, part[5]))

    return let(parts, key)


def normalise_file_part(c: Column) -> Column:
    """T13 (exploratory file names): spaces and ``-`` become ``_``."""
    return F.translate(c, " -", "__")


def orthogonal_model_part(c: Column) -> Column:
    """T13 (orthogonal file names): only ``/`` in the model name becomes ``_``;
    dashes stay (``Qwen/Qwen3-14B`` -> ``Qwen_Qwen3-14B``)."""
    return F.translate(c, "/", "_")


def completed_keys(runs: DataFrame, key: Column, include_failed: bool = False) -> DataFrame:
    """The completed-key set (one column ``run_key``).

    By default a failed run is *not* complete -- it is retried on resume.
    """
    src = runs if include_failed else runs.where(F.col("success"))
    return src.select(key.alias("run_key")).where(F.col("run_key").isNotNull())


def union_keys(*key_sets: DataFrame) -> DataFrame:
    """K3: union of key sets (files, CSV, ...) without duplicates."""
    out = key_sets[0].select("run_key")
    for k in key_sets[1:]:
        out = out.unionByName(k.select("run_key"))
    return out.distinct()


def _reduced(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """The completed keys that occur in the plan, once each."""
    return completed.select("run_key").join(plan.select("run_key"), "run_key", "left_semi").distinct()


def pending(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned runs whose key is not completed, in plan order."""
    return plan.join(_reduced(plan, completed), "run_key", "left_anti").select(*plan.columns).orderBy("design", "position")


def skipped(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned runs that are already completed."""
    return plan.join(_reduced(plan, completed), "run_key", "left_semi").select(*plan.columns).orderBy("design", "position")


def progress(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """A13 + P8: per design -- planned, completed (skipped on resume), pending."""
    done = _reduced(plan, completed).withColumn("__done", F.lit(1))
    j = plan.join(done, "run_key", "left")
    return (j.groupBy("design")
            .agg(F.count(F.lit(1)).alias("planned"),
                 F.count("__done").alias("completed"),
                 (F.count(F.lit(1)) - F.count("__done")).alias("pending"))
            .orderBy("design"))


def with_keys_from_names(runs: DataFrame) -> DataFrame:
    """Add ``scheme_key`` / ``model_key`` from stored scheme and model names
    (score files keep names, keys are what plans use)."""
    from runlens.schemas import MODELS, MODELS_ORTHOGONAL, SCHEMES
    from runlens.sources.config import lookup

    out = runs
    if "scheme_key" not in runs.columns:
        names = {n: k for k, n in SCHEMES}
        out = out.withColumn("scheme_key", F.coalesce(lookup("scheme", names), F.col("scheme")))
    if "model_key" not in runs.columns:
        names = {n: k for k, n, _, _ in MODELS + MODELS_ORTHOGONAL}
        out = out.withColumn("model_key", F.coalesce(lookup("model", names), F.col("model")))
    return out
