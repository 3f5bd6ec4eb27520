"""Experiment design grids (the "plan" relation).

A design is the Cartesian product of a few configuration lists.  Its size is
the product of the list lengths, known on the driver, so a grid is generated
as ``spark.range(size)`` and each factor is decoded from the row index by
mixed-radix arithmetic -- no cross join, no driver-side row list, and the
plan position (the "[current/total]" counter) is plain arithmetic instead of
a global window.

Orders follow the experiment's loops (outermost first):
main: model, scene, scheme, repeat; sensitivity: model, scheme, parameter
set, repeat; group1: model, temperature, repeat; groups 2-3: model, scheme,
repeat; group4: combination, repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas as S

# A predicate of more configurations than this is slow to compile: use a join.
MAX_FILTER_CONFIGURATIONS = 64


_PARAM = {p: (t, tp) for p, t, tp in S.PARAM_SETS}
_PARAM_ORTH = {p: (t, tp) for p, t, tp in S.PARAM_SETS_ORTHOGONAL}
_MODEL_NAME_ORTH = {k: n for k, n, _, _ in S.MODELS_ORTHOGONAL}


@dataclass
class Factor:
    name: str
    values: list


@dataclass
class Design:
    """One design: named factors (outermost first) or a list of explicit
    combinations, fixed columns, key rule, and the configuration's tables."""
    name: str
    factors: list[Factor] = field(default_factory=list)
    fixed: dict = field(default_factory=dict)
    repeats: int = S.REPEAT_TIMES
    enabled: bool = True
    key: str = "exploratory"          # or "orthogonal"
    counter: str = "global"           # "global": one counter across designs; "design": restarts
    combinations: list[dict] = field(default_factory=list)   # column -> value, instead of factors
    params: dict = field(default_factory=lambda: _PARAM)     # parameter set -> (temperature, top_p)
    model_names: dict = field(default_factory=lambda: _MODEL_NAME_ORTH)
    top_p: float = 1.0                # of designs that name a temperature

    @property
    def size(self) -> int:
        n = self.repeats
        for f in self.factors:
            n *= len(f.values)
        return n * (len(self.combinations) or 1)


def _pick(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def grid(spark: SparkSession, d: Design, offset: int = 0) -> DataFrame:
    """Rows of one design with 1-based ``position`` starting after ``offset``."""
    idx = F.col("id")
    radix = d.repeats
    cols = {"repeat_idx": (idx % d.repeats + 1).cast("int")}
    if d.combinations:
        at = F.floor(idx / radix) % len(d.combinations)
        cols |= {k: _pick([c[k] for c in d.combinations], at) for k in d.combinations[0]}
        radix *= len(d.combinations)
    for f in reversed(d.factors):
        cols[f.name] = _pick(f.values, F.floor(idx / radix) % len(f.values))
        radix *= len(f.values)
    for k, v in d.fixed.items():
        cols[k] = F.lit(v)
    df = spark.range(d.size).select(
        F.lit(d.name).alias("design"), *[c.alias(n) for n, c in cols.items()],
        (idx + offset + 1).alias("position"))
    # exploratory designs name a parameter set, orthogonal ones a temperature;
    # the other is NULL where the configuration has no match
    if "param_set" in df.columns:
        df = (df.withColumn("temperature", _map({p: float(t) for p, (t, _) in d.params.items()})[F.col("param_set")])
              .withColumn("top_p", _map({p: float(tp) for p, (_, tp) in d.params.items()})[F.col("param_set")]))
    else:
        df = df.withColumn("temperature", F.col("temperature").cast("double"))
        sets = _map({float(t): p for p, (t, _) in d.params.items()})
        df = df.withColumn("param_set", sets[F.col("temperature")]).withColumn("top_p", F.lit(float(d.top_p)))
    return df.withColumn("run_key", run_key(d.key, d.model_names)).select(*S.PLAN.fieldNames())


def run_key(kind: str, model_names: dict | None = None) -> Column:
    """K1: the canonical run key of a plan row.

    exploratory: ``<design>_<scene>_<scheme>_<model>_<param_set>_<repeat-1>``;
    orthogonal: ``<group>_<scene>_<scheme>_T<temperature>_<model name>_<repeat>``.
    """
    if kind == "exploratory":
        return joined_key("design", "scene_id", "scheme_key", "model_key", "param_set",
                          (F.col("repeat_idx") - 1).cast("string"))
    names = _map(model_names or _MODEL_NAME_ORTH)
    return joined_key("design", "scene_id", "scheme_key", F.concat(F.lit("T"), F.col("temperature").cast("string")),
                      F.coalesce(names[F.col("model_key")], F.col("model_key")), F.col("repeat_idx").cast("string"))


def joined_key(*parts) -> Column:
    """Key parts joined by ``_``; NULL when a part is NULL."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*[x for c in cols for x in (F.lit("_"), c)][1:])


# ---------------------------------------------------------------- designs

def _params(cfg: dict) -> dict:
    return {k: (float(v["temperature"]), float(v.get("top_p", 1.0))) for k, v in (cfg.get("parameter_sets") or {}).items()}


def designs_from_config(cfg: dict) -> list[Design]:
    """The designs of a configuration (the parsed YAML of either
    experiment): models, scenes, schemes, parameter sets, temperatures,
    combinations, repeats or sample sizes, and ``enabled`` per design."""
    exp = cfg["experiment"]
    params = _params(cfg)
    names = {k: v.get("name") or k for k, v in (cfg.get("models") or {}).items()}
    out = []
    if main := exp.get("main_experiment"):
        out.append(Design(
            "main", [Factor("model_key", main["models"]), Factor("scene_id", main["scenes"]), Factor("scheme_key", main["schemes"])],
            # the experiment runs its main design with P1 whatever the configuration says
            fixed={"param_set": "P1"}, repeats=exp["repeat_times"], enabled=main.get("enabled", True), params=params))
    if sens := exp.get("sensitivity_experiment"):
        out.append(Design(
            "sens", [Factor("model_key", sens["models"]), Factor("scheme_key", sens["schemes"]), Factor("param_set", sens["param_sets"])],
            fixed={"scene_id": sens["scene"]}, repeats=exp["repeat_times"], enabled=sens.get("enabled", True), params=params))
    for name, key in (("group1", "group1_temperature"), ("group2", "group2_scheme"), ("group3", "group3_model"), ("group4", "group4_interaction")):
        if not (g := exp.get(key)):
            continue
        fixed = {"scene_id": exp.get("fixed_scene", S.ORTHOGONAL_SCENE)}
        factors, combinations = [], []
        if "combinations" in g:
            combinations = [{"model_key": c["model"], "scheme_key": c["scheme"], "temperature": float(c["temp"])} for c in g["combinations"]]
        else:
            factors.append(Factor("model_key", g["models"]))
            if "temperatures" in g:
                factors.append(Factor("temperature", [float(t) for t in g["temperatures"]]))
                fixed["scheme_key"] = g["scheme"]
            else:
                factors.append(Factor("scheme_key", g["schemes"]))
                fixed["temperature"] = float(g["temperature"])
        out.append(Design(name, factors, fixed=fixed, repeats=g.get("sample_size", exp.get("repeat_times")), enabled=g.get("enabled", True),
                          key="orthogonal", counter="design", combinations=combinations, params=params, model_names=names,
                          top_p=exp.get("fixed_top_p", 1.0)))
    return out


def weights_from_config(cfg: dict) -> dict[str, float]:
    """Composite weights by our dimension names, for A9-A12 (missing: the default)."""
    own = {d["name"]: d.get("weight") for d in cfg.get("evaluation_dimensions") or []}
    return {c: S.DIM_WEIGHTS[c] if own.get(k) is None else float(own[k]) for c, k, _ in S.DIMENSIONS}


def default_config(orthogonal: bool = False) -> dict:
    """The configuration in ``schemas``, in the shape of the YAML files."""
    models = S.MODELS_ORTHOGONAL if orthogonal else S.MODELS
    sets = S.PARAM_SETS_ORTHOGONAL if orthogonal else S.PARAM_SETS
    cfg = {"models": {k: {"name": n} for k, n, _, _ in models}, "parameter_sets": {p: {"temperature": t, "top_p": tp} for p, t, tp in sets}}
    if orthogonal:
        n = S.ORTHOGONAL_REPEATS
        cfg["experiment"] = {
            "repeat_times": n, "fixed_scene": S.ORTHOGONAL_SCENE, "fixed_top_p": 1.0,
            "group1_temperature": {**S.GROUP1, "sample_size": n}, "group2_scheme": {**S.GROUP2, "sample_size": n},
            "group3_model": {**S.GROUP3, "sample_size": n},
            "group4_interaction": {"combinations": [{"model": m, "scheme": s, "temp": t} for m, s, t in S.GROUP4], "sample_size": n}}
    else:
        cfg["experiment"] = {"repeat_times": S.REPEAT_TIMES, "main_experiment": S.MAIN_DESIGN, "sensitivity_experiment": S.SENSITIVITY_DESIGN}
    return cfg


def exploratory_designs(main_enabled: bool = True, sens_enabled: bool = True) -> list[Design]:
    main, sens = designs_from_config(default_config())
    main.enabled, sens.enabled = main_enabled, sens_enabled
    return [main, sens]


def orthogonal_designs(enabled: dict | None = None) -> list[Design]:
    designs = designs_from_config(default_config(orthogonal=True))
    for d in designs:
        d.enabled = (enabled or {}).get(d.name, True)
    return designs


def plan(spark: SparkSession, designs: list[Design]) -> DataFrame:
    """P7 + P10: union of the enabled designs.  ``position`` is the progress
    counter: one counter across designs (exploratory) or one per design
    (orthogonal groups), as each experiment numbers its runs."""
    parts, offset = [], 0
    for d in designs:
        if not d.enabled:
            continue
        if d.counter != "global":
            offset = 0
        parts.append(grid(spark, d, offset))
        offset = offset + d.size if d.counter == "global" else 0
    if not parts:
        return spark.createDataFrame([], S.PLAN)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def planned_counts(designs: list[Design], include_disabled: bool = True) -> list[tuple[str, int, bool]]:
    """Planned runs per design, from the configuration alone (driver side).

    The exploratory script counts disabled designs in its total too.
    """
    return [(d.name, d.size, d.enabled) for d in designs if include_disabled or d.enabled]


def distinct_configurations(plan_df: DataFrame) -> DataFrame:
    """Distinct (model, scheme, temperature) over possibly overlapping groups."""
    return plan_df.select("model_key", "scheme_key", "temperature").distinct()


def plan_size(designs: list[Design]) -> int:
    return sum(d.size for d in designs if d.enabled)


def configurations(d: Design) -> list[dict]:
    """Distinct configurations (model_key, scheme_key, temperature) of one
    design, enumerated on the driver from its factors (no data involved)."""
    rows = [{**d.fixed, **c} for c in d.combinations or [{}]]
    for f in d.factors:
        rows = [{**r, f.name: v} for r in rows for v in f.values]
    rows = [{k: (float(v) if k == "temperature" else v) for k, v in r.items()
             if k in ("model_key", "scheme_key", "temperature")} for r in rows]
    out, seen = [], set()
    for r in rows:
        key = tuple(sorted(r.items()))
        if key not in seen:
            seen.add(key)
            out.append({"group_id": d.name, **r})
    return out


def config_filter(configs: list[dict]) -> Column:
    """A predicate selecting rows of the given configurations (an OR of
    equalities: evaluated in the scan stage, before any shuffle).  Callers
    use it up to ``MAX_FILTER_CONFIGURATIONS`` and a join beyond."""
    cond = None
    for c in configs:
        conj = None
        for k, v in c.items():
            e = F.col(k) == F.lit(v)
            conj = e if conj is None else conj & e
        cond = conj if cond is None else cond | conj
    return cond if cond is not None else F.lit(False)
