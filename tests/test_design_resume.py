"""Design grid sizes and orders, resume properties."""

from pyspark.sql import functions as F

from runlens.plans import design as D
from runlens.plans import resume as RS
import oracle_sql_parts as O


def test_exploratory_counts(spark):
    p = D.plan(spark, D.exploratory_designs())
    counts = {r.design: r["count"] for r in p.groupBy("design").count().collect()}
    assert counts == {"main": 90, "sens": 120}
    assert p.select("run_key").distinct().count() == 210


def test_orthogonal_counts(spark):
    designs = D.orthogonal_designs()
    p = D.plan(spark, designs)
    counts = {r.design: r["count"] for r in p.groupBy("design").count().collect()}
    assert counts == {"group1": 300, "group2": 180, "group3": 180, "group4": 180}
    assert D.distinct_configurations(p).count() == 18
    assert D.plan_size(designs) == 840


def test_plan_equals_nested_loops(spark):
    for kind, designs in (("exploratory", D.exploratory_designs()), ("orthogonal", D.orthogonal_designs())):
        got = [tuple(r) for r in D.plan(spark, designs).orderBy("design", "position").collect()]
        exp = sorted(O.plan_rows_python(kind), key=lambda r: (r[0], r[8]))
        assert len(got) == len(exp)
        for g, e in zip(got, exp):
            assert g == e, (g, e)


def test_disabled_design_is_left_out(spark):
    p = D.plan(spark, D.exploratory_designs(main_enabled=False))
    assert p.count() == 120
    assert [c for c in D.planned_counts(D.exploratory_designs(main_enabled=False))] == [
        ("main", 90, False), ("sens", 120, True)]


def test_resume_properties(spark):
    designs = D.exploratory_designs()
    plan = D.plan(spark, designs)
    n = D.plan_size(designs)
    # plan 6 rows, 2 completed -> 4 pending, 2 skipped
    six = plan.where(F.col("position") <= 6)
    done = six.where(F.col("position") <= 2).select("run_key")
    assert RS.pending(six, done).count() == 4
    assert RS.skipped(six, done).count() == 2
    # idempotent: a plan minus its own keys is empty; pending + skipped = plan
    assert RS.pending(plan, plan.select("run_key")).count() == 0
    some = plan.where(F.col("position") % 3 == 0).select("run_key")
    assert RS.pending(plan, some).count() + RS.skipped(plan, some).count() == n
    prog = {r.design: (r.planned, r.completed, r.pending) for r in RS.progress(plan, some).collect()}
    assert sum(v[0] for v in prog.values()) == n


def test_file_name_key(spark):
    df = spark.createDataFrame([("group1_sceneA_s_T0.0_Qwen_Qwen3-14B_1.json",), ("a_b.json",), ("x_y_z_1_2_3.txt",)],
                               "f string")
    got = [r[0] for r in df.select(RS.file_name_key(F.col("f"))).collect()]
    assert got == ["group1_sceneA_s_T0.0_Qwen_Qwen3-14B_1", None, None]


def test_sheet_name(spark):
    from runlens.operators.reports import sheet_name

    df = spark.createDataFrame([("abcdefghij/klmnopqrstuvwxy",)], "s string")
    assert df.select(sheet_name("s")).first()[0] == "abcdefghij_klmnopqrs"


def test_configurations_from_designs():
    got = {d.name: len(D.configurations(d)) for d in D.orthogonal_designs()}
    assert got == {"group1": 10, "group2": 6, "group3": 6, "group4": 6}
    allc = {(c["model_key"], c["scheme_key"], c["temperature"])
            for d in D.orthogonal_designs() for c in D.configurations(d)}
    assert len(allc) == 18
    assert sum(got.values()) == 28  # the configuration comment counts overlaps


def test_config_filter_equals_semi_join(spark):
    from runlens.operators.reports import restrict
    from runlens.sources import testdata as TD
    from conftest import SF_SMALL

    runs = TD.orthogonal_runs(spark, SF_SMALL)
    g2 = next(d for d in D.orthogonal_designs() if d.name == "group2")
    cfg_df = spark.createDataFrame(D.configurations(g2))
    a = restrict(runs, D.configurations(g2)).select("run_seq")
    b = restrict(runs, cfg_df).select("run_seq")
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_exploratory_file_names_collide_210_to_200(spark):
    from runlens.schemas import MODELS, SCHEMES
    from runlens.sinks.files import raw_file_key
    from runlens.sources.config import lookup

    p = D.plan(spark, D.exploratory_designs())
    runs = p.select("scene_id", "param_set", "repeat_idx",
                    lookup("scheme_key", SCHEMES).alias("scheme"),
                    lookup("model_key", [(k, n) for k, n, _, _ in MODELS]).alias("model"))
    names = runs.select(raw_file_key(runs).alias("f"))
    assert names.count() == 210 and names.distinct().count() == 200
    assert names.where("f LIKE '%-%' OR f LIKE '% %'").count() == 0


def test_orthogonal_file_model_part(spark):
    df = spark.createDataFrame([("Qwen/Qwen3-14B",)], "m string")
    assert df.select(RS.orthogonal_model_part(F.col("m"))).first()[0] == "Qwen_Qwen3-14B"


def test_readme_resume_flow_from_names(spark):
    import runlens as rl
    from runlens.sources import testdata as TD
    from conftest import SF_SMALL

    runs = TD.runs(spark, SF_SMALL).drop("scheme_key", "model_key")   # as a score file stores them
    r = rl.with_repeat_idx(rl.with_keys_from_names(runs), ["scene_id", "model", "scheme", "param_set", "design"])
    done = rl.completed_keys(r, rl.exploratory_key(r))
    designs = rl.exploratory_designs()
    todo = rl.pending(rl.plan(spark, designs), done)
    import __spark_entry__ as E
    assert todo.count() == E.queries()["j1_resume_pending"](spark, SF_SMALL).count()


def _stored(spark, plan_df, with_design=True):
    """Run rows as a completed experiment stores them, in the order it runs them."""
    from runlens.schemas import MODELS, SCHEMES
    from runlens.sources.config import lookup

    keep = ["design"] if with_design else []
    return plan_df.select((F.col("position") * 3).alias("run_seq"), *keep, "scene_id", "param_set", "repeat_idx", "temperature",
                          lookup("scheme_key", SCHEMES).alias("scheme"), lookup("model_key", [(k, n) for k, n, _, _ in MODELS]).alias("model"),
                          F.lit(True).alias("success"))


def test_a_complete_experiment_has_nothing_pending(spark):
    plan = D.plan(spark, D.exploratory_designs())
    for with_design in (True, False):
        runs = RS.with_design(RS.with_keys_from_names(_stored(spark, plan, with_design)))
        done = RS.completed_keys(runs, RS.exploratory_key(runs))
        assert done.distinct().count() == 210
        assert RS.pending(plan, done).count() == 0 and RS.skipped(plan, done).count() == 210
    # one main P1 run of the shared configuration is missing: the other design's runs don't stand in for it
    part = _stored(spark, plan).where("not (design = 'main' and scene_id = 'sceneA' and scheme like '%1%' and repeat_idx = 2)")
    runs = RS.with_design(RS.with_keys_from_names(part))
    todo = RS.pending(plan, RS.completed_keys(runs, RS.exploratory_key(runs))).collect()
    assert len(todo) == 2 and {r.design for r in todo} == {"main"}


def test_a_complete_folder_of_raw_files_has_nothing_pending(spark):
    from runlens.schemas import MODELS_ORTHOGONAL, SCHEMES
    from runlens.sources.config import lookup

    plan = D.plan(spark, D.orthogonal_designs())
    names = plan.select(F.concat_ws("_", "design", "scene_id", lookup("scheme_key", SCHEMES), F.concat(F.lit("T"), F.col("temperature").cast("string")),
                                    F.replace(lookup("model_key", [(k, n) for k, n, _, _ in MODELS_ORTHOGONAL]), F.lit("/"), F.lit("_")), "repeat_idx").alias("f"))
    done = names.select(RS.canonical_key_from_file_name(F.concat("f", F.lit(".json"))).alias("run_key"))
    assert done.distinct().count() == 840
    assert RS.pending(plan, done).count() == 0


def test_a_missing_key_part_completes_nothing(spark):
    runs = spark.createDataFrame([(1, "main", "sceneA", "scheme1", None, "P1", 1, True), (2, "main", "sceneA", "scheme1", "m", "P1", 1, True)],
                                 "run_seq long, design string, scene_id string, scheme_key string, model_key string, param_set string, repeat_idx int, success boolean")
    assert [r.run_key for r in RS.completed_keys(runs, RS.exploratory_key(runs)).collect()] == ["main_sceneA_scheme1_m_P1_0"]


def test_no_design_enabled_and_large_grids(spark):
    assert D.plan(spark, D.exploratory_designs(False, False)).count() == 0
    big = D.Design("main", [D.Factor("model_key", ["a", "b"]), D.Factor("scene_id", ["s"]), D.Factor("scheme_key", ["x"])],
                   fixed={"param_set": "P1"}, repeats=4_000_000)
    assert D.grid(spark, big).count() == 8_000_000


def test_more_configurations_than_a_filter_takes(spark):
    from runlens.operators.reports import restrict

    runs = spark.range(300).select(F.concat(F.lit("m"), "id").alias("model_key"), F.lit(0.5).alias("temperature"))
    configs = [{"group_id": "g", "model_key": f"m{i}", "temperature": 0.5} for i in range(0, 300, 2)]
    assert restrict(runs, configs).count() == 150


def test_designs_of_another_configuration(spark):
    cfg = {
        "models": {"m1": {"name": "Org/M-1"}, "m2": {"name": "M2"}, "m3": {}},
        "parameter_sets": {"T0": {"temperature": 0.0}, "Tx": {"temperature": 0.5, "top_p": 0.9}},
        "experiment": {
            "repeat_times": 2, "fixed_scene": "sceneB", "fixed_top_p": 0.8,
            "main_experiment": {"enabled": True, "models": ["m1", "m3"], "scenes": ["s1"], "schemes": ["a", "b", "c"]},
            "sensitivity_experiment": {"enabled": False, "models": ["m1"], "scene": "s1", "schemes": ["a"], "param_sets": ["T0", "Tx"]},
            "group1_temperature": {"models": ["m1", "m2", "m3"], "scheme": "a", "temperatures": [0.5, 0.7], "sample_size": 3},
            "group4_interaction": {"combinations": [{"model": "m3", "scheme": "b", "temp": 0.5}, {"model": "m1", "scheme": "c", "temp": 0}]},
        },
        "evaluation_dimensions": [{"name": "条目对应率", "weight": 0.4}, {"name": "无幻觉率"}],
    }
    designs = {d.name: d for d in D.designs_from_config(cfg)}
    assert {n: (d.size, d.enabled) for n, d in designs.items()} == {"main": (12, True), "sens": (4, False), "group1": (18, True), "group4": (4, True)}
    rows = D.plan(spark, list(designs.values())).orderBy("design", "position").collect()
    want, n = [], 0
    for m in ["m1", "m2", "m3"]:
        for t in [0.5, 0.7]:
            for r in range(3):
                n += 1
                want.append(("group1", "sceneB", "a", m, {0.5: "Tx"}.get(t), t, 0.8, r + 1, n, f"group1_sceneB_a_T{t}_{cfg['models'][m].get('name', m)}_{r + 1}"))
    n = 0
    for m, s, t in [("m3", "b", 0.5), ("m1", "c", 0.0)]:
        for r in range(2):
            n += 1
            want.append(("group4", "sceneB", s, m, {0.5: "Tx", 0.0: "T0"}[t], t, 0.8, r + 1, n, f"group4_sceneB_{s}_T{t}_{cfg['models'][m].get('name', m)}_{r + 1}"))
    n = 0
    for m in ["m1", "m3"]:
        for s in ["a", "b", "c"]:
            for r in range(2):
                n += 1
                want.append(("main", "s1", s, m, "P1", None, None, r + 1, n, f"main_s1_{s}_{m}_P1_{r}"))
    assert [tuple(r) for r in rows] == want
    assert D.weights_from_config(cfg)["entry_correspondence"] == 0.4 and D.weights_from_config(cfg)["no_hallucination"] == 0.15
    assert len(D.configurations(designs["group4"])) == 2
