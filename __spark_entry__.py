"""

Every query reads the driver's tables (``events`` first of all, from which
the run tables are derived -- see ``runlens.sources.testdata``) and runs over
all of their rows.  ``oracle_sql`` restates each query for DuckDB.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from runlens import schemas as S  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from runlens.operators import ranking as RK  # noqa: E402
from runlens.operators import reports as R  # noqa: E402
from runlens.functions import jsoncheck as JC  # noqa: E402
from runlens.functions import jsontext as JT  # noqa: E402
from runlens.functions import judge as JG  # noqa: E402
from runlens.operators import assemble as AS  # noqa: E402
from runlens.functions import text as TX  # noqa: E402
from runlens.plans import design as D  # noqa: E402
from runlens.plans import resume as RS  # noqa: E402
from runlens.session import configure, new_shared_path  # noqa: E402
from runlens.sinks import files as W  # noqa: E402
from runlens.sources import files as SRC  # noqa: E402
from runlens.sources import testdata as TD  # noqa: E402
import oracle_sql_parts as O  # noqa: E402

DIMS = S.DIM_COLS
SMOKE_DIR = "/root/testdata/sf0.001"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return TD.runs(spark, sf)


def _oruns(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return TD.orthogonal_runs(spark, sf)


# ---------------------------------------------------------------- reports
def q_a2(spark, sf):
    return R.consistency_report(_runs(spark, sf))


def sql_a2():
    keys = "scene_name, model, scheme, param_set"
    inner = [f"COUNT(*) AS n"]
    for d in DIMS:
        inner += [f"SUM({d}) AS s_{d}", f"{O.mean(d)} AS m_{d}",
                  f"stddev_samp({d}) AS sd_{d}", f"stddev_pop({d}) AS sp_{d}"]
    terms = " + ".join(f"(100.0 - least(CASE WHEN m_{d} > 0 THEN sp_{d} / m_{d} * 100.0 ELSE 0.0 END, 100.0))"
                       for d in DIMS)
    cons = f"CASE WHEN n < 2 THEN 100.0 ELSE ({terms}) / {O.dbl(6)} END"
    outer = [keys, "n", f"{O.pyr(cons, 1)} AS consistency"]
    for d in DIMS:
        outer += [f"{O.pyr(f'm_{d}', 1)} AS {d}_mean", f"{O.pyr(f'sd_{d}', 1)} AS {d}_std",
                  f"CASE WHEN s_{d} > 0 THEN {O.pyr(f'sd_{d} / m_{d} * 100.0', 1)} ELSE 0.0 END AS {d}_cv"]
    return (O.runs_cte() + f"SELECT {', '.join(outer)} FROM (SELECT {keys}, {', '.join(inner)} "
            f"FROM runs WHERE scene_name IS NOT NULL AND model IS NOT NULL AND scheme IS NOT NULL "
            f"AND param_set IS NOT NULL GROUP BY {keys}) g WHERE n > 1 ORDER BY {keys}")


def q_a1(spark, sf):
    return R.consistency_scores(_runs(spark, sf), ["scene_id", "model", "scheme"])


def sql_a1():
    keys = "scene_id, model, scheme"
    inner = ["COUNT(*) AS n"] + [f"{O.mean(d)} AS m_{d}, stddev_pop({d}) AS sp_{d}" for d in DIMS]
    terms = " + ".join(f"(100.0 - least(CASE WHEN m_{d} > 0 THEN sp_{d} / m_{d} * 100.0 ELSE 0.0 END, 100.0))"
                       for d in DIMS)
    cons = f"CASE WHEN n < 2 THEN 100.0 ELSE ({terms}) / {O.dbl(6)} END"
    return (O.runs_cte() + f"SELECT {keys}, n, {O.pyr(cons, 1)} "
            f"AS consistency FROM (SELECT {keys}, {', '.join(inner)} FROM runs GROUP BY {keys}) g")


def q_a3(spark, sf):
    return R.summary_statistics(_runs(spark, sf))


def sql_a3():
    keys = "scene_name, model, scheme, param_set"
    cols = []
    for c in DIMS + ["input_tokens", "output_tokens", "elapsed_time"]:
        cols += [f"{O.npr(O.mean(c), 2)} AS {c}_mean", f"{O.npr(O.std(c), 2)} AS {c}_std"]
    return O.runs_cte() + f"SELECT {keys}, {', '.join(cols)} FROM runs GROUP BY {keys} ORDER BY {keys}"


def q_a4(spark, sf):
    return R.main_results(_runs(spark, sf))


def sql_a4():
    keys = "scene_name, model, scheme"
    cols = []
    for d in DIMS:
        cols += [f"{O.npr(O.mean(d), 2)} AS {d}_mean", f"{O.npr(O.std(d), 2)} AS {d}_std"]
    cols += [f"{O.npr(O.mean(c), 2)} AS {c}_mean" for c in ["input_tokens", "output_tokens", "elapsed_time"]]
    return (O.runs_cte() + f"SELECT {keys}, {', '.join(cols)} FROM runs WHERE param_set = 'P1' "
            f"GROUP BY {keys} ORDER BY {keys}")


def _sheet_sql(keys: str, where: str = "") -> str:
    cols = ["arg_min_null(temperature, run_seq) AS temperature", "arg_min_null(top_p, run_seq) AS top_p",
            "COUNT(*) AS n"]
    for d in DIMS:
        cols += [f"{O.pyr(O.mean(d), 1)} AS {d}_mean", f"{O.pyr(O.std(d), 1)} AS {d}_std"]
    cols += [f"CAST({O.pyr(O.mean(c), 0)} AS BIGINT) AS {c}_mean" for c in ["input_tokens", "output_tokens"]]
    cols.append(f"{O.pyr(O.mean('elapsed_time'), 1)} AS elapsed_time_mean")
    return O.runs_cte() + f"SELECT {keys}, {', '.join(cols)} FROM runs {where} GROUP BY {keys} ORDER BY {keys}"


def q_a5(spark, sf):
    return R.main_summary(_runs(spark, sf))


def sql_a5():
    return _sheet_sql("scene_name, model, scheme", "WHERE param_set = 'P1'")


def q_a6(spark, sf):
    return R.sensitivity(_runs(spark, sf))


def sql_a6():
    return _sheet_sql("model, param_set")


def q_a7(spark, sf):
    return R.overall_statistics(_runs(spark, sf))


def sql_a7():
    keys = "model, scene_name, scheme"
    cols = ["COUNT(*) AS n", "CAST(SUM(input_tokens) AS BIGINT) AS input_tokens_sum",
            "CAST(SUM(output_tokens) AS BIGINT) AS output_tokens_sum",
            "CAST(round_even(SUM(CAST(elapsed_time AS DECIMAL(38,9))), 1) AS DOUBLE) AS elapsed_time_sum"]
    for d in DIMS:
        cols += [f"{O.pyr(O.mean(d), 1)} AS {d}_mean", f"{O.pyr(f'MAX({d})', 1)} AS {d}_max",
                 f"{O.pyr(f'MIN({d})', 1)} AS {d}_min"]
    return O.runs_cte() + f"SELECT {keys}, {', '.join(cols)} FROM runs GROUP BY {keys} ORDER BY {keys}"


def q_a8(spark, sf):
    return R.group_statistics(_oruns(spark, sf))


def sql_a8():
    keys = "group_id, model"
    ms = [f"m_{d}" for d in DIMS]
    total = ms[0]
    for m in ms[1:]:
        total = f"({total} + {m})"
    mean = f"({total} / {O.dbl(6)})"
    sq = " + ".join(f"(({m} - {mean}) * ({m} - {mean}))" for m in ms)
    # left-to-right sum of squares, as the Spark side builds it
    sq_terms = [f"(({m} - {mean}) * ({m} - {mean}))" for m in ms]
    sq = sq_terms[0]
    for t in sq_terms[1:]:
        sq = f"({sq} + {t})"
    inner = ", ".join(f"{O.mean(d)} AS m_{d}" for d in DIMS)
    return (O.runs_cte(orthogonal=True) + f"SELECT {keys}, n, {mean} AS mean_score, "
            f"sqrt({sq} / {O.dbl(5)}) AS std_score FROM (SELECT {keys}, COUNT(*) AS n, {inner} "
            f"FROM runs GROUP BY {keys}) g ORDER BY {keys}")



# ------------------------------------------------- composite / comparisons
def _orth_plan(spark):
    return D.plan(spark, D.orthogonal_designs())


def _group_configs(spark, group):
    """The configurations of one orthogonal design group (driver-side list)."""
    return D.configurations(next(d for d in D.orthogonal_designs() if d.name == group))


def q_a9(spark, sf):
    return R.with_composite(_runs(spark, sf)).select("run_seq", "scene_id", "model", "scheme", "param_set",
                                                      "composite")


def sql_a9():
    return O.runs_cte() + f"SELECT run_seq, scene_id, model, scheme, param_set, {O.composite_expr()} AS composite FROM runs"


G4_KEYS = ["model", "scheme", "temperature"]


def q_a10(spark, sf):
    return R.factor_effect(_oruns(spark, sf), _group_configs(spark, "group4"), G4_KEYS)


def _by_config_sql(keys: list[str], group: str, digits: int = 2) -> str:
    """composite + dimension statistics per configuration of one design group."""
    k = ", ".join(keys)
    cfg = (f"cfg AS (SELECT DISTINCT design AS group_id, model_key, scheme_key, temperature FROM plan "
           f"WHERE design = '{group}')\n")
    inner = ["COUNT(*) AS n", f"stddev_samp({O.composite_expr()}) AS csd"]
    for d in DIMS:
        inner += [f"{O.mean(d)} AS {d}_m", f"{O.std(d)} AS {d}_s"]
    outer = [k, "n", f"{O.pyr(O.composite_expr(suffix='_m'), digits)} AS composite_mean",
             f"{O.pyr('csd', digits)} AS composite_std"]
    for d in DIMS:
        outer += [f"{O.pyr(f'{d}_m', digits)} AS {d}_mean", f"{O.pyr(f'{d}_s', digits)} AS {d}_std"]
    return (O.runs_cte(orthogonal=True) + ", " + O.plan_cte("orthogonal") + ", " + cfg +
            f", g AS (SELECT {k}, {', '.join(inner)} FROM runs WHERE (group_id, model_key, scheme_key, temperature) "
            f"IN (SELECT group_id, model_key, scheme_key, temperature FROM cfg) GROUP BY {k})\n"
            f"SELECT {', '.join(outer)} FROM g")


def sql_a10():
    return _by_config_sql(G4_KEYS, "group4") + " ORDER BY model, scheme, temperature"


def q_a11(spark, sf):
    return R.best_configuration(R.restrict(_oruns(spark, sf), _group_configs(spark, "group4")), G4_KEYS)


def sql_a11():
    # ranked by the mean as it is, not as it is printed
    return _by_config_sql(G4_KEYS, "group4") + f" ORDER BY {O.composite_expr(suffix='_m')} DESC, model, scheme, temperature LIMIT 1"


def _baseline_rows(composite: str = "weighted") -> list[tuple]:
    """Manual baseline per dimension plus its composite: ``weighted`` (the
    formula applied to the manual values, 96.225) or ``published`` (the
    printed 97.0, which is the plain mean of the six manual values)."""
    rows = [(d, float(v)) for d, v in zip(DIMS, S.MANUAL_BASELINE)]
    if composite == "published":
        rows.append(("composite", S.MANUAL_BASELINE_COMPOSITE))
        return rows
    acc = None
    for d, v in zip(DIMS, S.MANUAL_BASELINE):
        t = v * S.DIM_WEIGHTS[d]
        acc = t if acc is None else acc + t
    rows.append(("composite", acc))
    return rows


def _baseline(spark, composite: str = "weighted"):
    return spark.createDataFrame([list(r) for r in _baseline_rows(composite)], "dimension string, manual double")


def q_j8(spark, sf):
    return R.best_vs_baseline(q_a11(spark, sf), _baseline(spark))


def _j8_sql(composite: str) -> str:
    base_rows = _baseline_rows(composite)
    unions = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d}_mean AS best_mean, {d}_std AS best_std FROM best" for d in DIMS)
    unions += " UNION ALL SELECT 'composite', composite_mean, composite_std FROM best"
    return (_by_config_sql(G4_KEYS, "group4").replace("\nSELECT ", ", best AS (SELECT ", 1) +
            " ORDER BY composite_mean DESC, model, scheme, temperature LIMIT 1)"
            f", manual_base AS {O.values(base_rows, ['dimension', 'manual'])}"
            f" SELECT dimension, manual, best_mean, best_std, {O.pyr('best_mean - manual', 1)} AS diff "
            f"FROM ({unions}) u JOIN manual_base USING (dimension)")


def sql_j8():
    return _j8_sql("weighted")


def q_j8_published(spark, sf):
    """J8 as the publication compares: the best configuration's weighted
    composite against the printed manual composite (a plain mean)."""
    return R.best_vs_baseline(q_a11(spark, sf), _baseline(spark, "published"))


def sql_j8_published():
    return _j8_sql("published")


def q_a12_temperature(spark, sf):
    return R.factor_effect(_oruns(spark, sf), _group_configs(spark, "group1"), ["model", "temperature"])


def sql_a12_temperature():
    return _by_config_sql(["model", "temperature"], "group1") + " ORDER BY model, temperature"


def q_a12_scheme(spark, sf):
    return R.factor_effect(_oruns(spark, sf), _group_configs(spark, "group2"), ["model", "scheme"])


def sql_a12_scheme():
    return _by_config_sql(["model", "scheme"], "group2") + " ORDER BY model, scheme"


def q_a12_model(spark, sf):
    return R.factor_effect(_oruns(spark, sf), _group_configs(spark, "group3"), ["scheme", "model"])


def sql_a12_model():
    return _by_config_sql(["scheme", "model"], "group3") + " ORDER BY scheme, model"


def q_a12_interaction(spark, sf):
    return R.interaction_table(_oruns(spark, sf), _group_configs(spark, "group4"), "scheme", "model_key",
                               [m for m, _, _, _ in S.MODELS_ORTHOGONAL])


def sql_a12_interaction():
    cfg = ("cfg AS (SELECT DISTINCT design AS group_id, model_key, scheme_key, temperature FROM plan "
           "WHERE design = 'group4')\n")
    cells = []
    for m, _, _, _ in S.MODELS_ORTHOGONAL:
        acc = None
        for d, _, w in S.DIMENSIONS:
            mean = (f"(SUM(CASE WHEN model_key = {O.lit(m)} THEN CAST({d} AS DOUBLE) END) / "
                    f"COUNT(CASE WHEN model_key = {O.lit(m)} THEN {d} END))")
            t = f"({mean} * {O.dbl(w)})"
            acc = t if acc is None else f"({acc} + {t})"
        cells.append(f"{O.pyr(acc, 2)} AS {m}_composite")
    cols = ", ".join(cells)
    return (O.runs_cte(orthogonal=True) + ", " + O.plan_cte("orthogonal") + ", " + cfg +
            f"SELECT scheme, {cols} FROM runs WHERE (group_id, model_key, scheme_key, temperature) "
            f"IN (SELECT group_id, model_key, scheme_key, temperature FROM cfg) GROUP BY scheme ORDER BY scheme")


# --------------------------------------------------- ordering / detail
RUN_KEYS = ["scene_id", "model", "scheme", "param_set"]


def q_n2(spark, sf):
    # every 50th run has lost its model's name: a NULL key part is a key like any other
    runs = _runs(spark, sf).withColumn("model", F.when(F.col("run_seq") % 50 != 0, F.col("model")))
    return R.with_repeat_idx(runs, RUN_KEYS).select("run_seq", *RUN_KEYS, "repeat_idx")


def sql_n2():
    return (O.runs_cte() + ", lost AS (SELECT * REPLACE (CASE WHEN run_seq % 50 <> 0 THEN model END AS model) FROM runs), " +
            O.with_repeat("runs_r", "lost", ", ".join(RUN_KEYS)) +
            f"SELECT run_seq, {', '.join(RUN_KEYS)}, repeat_idx FROM runs_r")


SPARSE = "(event_id * 2654435761) % 1099511627776"  # one-to-one, far apart and out of order


def q_n2_sparse(spark, sf):
    """N2 where order numbers are sparse and chunks small: borders by quantiles of each key."""
    runs = TD.events(spark, sf).selectExpr(f"{SPARSE} AS seq", "event_type", "event_id")
    return RK.seq_rank(runs, ["event_type"], "seq", "nth", chunk=256).select("event_id", "event_type", "nth")


def sql_n2_sparse():
    return f"SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY {SPARSE}) AS INTEGER) AS nth FROM events"


def q_f1(spark, sf):
    return R.detail(R.with_repeat_idx(_runs(spark, sf), RUN_KEYS))


def sql_f1():
    cols = [c for c in R.DETAIL_COLUMNS if not c.endswith("_note")]
    return (O.runs_cte() + ", " + O.with_repeat("runs_r", "runs", ", ".join(RUN_KEYS)) +
            f"SELECT {', '.join(cols)} FROM runs_r")


def _raw_writes(spark, sf):
    """Raw-output writes under the exploratory file naming, where the attempt
    number comes from the user -- many writes share a file name."""
    r = _runs(spark, sf).withColumn("attempt", (F.col("run_seq") % 5 + 1).cast("string"))
    return r.withColumn("file_key", RS.normalise_file_part(
        F.concat_ws("_", "scene_id", "scheme", "param_set", "model", "attempt")))


def q_n3(spark, sf):
    w = _raw_writes(spark, sf).select("file_key", "run_seq", "success", "elapsed_time", *DIMS)
    return RK.last_by_key(w, ["file_key"], "run_seq")


def sql_n3():
    fk = ("replace(replace(concat_ws('_', scene_id, scheme, param_set, model, CAST(run_seq % 5 + 1 AS STRING)), "
          "' ', '_'), '-', '_')")
    cols = ", ".join(["success", "elapsed_time", *DIMS])
    return (O.runs_cte() + f", w AS (SELECT {fk} AS file_key, run_seq, {cols}, row_number() OVER "
            f"(PARTITION BY {fk} ORDER BY run_seq DESC) AS rn FROM runs) "
            f"SELECT file_key, run_seq, {cols} FROM w WHERE rn = 1")


def q_f10(spark, sf):
    return R.first_appearance(_runs(spark, sf), ["scene_name", "model", "scheme", "param_set"])


def sql_f10():
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, MIN(run_seq) AS first_run_seq FROM runs "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in ["scene_name", "model", "scheme", "param_set"])
    return (O.runs_cte() + f"SELECT column_name, value, first_run_seq, row_number() OVER (PARTITION BY column_name "
            f"ORDER BY first_run_seq) AS position FROM ({parts}) u")


def q_t14(spark, sf):
    return R.scene_sheets(_runs(spark, sf))


def sql_t14():
    return (O.runs_cte() + "SELECT replace(substring(scene_name, 1, 20), '/', '_') AS sheet_name, scene_name, "
            "COUNT(*) AS n, MIN(run_seq) AS first_run_seq FROM runs WHERE scene_name IS NOT NULL "
            "GROUP BY scene_name ORDER BY first_run_seq")


# ---------------------------------------------------------------- resume
def _explo_plan(spark):
    return D.plan(spark, D.exploratory_designs())


def _explo_completed(spark, sf):
    r = R.with_repeat_idx(_runs(spark, sf), [*RUN_KEYS, "design"])
    return RS.completed_keys(r, RS.exploratory_key(r))


def q_j1(spark, sf):
    return RS.pending(_explo_plan(spark), _explo_completed(spark, sf))


_EXPLO_KEY_SQL = "design || '_' || scene_id || '_' || scheme_key || '_' || model_key || '_' || param_set || '_' || (repeat_idx - 1)"


def _explo_done_sql():
    return (O.runs_cte() + ", " + O.with_repeat("runs_r", "runs", ", ".join([*RUN_KEYS, "design"])) + ", " +
            O.plan_cte("exploratory") +
            f", done AS (SELECT DISTINCT {_EXPLO_KEY_SQL} AS run_key FROM runs_r WHERE success)\n")


def _plan_select(alias="plan"):
    return ", ".join(f"{alias}.{c}" if c not in ("position",) else f"CAST({alias}.position AS BIGINT) AS position"
                     for c in O.PLAN_COLS)


def sql_j1():
    return (_explo_done_sql() + f"SELECT {_plan_select()} FROM plan WHERE run_key NOT IN (SELECT run_key FROM done) "
            "ORDER BY design, position")


def q_j3(spark, sf):
    return RS.skipped(_explo_plan(spark), _explo_completed(spark, sf))


def sql_j3():
    return (_explo_done_sql() + f"SELECT {_plan_select()} FROM plan WHERE run_key IN (SELECT run_key FROM done) "
            "ORDER BY design, position")


def q_a13(spark, sf):
    return RS.progress(_explo_plan(spark), _explo_completed(spark, sf))


def sql_a13():
    return (_explo_done_sql() + "SELECT design, COUNT(*) AS planned, COUNT(done.run_key) AS completed, "
            "COUNT(*) - COUNT(done.run_key) AS pending FROM plan LEFT JOIN done USING (run_key) "
            "GROUP BY design ORDER BY design")


ORTH_KEYS = ["group_id", "scene_id", "scheme_key", "model", "temperature"]


def _orth_completed(spark, sf):
    r = R.with_repeat_idx(_oruns(spark, sf), ORTH_KEYS)
    return RS.completed_keys(r, RS.orthogonal_key())


def q_j2(spark, sf):
    return RS.pending(_orth_plan(spark), _orth_completed(spark, sf))


def _orth_done_sql():
    key = ("concat_ws('_', group_id, scene_id, scheme_key, concat('T', CAST(temperature AS STRING)), model, "
           "CAST(repeat_idx AS STRING))")
    return (O.runs_cte(orthogonal=True) + ", " + O.with_repeat("runs_r", "runs", ", ".join(ORTH_KEYS)) + ", " +
            O.plan_cte("orthogonal") + f", done AS (SELECT DISTINCT {key} AS run_key FROM runs_r WHERE success)\n")


def sql_j2():
    return (_orth_done_sql() + f"SELECT {_plan_select()} FROM plan WHERE run_key NOT IN (SELECT run_key FROM done) "
            "ORDER BY design, position")


def q_a13_orthogonal(spark, sf):
    return RS.progress(_orth_plan(spark), _orth_completed(spark, sf))


def sql_a13_orthogonal():
    return (_orth_done_sql() + "SELECT design, COUNT(*) AS planned, COUNT(done.run_key) AS completed, "
            "COUNT(*) - COUNT(done.run_key) AS pending FROM plan LEFT JOIN done USING (run_key) "
            "GROUP BY design ORDER BY design")


def q_p9(spark, sf):
    cfg = D.distinct_configurations(_orth_plan(spark))
    stats = (_oruns(spark, sf).groupBy("model_key", "scheme_key", "temperature")
             .agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("success"), 1)).alias("successful")))
    return (cfg.join(stats, ["model_key", "scheme_key", "temperature"], "left")
            .select("model_key", "scheme_key", "temperature",
                    F.coalesce("runs", F.lit(0)).alias("runs"),
                    F.coalesce("successful", F.lit(0)).alias("successful")))


def sql_p9():
    return (O.runs_cte(orthogonal=True) + ", " + O.plan_cte("orthogonal") +
            ", cfg AS (SELECT DISTINCT model_key, scheme_key, temperature FROM plan), "
            "st AS (SELECT model_key, scheme_key, temperature, COUNT(*) AS runs, "
            "COUNT(CASE WHEN success THEN 1 END) AS successful FROM runs GROUP BY ALL) "
            "SELECT model_key, scheme_key, temperature, coalesce(runs, 0) AS runs, "
            "coalesce(successful, 0) AS successful FROM cfg LEFT JOIN st USING (model_key, scheme_key, temperature)")


def _file_name():
    """Raw-output file name of a run, as the experiment writes it (failed runs have none)."""
    part = ["group_id", "scene_id", "scheme", F.concat(F.lit("T"), F.col("temperature").cast("string")),
            RS.orthogonal_model_part(F.col("model")), F.col("repeat_idx").cast("string")]
    return F.when(F.col("success"), F.concat(D.joined_key(*part), F.lit(".json")))


def q_k3(spark, sf):
    """K2-K4: completed keys from raw-output file names (successes) united
    with keys from the results rows (all rows): one key per run."""
    r = R.with_repeat_idx(_oruns(spark, sf), ORTH_KEYS)
    keys = F.array(RS.canonical_key_from_file_name(_file_name()), RS.orthogonal_key())
    return RS.union_keys(r.select(F.explode(keys).alias("run_key")).where("run_key is not null"))


def sql_k3():
    return (O.runs_cte(orthogonal=True) + ", " + O.with_repeat("runs_r", "runs", ", ".join(ORTH_KEYS)) +
            "SELECT DISTINCT group_id || '_' || scene_id || '_' || scheme_key || '_T' || temperature || '_' || model || '_' || "
            "repeat_idx AS run_key FROM runs_r")


def q_j2_files(spark, sf):
    """J2 + K4: resume from raw-output file names alone."""
    r = R.with_repeat_idx(_oruns(spark, sf), ORTH_KEYS)
    return RS.pending(_orth_plan(spark), RS.completed_keys(r, RS.canonical_key_from_file_name(_file_name())))


def q_s3(spark, sf):
    """S3 + K4 + J2: resume from a folder of raw outputs that holds the plan's
    finished runs, a folder a run.  Only its listing is read."""
    r = R.with_repeat_idx(_oruns(spark, sf), ORTH_KEYS)
    plan = _orth_plan(spark)
    done = r.select(_file_name().alias("file_name"), RS.orthogonal_key().alias("run_key"), "success", "elapsed_time").where("success")
    path = new_shared_path(spark, "raw")
    done.join(plan.select("run_key"), "run_key", "left_semi").repartition(32, "file_name").write.partitionBy("file_name").json(path)
    names = SRC.list_raw_output_names(spark, path)
    return RS.pending(plan, names.select(RS.canonical_key_from_file_name(F.col("file_name")).alias("run_key")).where("run_key is not null"))


def q_s5(spark, sf):
    """S5 + J1: resume from progress files."""
    done = _explo_completed(spark, sf)
    path = new_shared_path(spark, "progress")
    files = done.groupBy(F.pmod(F.xxhash64("run_key"), F.lit(64)).alias("part")).agg(F.collect_list("run_key").alias("completed"))
    files.select(F.to_json(F.struct("completed")).alias("value")).write.text(path)
    return RS.pending(_explo_plan(spark), SRC.read_progress(spark, path))


# ------------------------------------------------------------ files and folders
CSV_COLUMNS = ["run_seq", "scene_id", "success", "temperature", "input_tokens", "elapsed_time", "output_content"]


def q_s1(spark, sf):
    """S1 + W2: runs with their outputs' text (quotes, line breaks) as CSV and back."""
    path = new_shared_path(spark, "scores")
    W.export_csv(TD.outputs(spark, sf).select(*CSV_COLUMNS), path)
    back = SRC.read_runs_csv(spark, path)
    return back.select(*CSV_COLUMNS[:-1], F.length("output_content").cast("bigint").alias("output_chars"), F.md5("output_content").alias("output_md5"))


def sql_s1():
    # an empty field is a missing one
    return ("WITH " + O.outputs_cte() + f"SELECT {', '.join(CSV_COLUMNS[:-1])}, length(nullif(output_content, '')) AS output_chars, md5(nullif(output_content, '')) AS output_md5 FROM outs")


def q_s4(spark, sf):
    """S4's order of arrival: every run's place among all, by (time, number)."""
    configure(spark)
    return RK.global_rank(_runs(spark, sf).select("elapsed_time", "run_seq"), ["elapsed_time", "run_seq"], "place").select("run_seq", "place")


def sql_s4():
    return O.runs_cte() + "SELECT run_seq, row_number() OVER (ORDER BY elapsed_time, run_seq) - 1 AS place FROM runs"


def q_w1(spark, sf):
    """W1 + N3: raw documents written in three parts that overlap in names, read back."""
    runs = _raw_writes(spark, sf).withColumns({"repeat_idx": (F.col("run_seq") % 5 + 1).cast("int"), "output_content": F.col("error"), "json_valid": F.lit(None).cast("boolean")})
    path = new_shared_path(spark, "raw")
    W.merge_raw_outputs(runs.where("run_seq % 3 = 1"), path, F.col("file_key"))
    W.merge_raw_outputs(runs.where("run_seq % 3 = 0"), path, F.col("file_key"))
    W.merge_raw_outputs(runs.where("run_seq % 3 = 2"), path, F.col("file_key"))
    back = spark.read.schema(W.RAW_DOCUMENTS).json(path)
    return back.select("file_key", "run_seq", "success", "elapsed_time", *[F.col(k).alias(c) for c, k, _ in S.DIMENSIONS])


def q_w7(spark, sf):
    """All six report tables from one aggregation, one below the other."""
    tables = R.report_tables(_runs(spark, sf), materialise=W.materialise)
    out = None
    for name, table in tables.items():
        rows = table.withColumn("report", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def sql_w7():
    parts = {"consistency_report": sql_a2, "summary_statistics": sql_a3, "main_results": sql_a4,
             "main_summary": sql_a5, "param_sensitivity": sql_a6, "overall_statistics": sql_a7}
    return " UNION ALL BY NAME ".join(f"SELECT '{name}' AS report, * FROM ({sql()})" for name, sql in parts.items())


def q_w7_orthogonal(spark, sf):
    """W6 + W7: the orthogonal experiment's report tables from one aggregation."""
    tables = R.orthogonal_report_tables(_oruns(spark, sf), D.orthogonal_designs(), materialise=W.materialise)
    out = None
    for name, table in tables.items():
        rows = table.withColumn("report", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def sql_w7_orthogonal():
    parts = {"group_statistics": sql_a8, "composite_by_config": sql_a10, "temperature_effect": sql_a12_temperature, "scheme_effect": sql_a12_scheme,
             "model_effect": sql_a12_model, "interaction": sql_a12_interaction}
    return " UNION ALL BY NAME ".join(f"SELECT '{name}' AS report, * FROM ({sql()})" for name, sql in parts.items())


def q_w8(spark, sf):
    """W8 + F3: every scene's detail sheet written apart, one scene's sheet read back (the others' files are not opened)."""
    path = new_shared_path(spark, "sheets")
    sheets = R.detail(R.with_repeat_idx(_runs(spark, sf), RUN_KEYS)).withColumn("scene_sheet", R.sheet_name("scene_name"))
    sheets.write.partitionBy("scene_sheet").parquet(path)
    name = S.SCENES[0][1]
    return spark.read.parquet(path).where(F.col("scene_sheet") == R.sheet_name(F.lit(name))).drop("scene_sheet")


def sql_w8():
    return f"SELECT * FROM ({sql_f1()}) WHERE scene_name = {O.lit(S.SCENES[0][1])}"


def q_f8(spark, sf):
    """F7 + F8: the orthogonal experiment's run rows, failed ones as it records them."""
    return _oruns(spark, sf).select("run_seq", "group_id", "scheme", "model", "temperature", "top_p", "success", "error", "input_tokens", "output_tokens", "elapsed_time", *DIMS)


def sql_f8():
    cols = ["run_seq", "group_id", "scheme", "model", "temperature", "top_p", "success", "error", "input_tokens", "output_tokens", "elapsed_time", *DIMS]
    return O.runs_cte(orthogonal=True) + f"SELECT {', '.join(cols)} FROM runs"


# ------------------------------------------------------ model-output checks
CHECK_COLS = ["json_valid", "structure_valid", "field_names_valid", "data_types_valid", "n_items",
              "correct_items", "json_valid_detail", "structure_detail", "field_names_detail",
              "data_types_detail"]


def _checked(spark, sf):
    configure(spark)
    return JC.check_outputs(TD.outputs(spark, sf), "output_content")


def q_t6(spark, sf):
    return _checked(spark, sf).select("run_seq", "normalized", "json_valid")


def sql_t6():
    return "WITH " + O.outputs_cte() + f"SELECT run_seq, {O.normalized()} AS normalized, json_valid FROM parsed"


def q_t5(spark, sf):
    """T4 + T5 over whole documents as JSON texts in odd spelling."""
    configure(spark)
    d = JC.document_of(TD.odd_json(spark, sf), "json", "doc", "json_valid").withColumn("text", F.when(F.col("json_valid"), JT.canonical_text("json", "doc")))
    return d.select("doc_id", "json_valid", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def sql_t5():
    return (f"WITH t AS (SELECT doc_id, {TD.even_json_sql()} AS text FROM documents) "
            "SELECT doc_id, true AS json_valid, length(text) AS n_chars, md5(text) AS text_md5 FROM t")


def q_t7(spark, sf):
    return _checked(spark, sf).select("run_seq", *CHECK_COLS)


def sql_t7():
    return "WITH " + O.outputs_cte() + ", " + O.checks_cte() + f"SELECT run_seq, {', '.join(CHECK_COLS)} FROM checks"


def q_t21(spark, sf):
    c = _checked(spark, sf)
    return c.select("run_seq", JC.format_points("json_valid", "structure_valid", "field_names_valid",
                                                "data_types_valid").alias("format_points"))


def sql_t21():
    return ("WITH " + O.outputs_cte() + ", " + O.checks_cte() +
            "SELECT run_seq, (CASE WHEN json_valid THEN 40 ELSE 0 END + CASE WHEN structure_valid THEN 30 ELSE 0 END"
            " + CASE WHEN field_names_valid THEN 15 ELSE 0 END + CASE WHEN data_types_valid THEN 15 ELSE 0 END)"
            " AS format_points FROM checks")


def q_t22(spark, sf):
    configure(spark)
    c = JC.normalize_columns(TD.outputs(spark, sf), "output_content")   # only the parsed document
    return c.select("run_seq", JC.entry_counts_equal("parsed").alias("entry_counts_equal"))


def sql_t22():
    arr = lambda f: f"(CASE WHEN json_type(x, '$.{f}') = 'ARRAY' THEN json_array_length(x, '$.{f}') END)"
    same = f"coalesce({arr('methods')} = {arr('requirements')} AND {arr('requirements')} = {arr('criteria')}, false)"
    return ("WITH " + O.outputs_cte() +
            "SELECT run_seq, CASE WHEN json_type(j, '$.test_items') = 'ARRAY' AND json_array_length(j, '$.test_items') > 0 "
            f"THEN list_bool_and(list_transform(json_extract(j, '$.test_items[*]'), lambda x: {same})) END "
            "AS entry_counts_equal FROM parsed")


def _with_prompt(df):
    """The prompt text of each run's scene and scheme, as sent."""
    user = F.concat(F.lit("Generate test items for "), F.col("scene_id"), F.lit(". Registers: "), F.expr(TD.prompt_registers_sql()), F.lit("."))
    return df.withColumn("input_prompt", TX.prompt_text(F.expr(TD.PROMPT_SYSTEM_SQL), user))


def _prompt_sql():
    user = f"concat('Generate test items for ', scene_id, '. Registers: ', {TD.prompt_registers_sql()}, '.')"
    return f"regexp_replace(concat({TD.PROMPT_SYSTEM_SQL}, chr(10), {user}), '^[\\s　]+|[\\s　]+$', '', 'g')"


def q_t23(spark, sf):
    configure(spark)
    o = _with_prompt(TD.outputs(spark, sf))
    found = TX.hex_addresses("output_content")
    # what a prompt names is read from the prompt itself
    unknown = F.array_sort(JC.unknown_addresses(found, TX.hex_addresses("input_prompt")))
    return o.select("run_seq", F.size(found).cast("bigint").alias("n_addresses"),
                    F.size(unknown).cast("bigint").alias("n_unknown"),
                    F.array_join(unknown, ",").alias("unknown_addresses"),
                    (F.size(unknown) == 0).alias("addresses_ok"))


def sql_t23():
    addresses = lambda c: f"list_distinct(regexp_extract_all({c}, '(0x[0-9A-Fa-f]+)', 1))"
    unknown = f"list_sort(list_filter({addresses('output_content')}, lambda a: NOT list_contains(pa, a)))"
    return ("WITH " + O.outputs_cte() + f", named AS (SELECT *, {addresses(_prompt_sql())} AS pa FROM outs) "
            f"SELECT run_seq, len({addresses('output_content')}) AS n_addresses, len({unknown}) AS n_unknown, "
            f"array_to_string({unknown}, ',') AS unknown_addresses, len({unknown}) = 0 AS addresses_ok FROM named")



# ---------------------------------------------------------------- judge side
def q_t18(spark, sf):
    configure(spark)
    j = JG.parse_judge_replies(TD.judge_replies(spark, sf), "reply", "j")
    return j.select("run_seq", "j.judge_ok", *[f"j.{d}" for d in DIMS])


def _judge_sql_cols(txt: str = "txt", ok: str = "judge_ok") -> list[str]:
    """0 where absent or unreadable, NULL where the reply says null."""
    cols = []
    for c, k, _ in S.DIMENSIONS:
        number = f"TRY_CAST(json_extract_string({txt}, '$.\"{k}\"') AS DOUBLE)"
        cols.append(f"CASE WHEN NOT {ok} THEN 0.0 WHEN json_type({txt}, '$.\"{k}\"') = 'NULL' THEN NULL "
                    f"WHEN isfinite({number}) THEN {number} ELSE 0.0 END AS {c}")
    return cols


def _replies_cte() -> str:
    a_cols = ", ".join(f"{e} AS {n}" for n, e in TD.RUN_BASE if n.startswith("a"))
    reply = TD.judge_reply_sql().replace("event_id", "run_seq")
    return (f"rep0 AS (SELECT event_id AS run_seq, {a_cols} FROM events WHERE event_id % 97 <> 0), "
            f"rep AS (SELECT run_seq, {reply} AS reply FROM rep0), "
            "rep1 AS (SELECT run_seq, reply, regexp_extract(reply, '\\{[\\s\\S]*\\}', 0) AS span FROM rep), "
            "rep2 AS (SELECT run_seq, CASE WHEN span <> '' THEN span ELSE reply END AS txt FROM rep1), "
            "rep3 AS (SELECT run_seq, txt, CASE WHEN json_valid(txt) THEN json_type(txt) = 'OBJECT' ELSE false END AS judge_ok FROM rep2)\n")


def sql_t18():
    return "WITH " + _replies_cte() + f"SELECT run_seq, judge_ok, {', '.join(_judge_sql_cols())} FROM rep3"


def q_j7(spark, sf):
    configure(spark)
    runs = AS.assemble_runs(TD.outputs(spark, sf), TD.judge_replies(spark, sf))
    return runs.select("run_seq", "success", "json_valid", "judge_ok", "temperature", "input_tokens", "elapsed_time", *DIMS)


def sql_j7():
    dims = ", ".join(f"CASE WHEN success AND judge_ok THEN {d} ELSE 0.0 END AS {d}" for d in DIMS)
    return ("WITH " + O.outputs_cte() + ", " + _replies_cte() +
            f", sc AS (SELECT run_seq, judge_ok, {', '.join(_judge_sql_cols())} FROM rep3) "
            "SELECT run_seq, success, CASE WHEN success THEN json_valid END AS json_valid, "
            "CASE WHEN success THEN coalesce(judge_ok, false) END AS judge_ok, "
            "CASE WHEN success THEN temperature END AS temperature, CASE WHEN success THEN input_tokens ELSE 0 END AS input_tokens, "
            f"CASE WHEN success THEN elapsed_time ELSE 0.0 END AS elapsed_time, {dims} "
            "FROM parsed LEFT JOIN sc USING (run_seq)")


def q_t17(spark, sf):
    """Judge prompts of runs of all scenes, each from its own scene's template."""
    c = _with_prompt(_checked(spark, sf))
    checks = {k: F.col(k) for k in JG.TEMPLATE_FIELDS[2:]}
    text = JG.judge_prompts("scene_id", TD.JUDGE_TEMPLATES, F.col("input_prompt"), F.col("normalized"), checks)
    return c.select("run_seq", F.length(text).cast("bigint").alias("prompt_chars"), F.md5(text).alias("prompt_md5"))


def sql_t17():
    import string as _s
    vals = {"input_prompt": _prompt_sql(),
            "output_content": O.normalized()}
    for k in JG.TEMPLATE_FIELDS[2:]:
        vals[k] = (f"CASE WHEN {k} THEN 'True' WHEN NOT {k} THEN 'False' ELSE 'None' END"
                   if k.endswith("_valid") else k)
    cases = []
    for scene, template in TD.JUDGE_TEMPLATES.items():
        parts = []
        for literal, field, _, _ in _s.Formatter().parse(template):
            if literal:
                parts.append(O.lit(literal))
            if field:
                parts.append(f"CAST({vals[field]} AS VARCHAR)")
        cases.append(f"WHEN {O.lit(scene)} THEN concat({', '.join(parts)})")
    return ("WITH " + O.outputs_cte() + ", " + O.checks_cte() +
            f", texts AS (SELECT run_seq, CASE scene_id {' '.join(cases)} END AS txt FROM checks) "
            "SELECT run_seq, length(txt) AS prompt_chars, md5(txt) AS prompt_md5 FROM texts")


def q_j6(spark, sf):
    """J6 + T15 + T16: every run with its scheme's prompt and message list."""
    prompts = spark.createDataFrame(TD.SCHEME_PROMPTS, "scene_id string, scheme_key string, system string, user string")
    r = AS.with_prompts(_runs(spark, sf).select("run_seq", "scene_id", "scheme_key"), prompts)
    return r.select("run_seq", F.md5("input_prompt").alias("prompt_md5"), F.size("messages").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("contents"))


def sql_j6():
    from runlens.functions.text import PY_WHITESPACE

    rows = ", ".join("(" + ", ".join("NULL" if v is None else O.lit(v) for v in r) + ")" for r in TD.SCHEME_PROMPTS)
    return (O.runs_cte() + f", prompts AS (SELECT * FROM (VALUES {rows}) t(scene_id, scheme_key, system, \"user\")), "
            "j AS (SELECT run_seq, coalesce(system, '') AS s, coalesce(\"user\", '') AS u FROM runs LEFT JOIN prompts USING (scene_id, scheme_key)) "
            f"SELECT run_seq, md5(trim(concat(s, chr(10), u), {O.lit(PY_WHITESPACE)})) AS prompt_md5, CASE WHEN s <> '' THEN 2 ELSE 1 END AS n_messages, "
            "CASE WHEN s <> '' THEN concat(s, '|', u) ELSE u END AS contents FROM j")



# ------------------------------------------------- whole-document outputs
def q_t7_documents(spark, sf):
    configure(spark)
    c = JC.check_outputs(TD.document_outputs(spark, sf), "output_content")
    return c.select("run_seq", *CHECK_COLS, JC.entry_counts_equal("parsed").alias("entry_counts_equal"))


def sql_t7_documents():
    src = ("SELECT doc_id AS run_seq, NULL AS scene_id, NULL AS scheme_key, true AS success, "
           f"{TD.document_output_sql('duckdb')} AS output_content FROM documents")
    arr = lambda f: f"(CASE WHEN json_type(x, '$.{f}') = 'ARRAY' THEN json_array_length(x, '$.{f}') END)"
    same = f"coalesce({arr('methods')} = {arr('requirements')} AND {arr('requirements')} = {arr('criteria')}, false)"
    return ("WITH " + O.outputs_cte(src) + ", " + O.checks_cte() +
            f"SELECT run_seq, {', '.join(CHECK_COLS)}, "
            "CASE WHEN json_type(j, '$.test_items') = 'ARRAY' AND json_array_length(j, '$.test_items') > 0 "
            f"THEN list_bool_and(list_transform(json_extract(j, '$.test_items[*]'), lambda x: {same})) END "
            "AS entry_counts_equal FROM checks")


# ------------------------------------------------ prompts and message lists
def q_t16(spark, sf):
    """T15 + T16 over conversations: every user turn with its conversation's
    (first) system turn forms a prompt and a message list."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    system = conv.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    turns = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user")).join(system, "conv_id", "left")
    msgs = TX.chat_messages("system", "user")
    return turns.select("conv_id", "turn", F.size(msgs).alias("n_messages"),
                        F.array_join(F.transform(msgs, lambda m: m["role"]), ",").alias("roles"),
                        F.md5(TX.prompt_text("system", "user")).alias("prompt_md5"))


def sql_t16():
    from runlens.functions.text import PY_WHITESPACE

    ws = O.lit(PY_WHITESPACE)
    return ("WITH s AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) "
            "SELECT conv_id, turn, CASE WHEN length(coalesce(system, '')) > 0 THEN 2 ELSE 1 END AS n_messages, "
            "CASE WHEN length(coalesce(system, '')) > 0 THEN 'system,user' ELSE 'user' END AS roles, "
            f"md5(trim(concat(coalesce(system, ''), chr(10), coalesce(text, '')), {ws})) AS prompt_md5 "
            "FROM conversations LEFT JOIN s USING (conv_id) WHERE role = 'user'")


_QUERIES: dict[str, tuple[Callable, Callable | None]] = {
    "a1_consistency_score": (q_a1, sql_a1),
    "a2_consistency_report": (q_a2, sql_a2),
    "a3_summary_stats": (q_a3, sql_a3),
    "a4_main_results": (q_a4, sql_a4),
    "a5_main_summary": (q_a5, sql_a5),
    "a6_param_sensitivity": (q_a6, sql_a6),
    "a7_overall_stats": (q_a7, sql_a7),
    "a8_group_stats": (q_a8, sql_a8),
    "a9_composite_per_run": (q_a9, sql_a9),
    "a10_composite_by_config": (q_a10, sql_a10),
    "a11_best_config": (q_a11, sql_a11),
    "j8_best_vs_baseline": (q_j8, sql_j8),
    "j8_published_comparison": (q_j8_published, sql_j8_published),
    "a12_temperature_effect": (q_a12_temperature, sql_a12_temperature),
    "a12_scheme_effect": (q_a12_scheme, sql_a12_scheme),
    "a12_model_effect": (q_a12_model, sql_a12_model),
    "a12_interaction": (q_a12_interaction, sql_a12_interaction),
    "n2_repeat_index": (q_n2, sql_n2),
    "f1_detail": (q_f1, sql_f1),
    "n3_last_write_wins": (q_n3, sql_n3),
    "f10_first_appearance": (q_f10, sql_f10),
    "t14_scene_sheets": (q_t14, sql_t14),
    "j1_resume_pending": (q_j1, sql_j1),
    "j3_resume_skipped": (q_j3, sql_j3),
    "a13_progress": (q_a13, sql_a13),
    "j2_orthogonal_pending": (q_j2, sql_j2),
    "j2_resume_from_files": (q_j2_files, sql_j2),
    "j6_run_prompts": (q_j6, sql_j6),
    "a13_orthogonal_progress": (q_a13_orthogonal, sql_a13_orthogonal),
    "p9_config_coverage": (q_p9, sql_p9),
    "k3_completed_keys": (q_k3, sql_k3),
    "t6_normalize_output": (q_t6, sql_t6),
    "t7_format_check": (q_t7, sql_t7),
    "t21_format_points": (q_t21, sql_t21),
    "t22_entry_counts": (q_t22, sql_t22),
    "t23_address_fidelity": (q_t23, sql_t23),
    "t18_judge_scores": (q_t18, sql_t18),
    "j7_assemble_runs": (q_j7, sql_j7),
    "t17_judge_prompt": (q_t17, sql_t17),
    "t7_format_check_documents": (q_t7_documents, sql_t7_documents),
    "t16_chat_messages": (q_t16, sql_t16),
    "t5_canonical_text": (q_t5, sql_t5),
    "n2_sparse_order": (q_n2_sparse, sql_n2_sparse),
    "s1_csv_runs": (q_s1, sql_s1),
    "s3_resume_from_folder": (q_s3, sql_j2),
    "s4_global_order": (q_s4, sql_s4),
    "s5_resume_from_progress": (q_s5, sql_j1),
    "w1_merged_documents": (q_w1, sql_n3),
    "w7_report_tables": (q_w7, sql_w7),
    "w7_orthogonal_tables": (q_w7_orthogonal, sql_w7_orthogonal),
    "w8_one_scene_sheet": (q_w8, sql_w8),
    "f8_orthogonal_rows": (q_f8, sql_f8),
}

# the training-data operators and their pipeline: parts of their own that may be left out
try:
    import corpus_pipeline  # noqa: E402
    from runlens.llm import entry as LLM  # noqa: E402
except ModuleNotFoundError as missing:
    # their own modules, or a library that only they need
    if missing.name.startswith("runlens") and missing.name != "runlens.llm":
        raise
else:
    _QUERIES |= LLM.QUERIES | {"pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL and (lambda: corpus_pipeline.ORACLE_SQL))}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the summary statistics report on sf0.001."""
    return q_a3(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in _QUERIES.items() if v[1] is not None}
