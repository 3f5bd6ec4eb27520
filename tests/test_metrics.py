"""Rounding, composite and consistency on small literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.metrics import composite_score, np_round, py_round
from runlens.operators import reports as R

VALUES = [0.025, 0.15, 2.675, 2.5, 3.5, 92.25, 92.35, -0.93, 1.005, 0.125, 94.827, 96.6667,
          12345.65, 0.0, 7.0, 1e-7, 99.95, 0.285, 1.015, 2.345]


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_py_round_matches_python(spark, digits):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got = [r[0] for r in df.select(py_round("x", digits)).collect()]
    exp = [float(round(v, digits)) for v in VALUES]
    assert got == exp


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_np_round_matches_numpy(spark, digits):
    np = pytest.importorskip("numpy")
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got = [r[0] for r in df.select(np_round("x", digits)).collect()]
    exp = [float(np.round(v, digits)) for v in VALUES]
    assert got == exp


def test_half_even_literals(spark):
    r = spark.range(1).select(py_round(F.lit(2.5), 0).alias("a"), py_round(F.lit(92.25), 1).alias("b")).first()
    assert (r.a, r.b) == (2.0, 92.2)


def _runs(spark, rows):
    cols = ["run_seq", "scene_name", "model", "scheme", "param_set", *S.DIM_COLS]
    data = [(i, "s", "m", "k", "P1", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} {'bigint' if c == 'run_seq' else 'double' if c in S.DIM_COLS else 'string'}" for c in cols))


@pytest.mark.parametrize("vals,expected", [
    ([90.0, 70.0], 87.5),
    ([0.0, 0.0], 100.0),
    ([100.0, 0.0, 0.0, 0.0], 0.0),
    ([50.0], 100.0),
])
def test_consistency_cases(spark, vals, expected):
    df = _runs(spark, [[v] * 6 for v in vals])
    r = R.consistency_scores(df).first()
    assert r.consistency == expected


def test_consistency_report_cv(spark):
    df = _runs(spark, [[90.0] * 6, [70.0] * 6])
    r = R.consistency_report(df).first()
    assert r.n == 2 and r.consistency == 87.5
    assert r.format_compliance_mean == 80.0
    assert r.format_compliance_std == 14.1
    assert r.format_compliance_cv == 17.7


def test_consistency_report_skips_singletons(spark):
    assert R.consistency_report(_runs(spark, [[1.0] * 6])).count() == 0


@pytest.mark.parametrize("vals,expected", [
    ([93.50, 100.0, 96.67, 92.07, 92.17, 99.00], 94.827),
    ([100.0, 100.0, 96.5, 93.0, 92.5, 100.0], 96.225),
])
def test_composite_published(spark, vals, expected):
    df = spark.createDataFrame([tuple(vals)], ", ".join(f"{c} double" for c in S.DIM_COLS))
    got = df.select(composite_score().alias("c")).first().c
    assert math.isclose(got, expected, abs_tol=1e-9)


def test_weights_sum_to_one():
    assert math.isclose(sum(w for _, _, w in S.DIMENSIONS), 1.0)


def test_group_statistics_std_across_dimension_means(spark):
    rows = [(0, "group1", "m", 90.0, 80.0, 70.0, 60.0, 50.0, 40.0),
            (1, "group1", "m", 90.0, 80.0, 70.0, 60.0, 50.0, 40.0)]
    df = spark.createDataFrame(rows, "run_seq bigint, group_id string, model string, " +
                               ", ".join(f"{c} double" for c in S.DIM_COLS))
    r = R.group_statistics(df).first()
    assert r.n == 2 and r.mean_score == 65.0
    assert math.isclose(r.std_score, 18.708286933869708)


def test_report_tables_equal_single_reports(spark):
    from runlens.sources import testdata as TD
    from conftest import SF_ORACLE

    runs = TD.runs(spark, SF_ORACLE)
    tables = R.report_tables(runs)
    single = {
        "consistency_report": R.consistency_report(runs),
        "summary_statistics": R.summary_statistics(runs),
        "main_results": R.main_results(runs),
        "main_summary": R.main_summary(runs),
        "param_sensitivity": R.sensitivity(runs),
        "overall_statistics": R.overall_statistics(runs),
    }
    for name, df in single.items():
        a = [tuple(r) for r in tables[name].collect()]
        b = [tuple(r) for r in df.collect()]
        assert tables[name].columns == df.columns, name
        assert a == b, name


def test_report_tables_single_scan(spark):
    from runlens.sources import testdata as TD
    from conftest import SF_SMALL

    t = R.report_tables(TD.runs(spark, SF_SMALL))["summary_statistics"]
    p = t._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") == 1 and "Expand" in p


def test_sensitivity_pooled_or_by_design(spark):
    rows = [(1, "main", "m", "P1", 0.0, 1.0, 80.0), (2, "main", "m", "P1", 0.0, 1.0, 60.0),
            (3, "sens", "m", "P1", 0.0, 1.0, 100.0), (4, "sens", "m", "P2", 0.1, 1.0, 50.0)]
    df = spark.createDataFrame(rows, "run_seq long, design string, model string, param_set string, "
                                     "temperature double, top_p double, format_compliance double")
    for c in S.DIM_COLS[1:]:
        df = df.withColumn(c, df.format_compliance)
    for c in ("input_tokens", "output_tokens"):
        df = df.withColumn(c, df.run_seq)
    df = df.withColumn("elapsed_time", df.format_compliance / 10)
    pooled = {(r.param_set): (r.n, r.format_compliance_mean) for r in R.sensitivity(df).collect()}
    assert pooled == {"P1": (3, 80.0), "P2": (1, 50.0)}
    split = {(r.design, r.param_set): r.n for r in R.sensitivity(df, by=["design"]).collect()}
    assert split == {("main", "P1"): 2, ("sens", "P1"): 1, ("sens", "P2"): 1}


def test_sheets_in_first_appearance_order(spark):
    from runlens.sources import testdata as TD
    from conftest import SF_SMALL

    runs = TD.runs(spark, SF_SMALL)
    first = {}
    for r in runs.select("run_seq", "model", "param_set").orderBy("run_seq").collect():
        first.setdefault(("model", r.model), r.run_seq)
        first.setdefault(("param_set", r.param_set), r.run_seq)
    expected = sorted({(r.model, r.param_set) for r in runs.select("model", "param_set").collect()},
                      key=lambda k: (first[("model", k[0])], first[("param_set", k[1])]))
    got = [(r.model, r.param_set) for r in R.sensitivity(runs).collect()]
    assert got == expected


def test_consistency_in_range_and_groups_cover_table(spark):
    from runlens.sources import testdata as TD
    from conftest import SF_ORACLE

    runs = TD.runs(spark, SF_ORACLE)
    total = runs.count()
    cons = R.consistency_scores(runs)
    agg = cons.selectExpr("min(consistency) AS lo", "max(consistency) AS hi", "sum(n) AS n").first()
    assert 0.0 <= agg.lo and agg.hi <= 100.0 and agg.n == total
    for name, t in R.report_tables(runs).items():
        if "n" in t.columns and name in ("main_summary", "param_sensitivity", "overall_statistics"):
            expect = runs.where("param_set = 'P1'").count() if name == "main_summary" else total
            assert t.selectExpr("sum(n)").first()[0] == expect, name


def test_orthogonal_report_tables_equal_single_reports(spark):
    import __spark_entry__ as E
    from runlens.plans import design as D
    from conftest import SF_ORACLE

    from runlens.sources import testdata as TD

    oruns = TD.orthogonal_runs(spark, SF_ORACLE)
    t = R.orthogonal_report_tables(oruns, D.orthogonal_designs())
    q = E.queries()
    pairs = {"group_statistics": "a8_group_stats", "composite_by_config": "a10_composite_by_config",
             "temperature_effect": "a12_temperature_effect", "scheme_effect": "a12_scheme_effect",
             "model_effect": "a12_model_effect", "interaction": "a12_interaction"}
    for name, key in pairs.items():
        single = q[key](spark, SF_ORACLE)
        assert t[name].columns == single.columns, name
        assert [tuple(r) for r in t[name].collect()] == [tuple(r) for r in single.collect()], name
    fresh = R.orthogonal_report_tables(oruns, D.orthogonal_designs())["scheme_effect"]
    p = fresh._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") == 1 and "Expand" in p


def test_best_vs_baseline_reproduces_published_table(spark):
    import __spark_entry__ as E

    means = [93.50, 100.00, 96.67, 92.07, 92.17, 99.00]        # best configuration, as printed
    stds = [7.56, 0.00, 3.30, 3.19, 2.32, 2.75]
    comp = sum(m * S.DIM_WEIGHTS[d] for d, m in zip(S.DIM_COLS, means))
    cols = {f"{d}_mean": m for d, m in zip(S.DIM_COLS, means)}
    cols.update({f"{d}_std": v for d, v in zip(S.DIM_COLS, stds)})
    cols.update({"composite_mean": round(comp, 2), "composite_std": 2.25})
    best = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} double" for k in cols))
    got = {r.dimension: r.diff for r in R.best_vs_baseline(best, E._baseline(spark, "published")).collect()}
    assert got == {"format_compliance": -6.5, "entry_correspondence": 0.0, "requirement_coverage": 0.2,
                   "item_validity": -0.9, "description_quality": -0.3, "no_hallucination": -1.0,
                   "composite": -2.2}
    assert round(comp, 2) == 94.83 and abs(comp - 94.827) < 1e-9
