"""Reports against pandas semantics computed directly on the same runs
(sample std with ddof=1, numpy-style DataFrame.round, Python round, first
row by arrival order) -- an oracle independent of the SQL restatements."""

import math

import pandas as pd
import pytest

from runlens import schemas as S
from runlens.operators import reports as R
from runlens.sources import testdata as TD

from conftest import SF_ORACLE

DIMS = S.DIM_COLS
KEYS4 = ["scene_name", "model", "scheme", "param_set"]


@pytest.fixture(scope="module")
def runs(spark):
    return TD.runs(spark, SF_ORACLE)


@pytest.fixture(scope="module")
def pdf(runs):
    return runs.toPandas().sort_values("run_seq").reset_index(drop=True)


def _close(a, b, tol=0.0):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return abs(a - b) <= tol


def test_summary_statistics_matches_pandas(runs, pdf):
    cols = DIMS + ["input_tokens", "output_tokens", "elapsed_time"]
    exp = pdf.groupby(KEYS4).agg({c: ["mean", "std"] for c in cols}).round(2)
    got = {tuple(r[k] for k in KEYS4): r for r in R.summary_statistics(runs).collect()}
    assert len(got) == len(exp)
    mism = []
    for key, row in exp.iterrows():
        g = got[key]
        for c in cols:
            # elapsed_time: pandas sums floats, runlens sums exact decimals; they
            # may differ by one unit at a rounding tie of the mean
            tol = 0.0100001 if c == "elapsed_time" else 0.0
            if not _close(g[f"{c}_mean"], row[(c, "mean")], tol) or not _close(g[f"{c}_std"], row[(c, "std")], tol):
                mism.append((key, c))
    assert not mism, mism[:5]


def test_main_summary_matches_python_rounding(runs, pdf):
    p1 = pdf[pdf.param_set == "P1"]
    got = {tuple(r[k] for k in R.MAIN_KEYS): r for r in R.main_summary(runs).collect()}
    for key, sub in p1.groupby(R.MAIN_KEYS):
        g = got[key]
        assert g.n == len(sub)
        first = sub.iloc[0]  # a failed first run has no temperature
        assert (g.temperature, g.top_p) == tuple(None if pd.isna(first[c]) else first[c] for c in ("temperature", "top_p"))
        for d in DIMS:
            assert g[f"{d}_mean"] == round(sub[d].mean(), 1)
            assert g[f"{d}_std"] == round(sub[d].std(), 1)
        assert g.input_tokens_mean == round(sub["input_tokens"].mean())
        assert g.output_tokens_mean == round(sub["output_tokens"].mean())


def test_consistency_matches_formula(runs, pdf):
    got = {tuple(r[k] for k in KEYS4): r for r in R.consistency_report(runs).collect()}
    n_checked = 0
    for key, grp in pdf.groupby(KEYS4):
        if len(grp) < 2:
            assert key not in got
            continue
        scores = []
        for d in DIMS:
            vals = grp[d].tolist()
            mean = sum(vals) / len(vals)
            sd = (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5
            cv = sd / mean * 100 if mean > 0 else 0
            scores.append(100 - min(cv, 100))
        g = got[key]
        assert g.consistency == round(sum(scores) / len(scores), 1)
        for d in DIMS:
            vals = grp[d]
            assert g[f"{d}_mean"] == round(sum(vals) / len(vals), 1)
            assert g[f"{d}_std"] == round(vals.std(), 1)
            exp_cv = round(vals.std() / (sum(vals) / len(vals)) * 100, 1) if sum(vals) > 0 else 0
            assert g[f"{d}_cv"] == exp_cv
        n_checked += 1
    assert n_checked == len(got)


def test_overall_statistics_matches_pandas(runs, pdf):
    got = {tuple(r[k] for k in R.OVERALL_KEYS): r for r in R.overall_statistics(runs).collect()}
    for key, sub in pdf.groupby(R.OVERALL_KEYS):
        g = got[key]
        assert g.n == len(sub)
        assert g.input_tokens_sum == sub["input_tokens"].sum()
        assert abs(g.elapsed_time_sum - round(sub["elapsed_time"].sum(), 1)) <= 0.1000001
        for d in DIMS:
            assert g[f"{d}_mean"] == round(sub[d].mean(), 1)
            assert g[f"{d}_max"] == round(sub[d].max(), 1) and g[f"{d}_min"] == round(sub[d].min(), 1)


@pytest.fixture(scope="module")
def oruns(spark):
    return TD.orthogonal_runs(spark, SF_ORACLE)


def test_group_statistics_matches_pandas(oruns):
    pdf = oruns.toPandas().sort_values("run_seq")
    got = {(r.group_id, r.model): r for r in R.group_statistics(oruns).collect()}
    for (g, m), sub in pdf.groupby(["group_id", "model"]):
        means = sub[DIMS].mean()
        r = got[(g, m)]
        assert r.n == len(sub)
        assert math.isclose(r.mean_score, means.mean(), rel_tol=1e-12)
        assert math.isclose(r.std_score, means.std(), rel_tol=1e-9)


def test_composite_by_config_matches_pandas(oruns):
    from runlens.plans import design as D

    g4 = next(d for d in D.orthogonal_designs() if d.name == "group4")
    cfg = {(c["model_key"], c["scheme_key"], c["temperature"]) for c in D.configurations(g4)}
    pdf = oruns.toPandas()
    pdf = pdf[(pdf.group_id == "group4") & pdf.apply(lambda r: (r.model_key, r.scheme_key, r.temperature) in cfg,
                                                      axis=1)].copy()
    pdf["composite"] = sum(pdf[c] * w for c, _, w in S.DIMENSIONS)
    keys = ["model", "scheme", "temperature"]
    got = {tuple(r[k] for k in keys): r for r in R.factor_effect(oruns, D.configurations(g4), keys).collect()}
    assert len(got) == 6
    for key, sub in pdf.groupby(keys):
        r = got[key]
        assert r.n == len(sub)
        assert abs(r.composite_mean - round(sub["composite"].mean(), 2)) <= 0.0100001
        assert abs(r.composite_std - round(sub["composite"].std(), 2)) <= 0.0100001
