"""Report tables over a run table.

Every report is one ``groupBy`` on a few low-cardinality keys: Spark computes
partial aggregates map-side, so a key holding a third of all runs costs no
more than any other, and only (#groups x #partitions) partial rows cross the
shuffle.  Reports read a narrow projection (never ``output_content``), which
Catalyst pushes down to the scan.

Numeric rules follow the reports being re-created:

* failed runs carry zero scores and stay in every average;
* report standard deviations are the sample one (ddof=1), the consistency
  score uses the population one;
* pandas-style tables (summary, main results) round with ``np_round``,
  the hand-built tables (consistency, main summary, sensitivity, overall)
  with Python's ``round`` (``py_round``);
* fractional seconds are summed exactly (``DECIMAL``, to the nanosecond) so
  sums and means do not depend on partitioning;
* groups whose key is NULL are dropped and rows come out sorted by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions.metrics import (
    composite_score, consistency_from_moments, np_round, py_round,
)
from runlens.operators.ranking import first_by, seq_rank

DIMS = S.DIM_COLS
TOKENS = ["input_tokens", "output_tokens"]
TIME_COL = "elapsed_time"
TIME_DECIMAL = "decimal(38,9)"  # seconds to the nanosecond: sums are exact in any order

GROUP4_KEYS = ["scene_name", "model", "scheme", "param_set"]
MAIN_KEYS = ["scene_name", "model", "scheme"]


def _nonnull(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def _mean(c: str) -> Column:
    """Mean with NULLs skipped; exact for fractional seconds."""
    if c == TIME_COL:
        return F.sum(F.col(c).cast(TIME_DECIMAL)).cast("double") / F.count(c)
    return F.sum(F.col(c).cast("double")) / F.count(c)


def _std(c: str) -> Column:
    return F.stddev_samp(F.col(c).cast("double"))


# ---------------------------------------------------------------------------
# Raw aggregates shared by the exploratory reports.  Each report names the raw
# aggregates it needs and finishes them with a projection; ``report_tables``
# computes the union once over grouping sets.

def _raw(name: str) -> Column:
    """One raw aggregate by its internal name (``__<kind>_<column>``)."""
    if name == "__n":
        return F.count(F.lit(1))
    if name == "__first_temperature":
        return first_by("temperature", "run_seq")
    if name == "__first_top_p":
        return first_by("top_p", "run_seq")
    if name == "__first_seq":
        return F.min("run_seq")
    kind, c = name[2:].split("_", 1)
    if kind == "s":
        return F.sum(c)
    if kind == "m":
        return _mean(c)
    if kind == "sd":
        return _std(c)
    if kind == "sp":
        return F.stddev_pop(F.col(c).cast("double"))
    if kind == "max":
        return F.max(c)
    if kind == "min":
        return F.min(c)
    if kind == "tot":
        return (F.sum(F.col(c).cast(TIME_DECIMAL)) if c == TIME_COL else F.sum(c))
    raise KeyError(name)


def _aggregate(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return _nonnull(df, keys).groupBy(*keys).agg(*[_raw(n).alias(n) for n in names])


_CONSISTENCY_RAW = ["__n", *[f"__{k}_{d}" for d in DIMS for k in ("s", "m", "sd", "sp")]]


def _consistency_finish(g: DataFrame, keys: list[str]) -> DataFrame:
    g = g.where(F.col("__n") > 1)
    cons = consistency_from_moments(F.col("__n"), [F.col(f"__m_{d}") for d in DIMS],
                                    [F.col(f"__sp_{d}") for d in DIMS])
    raw = [*keys, "__n", cons.alias("__cons")]
    for d in DIMS:
        m, sd, s = F.col(f"__m_{d}"), F.col(f"__sd_{d}"), F.col(f"__s_{d}")
        raw += [m, sd, F.when(s > 0, sd / m * 100.0).alias(f"__cv_{d}")]
    # rounding reads plain columns of a separate projection (small generated code)
    cols = [*keys, F.col("__n").alias("n"), py_round("__cons", 1).alias("consistency")]
    for d in DIMS:
        cols += [py_round(f"__m_{d}", 1).alias(f"{d}_mean"), py_round(f"__sd_{d}", 1).alias(f"{d}_std"),
                 F.coalesce(py_round(f"__cv_{d}", 1), F.lit(0.0)).alias(f"{d}_cv")]
    return g.select(*raw).select(*cols).orderBy(*keys)


def consistency_report(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1 + A2: consistency of repeated runs per configuration (groups of n > 1).

    Columns: keys, n, consistency, and per dimension ``<d>_mean``,
    ``<d>_std`` (sample), ``<d>_cv`` (sample std / mean * 100, 0 when the
    dimension sums to 0), all rounded to 1 decimal.
    """
    keys = keys or GROUP4_KEYS
    return _consistency_finish(_aggregate(runs, keys, _CONSISTENCY_RAW), keys)


def consistency_scores(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1 alone, for every group (100 for groups of one run), 1 decimal."""
    keys = keys or GROUP4_KEYS
    g = _aggregate(runs, keys, ["__n", *[f"__{k}_{d}" for d in DIMS for k in ("m", "sp")]])
    cons = consistency_from_moments(F.col("__n"), [F.col(f"__m_{d}") for d in DIMS],
                                    [F.col(f"__sp_{d}") for d in DIMS])
    return g.select(*keys, F.col("__n").alias("n"), cons.alias("__cons")).select(
        *keys, "n", py_round("__cons", 1).alias("consistency")).orderBy(*keys)


_SUMMARY_COLS = DIMS + TOKENS + [TIME_COL]
_SUMMARY_RAW = [f"__{k}_{c}" for c in _SUMMARY_COLS for k in ("m", "sd")]


def _summary_finish(g: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    cols = []
    for c in _SUMMARY_COLS:
        cols += [np_round(f"__m_{c}", digits).alias(f"{c}_mean"), np_round(f"__sd_{c}", digits).alias(f"{c}_std")]
    return g.select(*keys, *cols).orderBy(*keys)


def summary_statistics(runs: DataFrame, keys: list[str] | None = None, digits: int = 2) -> DataFrame:
    """A3: mean and sample std of the dimensions, tokens and time per configuration."""
    keys = keys or GROUP4_KEYS
    return _summary_finish(_aggregate(runs, keys, _SUMMARY_RAW), keys, digits)


_MAIN_RAW = [f"__{k}_{d}" for d in DIMS for k in ("m", "sd")] + [f"__m_{c}" for c in TOKENS + [TIME_COL]]


def _main_finish(g: DataFrame, digits: int = 2) -> DataFrame:
    cols = []
    for d in DIMS:
        cols += [np_round(f"__m_{d}", digits).alias(f"{d}_mean"), np_round(f"__sd_{d}", digits).alias(f"{d}_std")]
    cols += [np_round(f"__m_{c}", digits).alias(f"{c}_mean") for c in TOKENS + [TIME_COL]]
    return g.select(*MAIN_KEYS, *cols).orderBy(*MAIN_KEYS)


def main_results(runs: DataFrame, param_set: str = "P1", digits: int = 2) -> DataFrame:
    """A4: main-experiment rows (one parameter set) by scene, model, scheme."""
    return _main_finish(_aggregate(runs.where(F.col("param_set") == param_set), MAIN_KEYS, _MAIN_RAW), digits)


def _appearance_order(g: DataFrame, keys: list[str]) -> list[Column]:
    """F10 order for nested loops over ``unique()`` values: each key value
    ranks by the earliest run carrying it.  Window minima over the small
    aggregated table (one row per group), not over the runs."""
    return [F.min("__first_seq").over(Window.partitionBy(k)) for k in keys] + [F.col(k) for k in keys]


_SHEET_RAW = (["__first_temperature", "__first_top_p", "__n", "__first_seq"]
              + [f"__{k}_{d}" for d in DIMS for k in ("m", "sd")]
              + [f"__m_{c}" for c in TOKENS + [TIME_COL]])


def _sheet_finish(g: DataFrame, keys: list[str]) -> DataFrame:
    cols = [F.col("__first_temperature").alias("temperature"), F.col("__first_top_p").alias("top_p"),
            F.col("__n").alias("n")]
    for d in DIMS:
        cols += [py_round(f"__m_{d}", 1).alias(f"{d}_mean"), py_round(f"__sd_{d}", 1).alias(f"{d}_std")]
    cols += [py_round(f"__m_{c}", 0).cast("bigint").alias(f"{c}_mean") for c in TOKENS]
    cols.append(py_round(f"__m_{TIME_COL}", 1).alias(f"{TIME_COL}_mean"))
    order = [c.alias(f"__o{i}") for i, c in enumerate(_appearance_order(g, keys))]
    out = g.select(*keys, *cols, *order)
    return out.orderBy(*[f"__o{i}" for i in range(len(order))]).drop(*[f"__o{i}" for i in range(len(order))])


def main_summary(runs: DataFrame, param_set: str = "P1", by: list[str] | None = None) -> DataFrame:
    """A5: main-experiment sheet -- first temperature/top_p, n, dims 1 dp,
    tokens 0 dp, time 1 dp -- by scene, model, scheme, in first-appearance
    order of scene, then model, then scheme (the experiment's loop order).

    ``by=["design"]`` separates designs that share the parameter set (the
    main and sensitivity designs both run P1); the default pools them, as the
    experiment's sheet does.
    """
    keys = [*(by or []), *MAIN_KEYS]
    return _sheet_finish(_aggregate(runs.where(F.col("param_set") == param_set), keys, _SHEET_RAW), keys)


SENSITIVITY_KEYS = ["model", "param_set"]


def sensitivity(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parameter sensitivity by model and parameter set (all rows).

    By default the P1 row pools every P1 run (main and sensitivity designs,
    all scenes and schemes) as the experiment's sheet does; ``by=["design"]``
    keeps designs apart when the run table carries a ``design`` column.
    """
    keys = [*(by or []), *SENSITIVITY_KEYS]
    return _sheet_finish(_aggregate(runs, keys, _SHEET_RAW), keys)


OVERALL_KEYS = ["model", "scene_name", "scheme"]
_OVERALL_RAW = (["__n", "__first_seq", *[f"__tot_{c}" for c in TOKENS + [TIME_COL]]]
                + [f"__{k}_{d}" for d in DIMS for k in ("m", "max", "min")])


def _overall_finish(g: DataFrame) -> DataFrame:
    cols = [F.col("__n").alias("n"), *[F.col(f"__tot_{c}").alias(f"{c}_sum") for c in TOKENS],
            F.bround(f"__tot_{TIME_COL}", 1).cast("double").alias(f"{TIME_COL}_sum")]
    for d in DIMS:
        cols += [py_round(f"__m_{d}", 1).alias(f"{d}_mean"), py_round(f"__max_{d}", 1).alias(f"{d}_max"),
                 py_round(f"__min_{d}", 1).alias(f"{d}_min")]
    order = [c.alias(f"__o{i}") for i, c in enumerate(_appearance_order(g, OVERALL_KEYS))]
    out = g.select(*OVERALL_KEYS, *cols, *order)
    return out.orderBy(*[f"__o{i}" for i in range(len(order))]).drop(*[f"__o{i}" for i in range(len(order))])


def overall_statistics(runs: DataFrame) -> DataFrame:
    """Totals and per-dimension mean / max / min by model, scene, scheme."""
    return _overall_finish(_aggregate(runs, OVERALL_KEYS, _OVERALL_RAW))


def report_tables(runs: DataFrame, param_set: str = "P1", materialise=None) -> dict[str, DataFrame]:
    """A2-A7 from ONE aggregation over grouping sets.

    One scan of the run table; Spark expands each row once per grouping set
    map-side, aggregates partially and shuffles only partial aggregates.  The
    result has one row per (grouping set, group) -- a few hundred rows for
    any number of runs -- and every report is a projection of it.
    ``materialise`` (e.g. a reliable checkpoint) is applied to that grouped
    result once, so writing all six tables does not re-run the aggregation.
    """
    base = runs.withColumn("__p1", F.col("param_set") == param_set)
    sets = {
        "config": ["scene_name", "model", "scheme", "param_set"],
        "main": ["scene_name", "model", "scheme", "__p1"],
        "overall": ["scene_name", "model", "scheme"],
        "sensitivity": ["model", "param_set"],
    }
    all_keys = ["scene_name", "model", "scheme", "param_set", "__p1"]
    raw = list(dict.fromkeys(_CONSISTENCY_RAW + _SUMMARY_RAW + _MAIN_RAW + _SHEET_RAW + _OVERALL_RAW))
    g = (base.groupingSets([[F.col(k) for k in ks] for ks in sets.values()], *all_keys)
         .agg(F.grouping_id(*all_keys).alias("__gid"), *[_raw(n).alias(n) for n in raw]))
    if materialise is not None:
        g = materialise(g)

    def gid(ks):
        return sum(1 << (len(all_keys) - 1 - i) for i, k in enumerate(all_keys) if k not in ks)

    def part(name, extra=None):
        ks = sets[name]
        t = g.where(F.col("__gid") == gid(ks))
        t = _nonnull(t, [k for k in ks if k != "__p1"])
        return t.where(extra) if extra is not None else t

    cfg = part("config")
    main = part("main", F.col("__p1"))
    return {
        "consistency_report": _consistency_finish(cfg, GROUP4_KEYS),
        "summary_statistics": _summary_finish(cfg, GROUP4_KEYS),
        "main_results": _main_finish(main),
        "main_summary": _sheet_finish(main, MAIN_KEYS),
        "param_sensitivity": _sheet_finish(part("sensitivity"), SENSITIVITY_KEYS),
        "overall_statistics": _overall_finish(part("overall")),
    }


def group_statistics(runs: DataFrame) -> DataFrame:
    """Per (group, model) -- n, mean of the six dimension means
    (unweighted) and the sample std *across those six means*.

    Closed form over the six aggregate columns: no unpivot, no second
    shuffle.
    """
    keys = ["group_id", "model"]
    g = _nonnull(runs, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("run_seq").alias("__first_seq"),
        *[_mean(d).alias(f"__m_{d}") for d in DIMS])
    return _group_finish(g, "__m_", "")


def _group_finish(g: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Mean of the six dimension means and their sample std; groups in
    first-appearance order, models in first appearance within the group."""
    ms = [F.col(f"{prefix}{d}{suffix}") for d in DIMS]
    total = ms[0]
    for m in ms[1:]:
        total = total + m
    mean = total / float(len(ms))
    sq = None
    for m in ms:
        t = (m - mean) * (m - mean)
        sq = t if sq is None else sq + t
    o1 = F.min("__first_seq").over(Window.partitionBy("group_id"))
    out = g.select("group_id", "model", "n", mean.alias("mean_score"), F.sqrt(sq / float(len(ms) - 1)).alias("std_score"),
                   o1.alias("__o1"), F.col("__first_seq").alias("__o2"))
    return out.orderBy("__o1", "__o2").drop("__o1", "__o2")


def with_composite(runs: DataFrame, name: str = "composite", weights: dict | None = None) -> DataFrame:
    """Weighted composite score per run."""
    return runs.withColumn(name, composite_score(weights=weights))


def _config_aggs() -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_samp("__c").alias("__csd")]
    for d in DIMS:
        aggs += [_mean(d).alias(f"{d}_mean"), _std(d).alias(f"{d}_std")]
    return aggs


def _composite_of_means(prefix: str = "", suffix: str = "_mean", weights: dict | None = None) -> Column:
    """The weighted composite of the dimension means, in dimension order."""
    comp = None
    for d in DIMS:
        t = F.col(f"{prefix}{d}{suffix}") * float((weights or S.DIM_WEIGHTS)[d])
        comp = t if comp is None else comp + t
    return comp


def _config_finish(g: DataFrame, keys: list[str], digits: int = 2, weights: dict | None = None) -> DataFrame:
    comp = _composite_of_means(weights=weights)
    cols = [*keys, "n", py_round(comp, digits).alias("composite_mean"),
            py_round(F.col("__csd"), digits).alias("composite_std")]
    for d in DIMS:
        cols += [py_round(F.col(f"{d}_mean"), digits).alias(f"{d}_mean"),
                 py_round(F.col(f"{d}_std"), digits).alias(f"{d}_std")]
    return g.select(*cols)


def composite_by_config(runs: DataFrame, keys: list[str], digits: int = 2, weights: dict | None = None) -> DataFrame:
    """A10: composite mean +- sample std per configuration, with dimension
    means and stds.  The mean composite is the composite of the dimension
    means (equal to the mean of run composites, but from exact sums)."""
    g = _nonnull(with_composite(runs, "__c", weights), keys).groupBy(*keys).agg(*_config_aggs())
    return _config_finish(g, keys, digits, weights)


def best_configuration(runs: DataFrame, keys: list[str], digits: int = 2, weights: dict | None = None) -> DataFrame:
    """A11 + N5: the configuration with the highest mean composite (ties by
    keys), ranked by the mean before it is rounded.  Top-1 of the small
    per-configuration table."""
    g = _nonnull(with_composite(runs, "__c", weights), keys).groupBy(*keys).agg(*_config_aggs())
    best = g.orderBy(_composite_of_means(weights=weights).desc(), *keys).limit(1)
    return _config_finish(best, keys, digits, weights)


def best_vs_baseline(best: DataFrame, baseline: DataFrame) -> DataFrame:
    """J8 + T24: unpivot the best configuration's dimension means/stds, join
    the manual baseline on the dimension, difference to 1 decimal.

    ``baseline(dimension, manual)``; a ``composite`` row compares the
    weighted composites of both sides.
    """
    stack = ", ".join(f"'{d}', {d}_mean, {d}_std" for d in DIMS)
    long = best.selectExpr(f"stack({len(DIMS)}, {stack}) AS (dimension, best_mean, best_std)")
    comp = best.select(F.lit("composite").alias("dimension"),
                       F.col("composite_mean").alias("best_mean"),
                       F.col("composite_std").alias("best_std"))
    j = long.unionByName(comp).join(baseline, "dimension")
    return j.select("dimension", "manual", "best_mean", "best_std",
                    py_round(F.col("best_mean") - F.col("manual"), 1).alias("diff"))


def restrict(runs: DataFrame, configs) -> DataFrame:
    """Rows of a design group's configurations: a filter when the
    configurations are a short driver-side list, else a left-semi join (Spark
    broadcasts the configurations where their size allows)."""
    if isinstance(configs, list):
        from runlens.plans.design import MAX_FILTER_CONFIGURATIONS, config_filter

        if len(configs) <= MAX_FILTER_CONFIGURATIONS:
            return runs.where(config_filter(configs))
        configs = configuration_frame(runs.sparkSession, configs)
    on = [c for c in configs.columns if c in runs.columns]
    return runs.join(configs.select(*on).distinct(), on, "left_semi")


def configuration_frame(spark, configs: list[dict]) -> DataFrame:
    """A list of configurations (see ``plans.design.configurations``) as rows."""
    types = {"temperature": "double"}
    cols = list(dict.fromkeys(k for c in configs for k in c))
    return spark.createDataFrame([[c.get(k) for k in cols] for c in configs],
                                 ", ".join(f"{k} {types.get(k, 'string')}" for k in cols))


def factor_effect(runs: DataFrame, configs, keys: list[str], digits: int = 2, weights: dict | None = None) -> DataFrame:
    """Restrict runs to a design group's configurations, then composite
    and dimension statistics by the varied factor."""
    return composite_by_config(restrict(runs, configs), keys, digits, weights).orderBy(*keys)


def interaction_table(runs: DataFrame, configs, row_key: str, pivot_key: str,
                      pivot_values: list[str], digits: int = 2) -> DataFrame:
    """A12 (group 4): composite mean in a ``row_key`` x ``pivot_key`` grid.

    Pivot values are passed explicitly, so no extra job collects them.
    """
    sel = restrict(runs, configs)
    # cell value = composite of the cell's dimension means (exact sums, so
    # the result does not depend on how rows are partitioned)
    p = (sel.groupBy(row_key).pivot(pivot_key, pivot_values)
         .agg(*[_mean(d).alias(d) for d in DIMS]))
    cells = []
    for v in pivot_values:
        comp = _composite_of_means(f"{v}_", "")
        cells.append(py_round(comp, digits).alias(f"{v}_composite"))
    return p.select(row_key, *cells).orderBy(row_key)


def with_repeat_idx(runs: DataFrame, keys: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """Repeat number of each run within its configuration (by ``run_seq``)."""
    keys = keys or ["scene_id", "model", "scheme", "param_set"]
    kw = {} if chunk is None else {"chunk": chunk}
    return seq_rank(runs, keys, "run_seq", "repeat_idx", **kw)


DETAIL_COLUMNS = ["scene_name", "model", "scheme", "param_set", "temperature", "top_p",
                  "repeat_idx", "input_tokens", "output_tokens", "elapsed_time", *DIMS,
                  *[f"{d}_note" for d in DIMS]]


def detail(runs: DataFrame) -> DataFrame:
    """the detail sheet -- the detail columns that exist, in order."""
    return runs.select(*[c for c in DETAIL_COLUMNS if c in runs.columns])


def sheet_name(c) -> Column:
    """A sheet name -- the first 20 characters with ``/`` replaced."""
    col = F.col(c) if isinstance(c, str) else c
    return F.replace(F.substring(col, 1, 20), F.lit("/"), F.lit("_"))


def scene_sheets(runs: DataFrame) -> DataFrame:
    """W8 + T14 + F3: one sheet per scene -- its name, row count and the first
    run, in first-appearance order."""
    g = (runs.where(F.col("scene_name").isNotNull()).groupBy("scene_name")
         .agg(F.count(F.lit(1)).alias("n"), F.min("run_seq").alias("first_run_seq")))
    return g.select(sheet_name("scene_name").alias("sheet_name"), "scene_name", "n",
                    "first_run_seq").orderBy("first_run_seq")


def first_appearance(runs: DataFrame, cols: list[str]) -> DataFrame:
    """distinct values of each column with their first ``run_seq`` and
    1-based first-appearance position.

    One scan: each run is unpivoted into (column, value) pairs map-side and
    a single aggregation keeps the earliest ``run_seq`` per pair; the ranking
    runs on that small aggregate.
    """
    pairs = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in cols)
    long = runs.selectExpr("run_seq", f"stack({len(cols)}, {pairs}) AS (column_name, value)")
    u = (long.where(F.col("value").isNotNull()).groupBy("column_name", "value")
         .agg(F.min("run_seq").alias("first_run_seq")))
    w = Window.partitionBy("column_name").orderBy("first_run_seq")
    return u.select("column_name", "value", "first_run_seq", F.row_number().over(w).cast("bigint").alias("position"))


def orthogonal_report_tables(runs: DataFrame, designs, materialise=None, digits: int = 2) -> dict[str, DataFrame]:
    """A8, A10 and A12 from ONE grouping-sets aggregation over the runs.

    Each design group fixes every factor but the one it varies, so every
    factor table is the finest grouping (group, model, scheme, temperature)
    restricted to that group's configurations; the group statistics (A8)
    group all rows by (group, model).  One scan, partial aggregates shuffled;
    ``materialise`` (e.g. a checkpoint) is applied to the small grouped result.
    """
    from runlens.plans.design import MAX_FILTER_CONFIGURATIONS, config_filter, configurations

    cfgs = [c for d in designs if d.enabled for c in configurations(d)]
    base = with_composite(runs, "__c")
    if len(cfgs) <= MAX_FILTER_CONFIGURATIONS:
        base = base.withColumn("__in_cfg", F.coalesce(config_filter(cfgs), F.lit(False)))
    else:
        named = configuration_frame(runs.sparkSession, cfgs).distinct().withColumn("__in_cfg", F.lit(True))
        base = base.join(named, [c for c in named.columns if c != "__in_cfg"], "left").fillna(False, subset=["__in_cfg"])
    fine = ["group_id", "model_key", "model", "scheme", "temperature", "__in_cfg"]
    all_keys = fine
    g = (base.groupingSets([[F.col(k) for k in fine], [F.col("group_id"), F.col("model")]], *all_keys)
         .agg(F.grouping_id(*all_keys).alias("__gid"), *_config_aggs(),
              F.min("run_seq").alias("__first_seq")))
    if materialise is not None:
        g = materialise(g)
    fine_rows = g.where((F.col("__gid") == 0) & F.col("__in_cfg"))
    coarse_gid = sum(1 << (len(all_keys) - 1 - i) for i, k in enumerate(all_keys) if k not in ("group_id", "model"))
    coarse = _nonnull(g.where(F.col("__gid") == coarse_gid), ["group_id", "model"])

    a8 = _group_finish(coarse, "", "_mean")

    def table(group, keys):
        t = fine_rows.where(F.col("group_id") == group)
        return _config_finish(t, keys, digits).orderBy(*keys)

    g4 = fine_rows.where(F.col("group_id") == "group4")
    model_keys = sorted({c["model_key"] for c in cfgs})
    comp = _composite_of_means()
    inter = (g4.groupBy("scheme").pivot("model_key", model_keys).agg(F.first(comp))
             .select("scheme", *[py_round(F.col(m), digits).alias(f"{m}_composite") for m in model_keys])
             .orderBy("scheme"))
    return {
        "group_statistics": a8,
        "composite_by_config": table("group4", ["model", "scheme", "temperature"]),
        "temperature_effect": table("group1", ["model", "temperature"]),
        "scheme_effect": table("group2", ["model", "scheme"]),
        "model_effect": table("group3", ["scheme", "model"]),
        "interaction": inter,
    }
