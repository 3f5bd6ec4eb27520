"""DuckDB SQL text for the correctness oracle (used by ``__spark_entry__``).

The oracle re-states each query in plain SQL over the driver's views.  The
derived run tables use the same portable expressions as the Spark side
(``runlens.sources.testdata``); the rounding rules are spelled out in SQL
arithmetic here, independently of the Spark column code.
"""

from __future__ import annotations

from runlens import schemas as S
from runlens.functions import jsoncheck as JC
from runlens.sources import testdata as TD

DIMS = S.DIM_COLS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else
                                        ("NULL" if v is None else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v))
                                        for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def pyr(x: str, k: int) -> str:
    """Python round(x, k) on the exact double value (Dekker error-free product)."""
    t = dbl(10 ** k)
    p = f"(({x}) * {t})"
    xs = f"(({x}) * {dbl(134217729.0)})"
    hi = f"({xs} - ({xs} - ({x})))"
    err = f"(({hi} * {t} - {p}) + (({x}) - {hi}) * {t})"
    f = f"floor({p})"
    return (f"(CASE WHEN {p} - {f} = 0.5 THEN (CASE WHEN {err} > 0 THEN {f} + 1 "
            f"WHEN {err} < 0 THEN {f} ELSE round_even({p}, 0) END) "
            f"ELSE round_even({p}, 0) END / {t})")


def npr(x: str, k: int) -> str:
    """numpy round: round-half-even of x * 10^k, scaled back."""
    t = dbl(10 ** k)
    return f"(round_even(({x}) * {t}, 0) / {t})"


def mean(c: str) -> str:
    if c == "elapsed_time":
        return f"(CAST(SUM(CAST({c} AS DECIMAL(38,9))) AS DOUBLE) / COUNT({c}))"
    return f"(SUM(CAST({c} AS DOUBLE)) / COUNT({c}))"


def std(c: str) -> str:
    return f"stddev_samp(CAST({c} AS DOUBLE))"


def dims_ctes(orthogonal: bool = False) -> str:
    models = S.MODELS_ORTHOGONAL if orthogonal else S.MODELS
    psets = S.PARAM_SETS_ORTHOGONAL if orthogonal else S.PARAM_SETS
    return (
        f"dim_scene AS {values(S.SCENES, ['scene_id', 'scene_name'])},\n"
        f"dim_scheme AS {values(S.SCHEMES, ['scheme_key', 'scheme'])},\n"
        f"dim_model AS {values([(m[0], m[1]) for m in models], ['model_key', 'model'])},\n"
        f"dim_param AS {values(psets, ['param_set', 'temperature', 'top_p'])}"
    )


def failed_rule(name: str, expr: str, orthogonal: bool) -> str:
    """What a failed run records: scores 0; exploratory: tokens and time 0, no
    temperature, no top_p; orthogonal: no tokens, time and top_p."""
    if name in DIMS or (not orthogonal and name in ("input_tokens", "output_tokens", "elapsed_time")):
        return f"CASE WHEN success THEN {expr} ELSE 0 END"
    if name == "top_p" or (not orthogonal and name == "temperature"):
        return f"CASE WHEN success THEN {expr} END"
    return expr


def runs_cte(orthogonal: bool = False) -> str:
    base = [(n, e) for n, e in TD.RUN_BASE]
    if orthogonal:
        base = [(n, TD.ORTHOGONAL_PARAM_SET if n == "param_set" else e) for n, e in base]
    base_sel = ",\n    ".join(f"{e} AS {n}" for n, e in base)
    final_sel = ",\n    ".join(f"{failed_rule(n, e, orthogonal)} AS {n}" for n, e in TD.RUN_FINAL)
    return (
        f"WITH base AS (SELECT\n    {base_sel}\n  FROM events),\n"
        f"{dims_ctes(orthogonal)},\n"
        "runs AS (SELECT\n    " + final_sel + "\n  FROM base JOIN dim_scene USING (scene_id) "
        "JOIN dim_scheme USING (scheme_key) JOIN dim_model USING (model_key) "
        "JOIN dim_param USING (param_set))\n"
    )


def with_repeat(cte_name: str, src: str, keys: str) -> str:
    return (f"{cte_name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY run_seq) "
            f"AS INTEGER) AS repeat_idx FROM {src})\n")


def composite_expr(prefix: str = "", suffix: str = "") -> str:
    acc = None
    for d, _, w in S.DIMENSIONS:
        t = f"({prefix}{d}{suffix} * {dbl(w)})"
        acc = t if acc is None else f"({acc} + {t})"
    return acc


def plan_rows_python(kind: str) -> list[tuple]:
    """The plan by the experiment's own nested loops (independent of Spark)."""
    rows = []
    pos = 0
    if kind == "exploratory":
        m, s = S.MAIN_DESIGN, S.SENSITIVITY_DESIGN
        ps = {p: (t, tp) for p, t, tp in S.PARAM_SETS}
        for model in m["models"]:
            for scene in m["scenes"]:
                for scheme in m["schemes"]:
                    for r in range(S.REPEAT_TIMES):
                        pos += 1
                        rows.append(("main", scene, scheme, model, "P1", ps["P1"][0], ps["P1"][1], r + 1, pos,
                                     f"main_{scene}_{scheme}_{model}_P1_{r}"))
        for model in s["models"]:
            for scheme in s["schemes"]:
                for p in s["param_sets"]:
                    for r in range(S.REPEAT_TIMES):
                        pos += 1
                        rows.append(("sens", s["scene"], scheme, model, p, ps[p][0], ps[p][1], r + 1, pos,
                                     f"sens_{s['scene']}_{scheme}_{model}_{p}_{r}"))
        return rows
    names = {k: n for k, n, _, _ in S.MODELS_ORTHOGONAL}
    tset = {t: p for p, t, _ in S.PARAM_SETS_ORTHOGONAL}
    scene, n = S.ORTHOGONAL_SCENE, S.ORTHOGONAL_REPEATS

    counters = {}

    def add(g, scheme, model, temp):
        # each orthogonal group numbers its runs from 1
        for i in range(n):
            counters[g] = counters.get(g, 0) + 1
            pos = counters[g]
            rows.append((g, scene, scheme, model, tset[temp], float(temp), 1.0, i + 1, pos,
                         f"{g}_{scene}_{scheme}_T{float(temp)}_{names[model]}_{i + 1}"))
    for model in S.GROUP1["models"]:
        for t in S.GROUP1["temperatures"]:
            add("group1", S.GROUP1["scheme"], model, t)
    for g, cfg in (("group2", S.GROUP2), ("group3", S.GROUP3)):
        for model in cfg["models"]:
            for scheme in cfg["schemes"]:
                add(g, scheme, model, cfg["temperature"])
    for model, scheme, t in S.GROUP4:
        add("group4", scheme, model, t)
    return rows


PLAN_COLS = ["design", "scene_id", "scheme_key", "model_key", "param_set", "temperature", "top_p",
             "repeat_idx", "position", "run_key"]


def plan_cte(kind: str) -> str:
    return f"plan AS {values(plan_rows_python(kind), PLAN_COLS)}\n"


def outputs_cte(source: str | None = None) -> str:
    """Model outputs per run, normalised and parsed the reference way.

    ``source`` is a SELECT giving run_seq, scene_id, scheme_key, success,
    output_content; by default the outputs derived from ``events``.
    """
    from runlens.functions.text import PY_WHITESPACE

    ws = lit(PY_WHITESPACE)
    lines = "string_split(c1, chr(10))"
    src = source or (
        f"SELECT event_id AS run_seq, {dict(TD.RUN_BASE)['scene_id']} AS scene_id, "
        f"{dict(TD.RUN_BASE)['scheme_key']} AS scheme_key, event_id % 97 <> 0 AS success, "
        + "".join(f"{e} AS {n}, " for n, e in TD.OUTPUT_NUMBERS) +
        f"{TD.output_sql()} AS output_content FROM events")
    return (
        f"outs AS ({src}),\n"
        f"n1 AS (SELECT *, trim(output_content, {ws}) AS c1 FROM outs),\n"
        f"n2 AS (SELECT *, CASE WHEN starts_with(c1, '```') THEN (CASE WHEN starts_with({lines}[-1], '```') "
        f"THEN array_to_string(list_slice({lines}, 2, len({lines}) - 1), chr(10)) "
        f"ELSE array_to_string(list_slice({lines}, 2, len({lines})), chr(10)) END) ELSE c1 END AS c2 FROM n1),\n"
        f"n3 AS (SELECT *, trim(c2, {ws}) AS c3 FROM n2),\n"
        "n4 AS (SELECT *, CASE WHEN starts_with(c3, '[') THEN regexp_extract(c3, '\\[[\\s\\S]*\\]', 0) "
        "ELSE regexp_extract(c3, '\\{[\\s\\S]*\\}', 0) END AS span FROM n3),\n"
        "n5 AS (SELECT *, coalesce(span <> '' AND json_valid(span), false) AS json_valid FROM n4),\n"
        "parsed AS (SELECT *, CASE WHEN json_valid THEN span::JSON END AS j FROM n5)\n"
    )


def said(message: str, **parts: str) -> str:
    """SQL text of a fixed message with its places filled by SQL expressions."""
    import string

    out = []
    for literal, name, _, _ in string.Formatter().parse(message):
        if literal:
            out.append(lit(literal))
        if name:
            out.append(parts[name])
    return f"concat({', '.join(out)})"


def checks_cte() -> str:
    not_object = said(JC.ISSUE_NOT_OBJECT, i="i")
    shown = lambda a: f"array_to_string(list_slice({a}, 1, {JC.ISSUES_SHOWN}), {lit(JC.ISSUE_SEPARATOR)})"
    miss = ", ".join(
        f"CASE WHEN NOT json_exists(x, '$.{f}') THEN {said(JC.ISSUE_MISSING_FIELD, i='i', f=lit(f))} END"
        for f in ["name", "methods", "requirements", "criteria"])
    types = ", ".join(
        ["CASE WHEN json_exists(x, '$.name') AND json_type(x, '$.name') <> 'VARCHAR' "
         f"THEN {said(JC.ISSUE_NAME_NOT_STRING, i='i')} END"] +
        [f"CASE WHEN json_exists(x, '$.{f}') AND json_type(x, '$.{f}') <> 'ARRAY' "
         f"THEN {said(JC.ISSUE_NOT_ARRAY, i='i', f=lit(f))} END" for f in ["methods", "requirements", "criteria"]])
    allf = " AND ".join(f"json_exists(x, '$.{f}')" for f in ["name", "methods", "requirements", "criteria"])
    return (
        "c1x AS (SELECT *, coalesce(json_type(j) = 'OBJECT' AND json_exists(j, '$.test_items'), false) AS has_ti, "
        "json_type(j, '$.test_items') AS ti_type, "
        "coalesce(json_type(j) = 'ARRAY' AND json_array_length(j) > 0, false) AS root_list FROM parsed),\n"
        "c2x AS (SELECT *, CASE WHEN has_ti AND ti_type = 'ARRAY' THEN json_extract(j, '$.test_items[*]') "
        "WHEN NOT has_ti AND root_list THEN json_extract(j, '$[*]') END AS items, "
        "CASE WHEN has_ti AND ti_type = 'VARCHAR' THEN length(json_extract_string(j, '$.test_items')) "
        "WHEN has_ti AND ti_type = 'OBJECT' THEN len(json_keys(j, '$.test_items')) END AS n_other FROM c1x),\n"
        "c3x AS (SELECT *, coalesce(len(items) > 0, false) AS run_arr, "
        "coalesce(items IS NULL AND n_other > 0, false) AS run_other FROM c2x),\n"
        "c4x AS (SELECT *, run_arr OR run_other AS checks_run, "
        "CASE WHEN run_arr THEN len(items) WHEN run_other THEN n_other ELSE 0 END AS n_items, "
        "CASE WHEN run_arr THEN len(list_filter(items, lambda x: json_type(x) = 'OBJECT' AND " + allf + ")) "
        "ELSE 0 END AS correct_items, "
        "CASE WHEN run_arr THEN flatten(list_transform(items, lambda x, i: CASE WHEN json_type(x) <> 'OBJECT' "
        f"THEN [{not_object}] ELSE list_filter([" + miss + "], lambda s: s IS NOT NULL) END)) "
        "WHEN run_other THEN list_transform(range(1, least(n_other, 3) + 1), lambda i: " + not_object + ") "
        "END AS f_issues, "
        "CASE WHEN run_arr THEN flatten(list_transform(items, lambda x, i: CASE WHEN json_type(x) <> 'OBJECT' "
        "THEN []::VARCHAR[] ELSE list_filter([" + types + "], lambda s: s IS NOT NULL) END)) "
        "WHEN run_other THEN []::VARCHAR[] END AS t_issues FROM c3x),\n"
        "checks AS (SELECT run_seq, scene_id, scheme_key, output_content, span, j, json_valid, "
        "coalesce(has_ti AND ti_type = 'ARRAY' AND json_array_length(j, '$.test_items') > 0, false) AS structure_valid, "
        "checks_run AND len(f_issues) = 0 AS field_names_valid, "
        "checks_run AND len(t_issues) = 0 AS data_types_valid, n_items, correct_items, "
        f"CASE WHEN json_valid THEN {said(JC.MSG_JSON_OK)} ELSE {said(JC.MSG_JSON_FAILED)} END AS json_valid_detail, "
        f"CASE WHEN NOT json_valid THEN {said(JC.MSG_STRUCTURE_DEFAULT)} "
        "WHEN has_ti AND ti_type = 'ARRAY' AND json_array_length(j, '$.test_items') > 0 "
        f"THEN {said(JC.MSG_STRUCTURE_OK, n='json_array_length(j, $$$.test_items$$)')} "
        f"WHEN has_ti THEN {said(JC.MSG_STRUCTURE_NOT_ARRAY)} "
        f"WHEN root_list THEN {said(JC.MSG_STRUCTURE_BARE_ARRAY, n='json_array_length(j)')} "
        f"ELSE {said(JC.MSG_STRUCTURE_MISSING)} END AS structure_detail, "
        f"CASE WHEN checks_run AND len(f_issues) = 0 THEN {said(JC.MSG_FIELDS_OK, n='n_items')} "
        f"WHEN checks_run THEN {said(JC.MSG_FIELDS_BAD, correct='correct_items', n='n_items', issues=shown('f_issues'))} "
        f"ELSE {said(JC.MSG_FIELDS_DEFAULT)} END AS field_names_detail, "
        f"CASE WHEN checks_run AND len(t_issues) = 0 THEN {said(JC.MSG_TYPES_OK)} "
        f"WHEN checks_run THEN {said(JC.MSG_TYPES_BAD, issues=shown('t_issues'))} "
        f"ELSE {said(JC.MSG_TYPES_DEFAULT)} END AS data_types_detail FROM c4x)\n"
    )


def normalized(j: str = "j", text: str = "output_content") -> str:
    """The canonical text of a valid document: the engine's own indented print, at two spaces a level."""
    lines = f"string_split(json_pretty({j}), chr(10))"
    two = f"array_to_string(list_transform({lines}, lambda l: repeat(' ', (length(l) - length(ltrim(l))) // 2) || ltrim(l)), chr(10))"
    return f"CASE WHEN json_valid THEN {two} ELSE {text} END"
