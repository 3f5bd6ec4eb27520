"""Model-output JSON checks (normalise, strict parse, structure, field names,
data types, item counts, issue details) as built-in Spark expressions.

The parsed document is a VARIANT column.  Object/array tests are casts
(``try_variant_get(x, '$', 'map<string,variant>')`` / ``'array<variant>'``);
scalar types come from ``schema_of_variant`` (``variant_get(.., 'string')``
would coerce 5 to '5').  A JSON ``null`` is a non-NULL VARIANT of type VOID,
so "field present with a null value" and "field missing" stay distinct.

``check_outputs`` projects the parsed variant once in its own ``select`` and
derives every check from it, so the document is parsed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.jsontext import canonical_text, nulls_for_not_numbers
from runlens.functions.text import json_span, strip_code_fence, trim_unicode

# ---------------------------------------------------------------------------
# Field names of a test item and the check messages (these
# strings are part of the judge prompt, so they must read exactly so).
REQUIRED_FIELDS = ["name", "methods", "requirements", "criteria"]
ARRAY_FIELDS = ["methods", "requirements", "criteria"]
ITEMS_KEY = "test_items"
MSG_JSON_OK = "JSON解析成功"
MSG_JSON_FAILED = "JSON解析失败，无法继续检查"
MSG_STRUCTURE_DEFAULT = "结构不完整"
MSG_STRUCTURE_OK = "结构完整，包含test_items数组，共{n}个测试项"
MSG_STRUCTURE_NOT_ARRAY = "test_items不是有效数组或为空"
MSG_STRUCTURE_BARE_ARRAY = "输出为数组而非包含test_items字段的对象，共{n}个测试项"
MSG_STRUCTURE_MISSING = "未找到test_items数组或有效测试项"
MSG_FIELDS_DEFAULT = "字段命名不符合要求"
MSG_FIELDS_OK = "所有{n}个测试项的字段命名完全符合要求"
MSG_FIELDS_BAD = "{correct}/{n}个测试项字段正确，问题：{issues}"
MSG_TYPES_DEFAULT = "数据类型不正确"
MSG_TYPES_OK = "所有测试项的数据类型正确"
MSG_TYPES_BAD = "数据类型问题：{issues}"
ISSUE_NOT_OBJECT = "测试项{i}不是对象类型"
ISSUE_MISSING_FIELD = '测试项{i}缺少字段"{f}"'
ISSUE_NAME_NOT_STRING = "测试项{i}的name不是字符串"
ISSUE_NOT_ARRAY = "测试项{i}的{f}不是数组"
ISSUES_SHOWN = 3
ISSUE_SEPARATOR = "; "
# Points of the format-compliance rubric: valid JSON, structure, field
# names, data types.
FORMAT_POINTS = (40, 30, 15, 15)
# End of fixed values.
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fmt(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed message with columns."""
    pieces, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            pieces.append(F.lit(pre))
        pieces.append(parts[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _obj(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _arr(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _get(v: Column, path: str) -> Column:
    """Sub-value at ``path``; NULL when absent (a JSON null is a VOID variant)."""
    return F.try_variant_get(v, path, "variant")


def _is_obj(v: Column) -> Column:
    """Object test without copying it: a cast to the empty struct."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _is_array_field(x: Column, f: str) -> Column:
    """``x.f`` is an array, without copying it: a first element exists, or the
    value prints as ``[]`` (``to_json`` only runs when there is no element)."""
    return F.when(_get(x, f"$.{f}[0]").isNotNull(), F.lit(True)).otherwise(
        F.coalesce(F.to_json(_get(x, f"$.{f}")) == "[]", F.lit(False)))


def _item_flags(x: Column) -> Column:
    """Per item: is it an object, which required fields are present, which
    present fields have the wrong type -- path probes, no per-item copies."""
    pres = {f: _get(x, f"$.{f}").isNotNull() for f in REQUIRED_FIELDS}
    parts = [_is_obj(x).alias("obj"), *[pres[f].alias(f"has_{f}") for f in REQUIRED_FIELDS],
             (pres["name"] & ~_is_string(_get(x, "$.name"))).alias("bad_name")]
    parts += [(pres[f] & ~_is_array_field(x, f)).alias(f"bad_{f}") for f in ARRAY_FIELDS]
    return F.struct(*parts)


def format_check_columns(df: DataFrame, parsed: str = "parsed", prefix: str = "") -> DataFrame:
    """T7-T12 on a column of parsed documents (VARIANT, NULL when invalid).

    Adds: json_valid, structure_valid, field_names_valid, data_types_valid,
    n_items, correct_items, and the four ``*_detail`` strings.

    Presence and type tests are path probes on the variant; the only copy
    made is the item list itself (to walk it with ``transform``).
    """
    v = F.col(parsed)
    stage1 = df.select("*", _get(v, "$." + ITEMS_KEY).alias("__ti"),
                       _get(v, "$[0]").isNotNull().alias("__root_list"))
    ti = F.col("__ti")
    has_ti = ti.isNotNull()
    root_list = F.col("__root_list")
    ti_nonempty_list = _get(ti, "$[0]").isNotNull()
    # The sequence the item checks walk: the test_items array, the root array,
    # or -- as the reference iterates them -- a string's characters / an
    # object's keys (never objects, so only "not an object" issues).
    items = F.when(has_ti, F.when(ti_nonempty_list, _arr(ti))).when(root_list, _arr(v))
    n_other = F.when(has_ti & _is_string(ti), F.length(F.variant_get(ti, "$", "string"))).when(
        has_ti & _is_obj(ti), F.size(_obj(ti)))
    stage2 = stage1.select("*", has_ti.alias("__has_ti"), (has_ti & ti_nonempty_list).alias("__structure_ok"),
                           items.alias("__items"), n_other.alias("__n_other"))
    stage3 = stage2.select("*", F.transform("__items", _item_flags).alias("__fl"))
    fl = F.col("__fl")
    n_arr = F.size(fl)
    run_arr = fl.isNotNull() & (n_arr > 0)
    run_other = fl.isNull() & F.coalesce(F.col("__n_other") > 0, F.lit(False))
    checks_run = run_arr | run_other
    n_items = F.when(run_arr, n_arr).when(run_other, F.col("__n_other")).otherwise(F.lit(0))

    def field_issues(g, i):
        idx = (i + 1).cast("string")
        miss = [F.when(~g[f"has_{f}"], _fmt(ISSUE_MISSING_FIELD, i=idx, f=F.lit(f))) for f in REQUIRED_FIELDS]
        return F.when(~g["obj"], F.array(_fmt(ISSUE_NOT_OBJECT, i=idx))).otherwise(
            F.filter(F.array(*miss), lambda s: s.isNotNull()))

    def type_issues(g, i):
        idx = (i + 1).cast("string")
        parts = [F.when(g["bad_name"], _fmt(ISSUE_NAME_NOT_STRING, i=idx))]
        parts += [F.when(g[f"bad_{f}"], _fmt(ISSUE_NOT_ARRAY, i=idx, f=F.lit(f))) for f in ARRAY_FIELDS]
        return F.when(~g["obj"], F.array().cast("array<string>")).otherwise(
            F.filter(F.array(*parts), lambda s: s.isNotNull()))

    def all_fields(g):
        acc = g["obj"]
        for f in REQUIRED_FIELDS:
            acc = acc & g[f"has_{f}"]
        return acc

    other_issues = F.transform(F.sequence(F.lit(1), F.least(F.col("__n_other"), F.lit(ISSUES_SHOWN))),
                               lambda i: _fmt(ISSUE_NOT_OBJECT, i=i.cast("string")))
    stage4 = stage3.select(
        "*",
        F.when(run_arr, F.flatten(F.transform(fl, field_issues))).when(run_other, other_issues)
        .alias("__f_issues"),
        F.when(run_arr, F.flatten(F.transform(fl, type_issues)))
        .when(run_other, F.array().cast("array<string>")).alias("__t_issues"),
        F.when(run_arr, F.size(F.filter(fl, all_fields))).otherwise(F.lit(0)).cast("bigint").alias("correct_items"),
        n_items.cast("bigint").alias("n_items"),
        checks_run.alias("__checks_run"),
    )
    valid = F.col(parsed).isNotNull()
    fi, tis = F.col("__f_issues"), F.col("__t_issues")
    ok_fields = F.col("__checks_run") & (F.size(fi) == 0)
    ok_types = F.col("__checks_run") & (F.size(tis) == 0)
    structure_ok = F.col("__structure_ok")
    n = F.col("n_items").cast("string")
    shown = lambda a: F.array_join(F.slice(a, 1, ISSUES_SHOWN), ISSUE_SEPARATOR)
    out = stage4.select(
        *[c for c in stage4.columns if not c.startswith("__")],
        valid.alias(prefix + "json_valid"),
        structure_ok.alias(prefix + "structure_valid"),
        ok_fields.alias(prefix + "field_names_valid"),
        ok_types.alias(prefix + "data_types_valid"),
        F.when(valid, F.lit(MSG_JSON_OK)).otherwise(F.lit(MSG_JSON_FAILED)).alias(prefix + "json_valid_detail"),
        F.when(~valid, F.lit(MSG_STRUCTURE_DEFAULT))
        .when(structure_ok, _fmt(MSG_STRUCTURE_OK, n=F.size("__items").cast("string")))
        .when(F.col("__has_ti"), F.lit(MSG_STRUCTURE_NOT_ARRAY))
        .when(F.col("__root_list"), _fmt(MSG_STRUCTURE_BARE_ARRAY, n=F.size("__items").cast("string")))
        .otherwise(F.lit(MSG_STRUCTURE_MISSING)).alias(prefix + "structure_detail"),
        F.when(ok_fields, _fmt(MSG_FIELDS_OK, n=n))
        .when(F.col("__checks_run"), _fmt(MSG_FIELDS_BAD, correct=F.col("correct_items").cast("string"),
                                          n=n, issues=shown(fi)))
        .otherwise(F.lit(MSG_FIELDS_DEFAULT)).alias(prefix + "field_names_detail"),
        F.when(ok_types, F.lit(MSG_TYPES_OK))
        .when(F.col("__checks_run"), _fmt(MSG_TYPES_BAD, issues=shown(tis)))
        .otherwise(F.lit(MSG_TYPES_DEFAULT)).alias(prefix + "data_types_detail"),
    )
    return out


# No model output holds this; a text that does gets a mark of its own.
END_MARK = "end of the document"


def document_of(df: DataFrame, span: str, doc: str, valid: str) -> DataFrame:
    """``df`` with ``doc`` (VARIANT, NULL unless valid) and ``valid``: whether the
    text column ``span`` is one JSON document as Python's parser takes it.

    One parse: the text is put into an array before a mark that it does not
    contain.  If the array's second element is the mark and there is no third,
    the first is the whole text.  ``NaN`` and infinities, which a VARIANT cannot
    hold, are read as null.
    """
    t = F.col(span)
    s1 = df.select("*", F.when(F.contains(t, F.lit(END_MARK)), F.md5(t)).otherwise(F.lit(END_MARK)).alias("__mark"))
    s2 = s1.select("*", F.when((t != "") & ~F.contains(t, F.col("__mark")),
                               F.try_parse_json(F.concat(F.lit("["), nulls_for_not_numbers(f"`{span}`"), F.lit(',"'), "__mark", F.lit('"]')))).alias("__doc"))
    marked = F.try_variant_get("__doc", "$[1]", "string") == F.col("__mark")
    whole = marked & F.try_variant_get("__doc", "$[2]", "variant").isNull()
    s3 = s2.select("*", F.coalesce(whole, F.lit(False)).alias(valid))
    return s3.select("*", F.when(F.col(valid), F.variant_get("__doc", "$[0]", "variant")).alias(doc)).drop("__mark", "__doc")


def normalize_columns(df: DataFrame, text: str = "output_content") -> DataFrame:
    """T1-T6 as staged projections: adds ``normalized``, ``parsed`` (VARIANT)
    and ``json_valid``.  ``normalized`` is the canonical text of a valid document
    (T5) and the text as it is otherwise.  Each stage reads the previous stage's
    columns, so trimming, fence, span and parse are each written and computed once."""
    t = F.col(text)
    s1 = df.select("*", trim_unicode(t).alias("__c1"))
    s2 = s1.select("*", strip_code_fence(F.col("__c1")).alias("__c2"))
    s3 = s2.select("*", trim_unicode(F.col("__c2")).alias("__c3"))
    s4 = s3.select("*", json_span(F.col("__c3")).alias("__span"))
    s5 = document_of(s4, "__span", "parsed", "json_valid")
    return s5.select(*df.columns, F.when(F.col("json_valid"), canonical_text("__span", "parsed")).otherwise(t).alias("normalized"), "parsed", "json_valid")


def check_outputs(df: DataFrame, text: str = "output_content") -> DataFrame:
    """T6 + T7-T12 for a text column: adds ``normalized``, ``parsed``
    (VARIANT) and every check column.  The document is parsed once."""
    return format_check_columns(normalize_columns(df, text).drop("json_valid"), "parsed")


def format_points(json_ok, structure_ok, fields_ok, types_ok) -> Column:
    """The rubric's format-compliance points from the four checks."""
    a, b, c, d = FORMAT_POINTS
    return (F.when(_c(json_ok), a).otherwise(0) + F.when(_c(structure_ok), b).otherwise(0)
            + F.when(_c(fields_ok), c).otherwise(0) + F.when(_c(types_ok), d).otherwise(0))


def entry_counts_equal(parsed) -> Column:
    """Every test item's methods / requirements / criteria arrays have
    equal lengths (NULL when the document has no item array)."""
    items = _arr(F.variant_get(_c(parsed), "$." + ITEMS_KEY, "variant"))

    def same(x):
        m = F.size(_arr(F.variant_get(x, "$.methods", "variant")))
        r = F.size(_arr(F.variant_get(x, "$.requirements", "variant")))
        c = F.size(_arr(F.variant_get(x, "$.criteria", "variant")))
        return F.coalesce((m == r) & (r == c), F.lit(False))

    return F.when(F.size(items) > 0, F.forall(items, same))


def unknown_addresses(output_addrs, prompt_addrs) -> Column:
    """Addresses named in the output that the prompt never names."""
    return F.array_except(_c(output_addrs), _c(prompt_addrs))


def canonical_json(parsed) -> Column:
    """The parsed document as compact text with sorted keys (a key for
    comparing documents; ``jsontext.canonical_text`` is T5)."""
    return F.to_json(_c(parsed))
