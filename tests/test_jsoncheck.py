"""Model-output checks on literal cases with hand-derived expected flags."""

import json

import pytest

from runlens.functions.jsoncheck import check_outputs, entry_counts_equal, format_points
from runlens.functions.text import json_span, strip_code_fence, trim_unicode

OK = '{"name":"n","methods":["a"],"requirements":["b"],"criteria":["c"]}'
FENCE = "```"
C1 = '{"test_items":[' + OK + ']}'

# (text, json_valid, structure_valid, field_names_valid, data_types_valid)
CASES = [
    (C1, True, True, True, True),
    (f"{FENCE}json\n{C1}\n{FENCE}", True, True, True, True),
    (f"{FENCE}json\n{C1}", True, True, True, True),
    (f"Result: {C1} done", True, True, True, True),
    (f"[{OK}]", True, False, True, True),
    (f"Here: [{OK},{OK}]", False, False, False, False),
    (f"Here: [{OK}]", True, False, False, False),
    ('{"test_items":[]}', True, False, False, False),
    ('{"items":[]}', True, False, False, False),
    ("[]", True, False, False, False),
    ('{"test_items":[' + OK + ',{"name":"n","methods":[],"requirements":[]}]}', True, True, False, True),
    ('{"test_items":[{"name":"n","methods":"x","requirements":[],"criteria":[]}]}', True, True, True, False),
    ('{"test_items":[{"name":5,"methods":[],"requirements":[],"criteria":[]}]}', True, True, True, False),
    ('{"test_items":["a",' + OK + ']}', True, True, False, True),
    ('{"test_items":[{"name":"n","methods":[],"requirements":[],"criteria":null}]}', True, True, True, False),
    ('{"test_items":"abc"}', True, False, False, True),
    ('{"test_items":{"a":1}}', True, False, False, True),
    ('{"test_items":5}', True, False, False, False),
    ('{"test_items":null}', True, False, False, False),
    ("no json at all", False, False, False, False),
    ("", False, False, False, False),
    (f"{FENCE}json {C1} {FENCE}", False, False, False, False),
    (FENCE, False, False, False, False),
    ('{"a":1} {"b":2}', False, False, False, False),
    ("　\n" + C1 + "\n　", True, True, True, True),
    ('{"test_items":""}', True, False, False, False),
    ("[1,2]", True, False, False, True),
    ('{"test_items":[{"nome":"x"}]}', True, True, False, True),
    ('{"test_items":{}}', True, False, False, False),
    ('{"test_items":[{}]}', True, True, False, True),
]


@pytest.fixture(scope="module")
def checked(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "case_id int, text string")
    rows = check_outputs(df, "text").orderBy("case_id").collect()
    return rows


@pytest.mark.parametrize("i", range(len(CASES)))
def test_flags(checked, i):
    r = checked[i]
    exp = CASES[i][1:]
    got = (r.json_valid, r.structure_valid, r.field_names_valid, r.data_types_valid)
    assert got == exp, (CASES[i][0], got, exp)


def test_detail_partial_fields(checked):
    r = checked[10]
    assert r.correct_items == 1 and r.n_items == 2
    assert r.field_names_detail == '1/2个测试项字段正确，问题：测试项2缺少字段"criteria"'
    assert r.structure_detail == "结构完整，包含test_items数组，共2个测试项"
    assert r.data_types_detail == "所有测试项的数据类型正确"


def test_detail_string_items(checked):
    r = checked[15]
    assert r.n_items == 3 and r.correct_items == 0
    assert r.field_names_detail == ("0/3个测试项字段正确，问题：测试项1不是对象类型; "
                                    "测试项2不是对象类型; 测试项3不是对象类型")
    assert r.structure_detail == "test_items不是有效数组或为空"


def test_detail_first_three_issues(spark):
    text = '{"test_items":[{"name":1,"methods":1,"requirements":1,"criteria":1}]}'
    r = check_outputs(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert r.data_types_detail == ("数据类型问题：测试项1的name不是字符串; 测试项1的methods不是数组; "
                                   "测试项1的requirements不是数组")


def test_detail_defaults(checked):
    r = checked[19]
    assert r.json_valid_detail == "JSON解析失败，无法继续检查"
    assert r.structure_detail == "结构不完整"
    assert r.field_names_detail == "字段命名不符合要求"
    assert r.data_types_detail == "数据类型不正确"
    r = checked[4]
    assert r.structure_detail == "输出为数组而非包含test_items字段的对象，共1个测试项"
    r = checked[8]
    assert r.structure_detail == "未找到test_items数组或有效测试项"


def test_normalized_is_canonical_text(checked):
    assert checked[3].normalized == json.dumps(json.loads(C1), indent=2, ensure_ascii=False)
    assert checked[19].normalized == "no json at all"


def test_text_helpers(spark):
    df = spark.createDataFrame([("　 x 　",), (f"{FENCE}json\nA\n{FENCE}",), ("ab{x}c{y}d",)], "t string")
    r = df.select(trim_unicode("t").alias("a"), strip_code_fence("t").alias("b"), json_span("t").alias("c")).collect()
    assert r[0].a == "x"
    assert r[1].b == "A"
    assert r[2].c == "{x}c{y}"


def test_format_points_and_entry_counts(spark):
    df = spark.createDataFrame([
        ('{"test_items":[{"name":"a","methods":[1,2,3],"requirements":[1,2,3],"criteria":[1,2,3]}]}',),
        ('{"test_items":[{"name":"a","methods":[1,2,3],"requirements":[1,2],"criteria":[1,2,3]}]}',),
    ], "t string")
    r = check_outputs(df, "t").select(
        format_points("json_valid", "structure_valid", "field_names_valid", "data_types_valid").alias("p"),
        entry_counts_equal("parsed").alias("eq")).collect()
    assert [x.p for x in r] == [100, 100]
    assert [x.eq for x in r] == [True, False]


def test_canonical_json_is_compact_and_sorted(spark):
    import json

    from runlens.functions.jsoncheck import canonical_json

    doc = '{"b": [1, 2, {"y": "é", "x": null}], "a": "text"}'
    r = check_outputs(spark.createDataFrame([(doc,)], "t string"), "t").select(canonical_json("parsed")).first()[0]
    assert r == json.dumps(json.loads(doc), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize("methods,types_ok", [
    ("[]", True), ("[null]", True), ('["a"]', True), ("{}", False), ('"[]"', False), ("null", False),
    ("0", False), ('{"0": 1}', False), ("[[]]", True),
])
def test_array_type_probe(spark, methods, types_ok):
    text = '{"test_items":[{"name":"n","methods":' + methods + ',"requirements":[],"criteria":[]}]}'
    r = check_outputs(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r.field_names_valid is True and r.data_types_valid is types_ok
