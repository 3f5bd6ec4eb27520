"""Canonical JSON text and parsing against Python's json module."""

import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions.jsoncheck import document_of, normalize_columns
from runlens.functions.jsontext import canonical_text

NUMBERS = ["1", "-0", "0", "12345678901234567890123", "1.50", "1e5", "1E-7", "-0.0", "3.14159", "1e400", "-1e999", "0.1e1",
           "123456.789e3", "1e16", "1e15", "9007199254740993.0", "1.0E+2", "0.00001", "0.0001", "5e-324", "1.7976931348623157e308",
           "0.30000000000000004", "100000000000000000000.0", "1234567890.12345", "0e5", "-0.000", "1e22", "1e-300", "123e-4"]
WORDS = ["NaN", "Infinity", "-Infinity", "true", "false", "null"]
STRINGS = ['""', r'"a\u00e9\ud83d\ude00\/\"\\\b\f\n\r\t\u0001\u001f\u007f"', '"é😀: , {[ x"', r'"\u0061"', '"\u2028\u00a0"', r'"\\u0061"', '"NaN"']


def odd(rng, depth=0):
    """A valid document in odd spelling, with repeated keys."""
    gap = lambda: rng.choice(["", " ", "\n  ", "\t", "\r\n"])
    kind = rng.random()
    if depth > 3 or kind < 0.5:
        return rng.choice(rng.choice([NUMBERS, WORDS, STRINGS]))
    if kind < 0.75:
        return "[" + gap() + f"{gap()},{gap()}".join(odd(rng, depth + 1) for _ in range(rng.randint(0, 4))) + gap() + "]"
    keys = [rng.choice(['"a"', '"b"', r'"\u0061"', '"é"', f'"k{rng.randint(0, 50)}"']) for _ in range(rng.randint(0, 5))]
    return "{" + gap() + f"{gap()},{gap()}".join(f"{k}{gap()}:{gap()}{odd(rng, depth + 1)}" for k in keys) + gap() + "}"


def canonical(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, s string").repartition(4)
    return {r.i: r.c for r in df.select("i", canonical_text("s").alias("c")).collect()}


def test_equal_to_python(spark):
    rng = random.Random(1)
    docs = [odd(rng) for _ in range(1500)] + [
        "[]", "{}", "[[]]", '{"a":{}}', '{"a":1,"b":2,"a":{"c":1,"c":[1,2],"d":0}}', '{"a":{"x":1,"x":2},"b":[],"a":[{"y":1,"z":2,"y":3}],"c":1}',
        '{"a":1,"a":2,"a":3}', '[{"a":1,"a":[]},{"a":{},"b":0,"a":{}}]', "[" * 200 + "]" * 200]
    docs.append("[" + ",".join(f'{{"k{i}":[{i},"{"x" * 30}"]}}' for i in range(4000)) + "]")  # many runs of tokens
    got = canonical(spark, docs)
    for i, d in enumerate(docs):
        assert got[i] == json.dumps(json.loads(d), indent=2, ensure_ascii=False), d[:500]


def test_null_and_half_pairs(spark):
    df = spark.createDataFrame([(0, None), (1, r'["\uD83D", "x\uDE00y"]')], "i int, s string")
    got = {r.i: r.c for r in df.select("i", canonical_text("s").alias("c")).collect()}
    assert got == {0: None, 1: '[\n  "\\ud83d",\n  "x\\ude00y"\n]'}


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-10**30, 10**30) | st.floats() | st.text(max_size=8),
                      lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


def digits(x):
    return len(repr(x).split("e")[0].replace(".", "").replace("-", "").strip("0")) if math.isfinite(x) else 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VALUES, min_size=30, max_size=60), st.booleans())
def test_random_values(spark, values, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in values]
    texts = [t for t in texts if t.isascii() or t.encode("utf-8", "ignore").decode() == t]
    got = canonical(spark, texts)
    for i, t in enumerate(texts):
        want = json.loads(t)
        found = []
        json.loads(t, parse_float=lambda s: found.append(float(s)) or float(s))
        if any(digits(x) > 15 or abs(x) < 1e-300 for x in found):  # the last digits may be Java's: equal values
            assert json.dumps(json.loads(got[i])) == json.dumps(want)
        else:
            assert got[i] == json.dumps(want, indent=2, ensure_ascii=False)


def test_constants_that_python_takes(spark):
    """NaN and infinities are valid outside strings, as whole values only."""
    texts = ["[NaN]", '{"a": -Infinity, "b": [Infinity]}', "[1NaN]", "[-NaN]", "[--Infinity]", "[Infinityx]", "{NaN: 1}", '["NaN", "-Infinity"]',
             "[+Infinity]", "[NaN NaN]", "[nan]", "[N, aN]", '["a\\"NaN", NaN]', "[Inf, inity]", "NaN", '{"a":NaN,"a":1}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.ok for r in document_of(df, "s", "doc", "ok").collect()}

    def valid(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert got == {i: valid(t) for i, t in enumerate(texts)}


def test_a_text_that_holds_the_mark(spark):
    from runlens.functions.jsoncheck import END_MARK

    texts = [f'["{END_MARK}"]', f'1,"{END_MARK}"],[2', f'{{"a": "{END_MARK}"}}', '1,"\\u0065nd of the document"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    assert {r.i: r.ok for r in document_of(df, "s", "doc", "ok").collect()} == {0: True, 1: False, 2: True, 3: False}


def test_normalized_is_the_canonical_text(spark):
    texts = ['```json\n{"b":[1,2], "a":"\\u00e9"}\n```', "Here:\n[{}]", "no json", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, output_content string")
    got = {r.i: (r.normalized, r.json_valid) for r in normalize_columns(df).collect()}
    assert got[0] == ('{\n  "b": [\n    1,\n    2\n  ],\n  "a": "é"\n}', True)
    assert got[1] == ("{}", True) and got[2] == ("no json", False)
    assert got[3][0] is None and got[4] == ("", False)


def test_only_repeated_keys_are_looked_for_by_tokens(spark, monkeypatch):
    """A document whose parsed form has all its keys is printed without folds over its tokens."""
    from runlens.functions import jsontext

    monkeypatch.setattr(jsontext, "repeated_keys", lambda toks, at: "cast(raise_error('tokens compared') AS int)")
    docs = ['{"a:": {"b": [1, {"a:": "x:y,{"}], "c": ":"}, "d": [{"b": 1}, {"b": 2}]}', '[":", "a\\":b"]', "{}", "7", '{"n": NaN, "m": -0.50}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, s string")
    got = {r.i: r.c for r in df.select("i", jsontext.canonical_text("s").alias("c")).collect()}
    assert got == {i: json.dumps(json.loads(s), indent=2, ensure_ascii=False) for i, s in enumerate(docs)}
    with pytest.raises(Exception, match="tokens compared"):
        spark.createDataFrame([('{"a": 1, "\\u0061": 2}',)], "s string").select(jsontext.canonical_text("s")).collect()


def test_lines_over_several_runs(spark):
    """Depth goes on from run to run; punctuation inside strings cuts no line."""
    deep = []
    for i in range(150):
        deep = [f"{i}:,[", deep, {"k]": [], "l}": {}}] if i % 2 else {"x:{": deep, 'q"': i, "e": [None, True]}
    docs = [json.dumps(deep), json.dumps([deep, [["a, b: c"] * 70], deep], indent=1, ensure_ascii=False), json.dumps(list(range(64))), json.dumps(["s"] * 62),
            '{"a": {"x": 1, "x": [' + "1, " * 200 + '2]}, "b": 3}', "[" * 90 + "]" * 90]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, s string")
    got = {r.i: r.c for r in df.select("i", canonical_text("s").alias("c")).collect()}
    assert got == {i: json.dumps(json.loads(s), indent=2, ensure_ascii=False) for i, s in enumerate(docs)}


def test_keys_that_are_no_text(spark):
    """Different halves of surrogate pairs are different keys."""
    df = spark.createDataFrame([('{"\\ud800": 1, "\\uD801": 2}',)], "s string")
    assert df.select(canonical_text("s")).first()[0] == '{\n  "\\ud800": 1,\n  "\\ud801": 2\n}'
