"""Property tests: Spark expressions against Python's own semantics on
random inputs (one Spark job per property, many examples per job)."""

import json
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from runlens.functions.jsoncheck import document_of
from runlens.functions.metrics import np_round, py_round

FLOATS = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=5, deadline=None)
@given(values=st.lists(FLOATS, min_size=50, max_size=200), digits=st.integers(0, 3))
def test_py_round_equals_python_round(spark, values, digits):
    # include decimal ties, which are where the rules differ
    values = values + [k / 10 ** (digits + 1) for k in range(-45, 50, 10)] + [k + 0.5 for k in range(-3, 4)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(py_round("x", digits)).collect()]
    assert got == [float(round(v, digits)) for v in values]


@settings(max_examples=5, deadline=None)
@given(values=st.lists(FLOATS, min_size=50, max_size=200), digits=st.integers(0, 3))
def test_np_round_equals_numpy_round(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(np_round("x", digits)).collect()]
    assert got == [float(np.round(v, digits)) for v in values]


JSON_LEAF = st.one_of(st.none(), st.booleans(), st.integers(-10 ** 6, 10 ** 6),
                      st.floats(allow_nan=False, allow_infinity=False, width=32),
                      st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=8))
JSON_VALUE = st.recursive(JSON_LEAF, lambda c: st.one_of(st.lists(c, max_size=4),
                                                        st.dictionaries(st.text(max_size=5), c, max_size=4)),
                          max_leaves=12)


def _python_ok(s: str) -> bool:
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


def _mutations(doc: str, rnd: random.Random) -> list[str]:
    out = [doc, doc + " ", doc + " x", doc + "," + doc, doc + " " + doc, doc[:-1], doc + "]", "[" + doc,
           doc + "}", doc.replace(":", "", 1), doc.replace(",", "", 1)]
    if len(doc) > 2:
        i = rnd.randrange(1, len(doc) - 1)
        out.append(doc[:i] + doc[i + 1:])
    return out


@settings(max_examples=3, deadline=None)
@given(values=st.lists(JSON_VALUE, min_size=20, max_size=40), seed=st.integers(0, 10 ** 6))
def test_strict_json_equals_python_json(spark, values, seed):
    rnd = random.Random(seed)
    texts = []
    for v in values:
        doc = json.dumps(v, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))
        texts += [t for t in _mutations(doc, rnd) if t.strip()]
    # spans in the checks always start with { or [ -- test those shapes
    texts = [t for t in texts if t[:1] in "{["]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.ok for r in document_of(df, "s", "doc", "ok").collect()}
    bad = [(t, got[i], _python_ok(t)) for i, t in enumerate(texts) if got[i] != _python_ok(t)]
    assert not bad, bad[:5]
