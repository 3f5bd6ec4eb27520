import math
import re

import pytest

from runlens.llm import mixing


def plain_targets(sizes, share=1.5, limit=2.0):
    """Shares by weight; what is above a limit is shared out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        part = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in sorted(free, key=str):
            room = limit * sizes[s] - out[s]
            out[s] += min(room, part[s])
            if part[s] >= room:
                left += part[s] - room
                free.discard(s)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    sizes, most = {}, {}
    for _, text, _, source, *_ in docs:
        sizes[source] = sizes.get(source, 0) + words(text)
        most[source] = max(most.get(source, 0), words(text))
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    return want, taken


def test_query(run, table):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table("documents")]
    source = {r[0]: r[3] for r in docs}
    check([r | {"source": source[r["doc_id"]]} for r in run("op6_mixing")], docs)


def test_rates_are_exponential_tilts(spark):
    """Rates against a bisection of the dual."""
    docs = [(i, "w " * (1 + i * 7 % 40), None, "abcdef"[i % 6], 0) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = [r.asDict() for r in mixing.mix(df).collect()]
    for s in "abcdef":
        own = [r for r in rows if r["source"] == s]
        mean, target = sum(r["size"] for r in own) / len(own), own[0]["target"]
        if target >= 2 * own[0]["source_size"] - 1e-9:
            assert all(r["rate"] == 2 for r in own)
            continue
        low, high = -50.0, 50.0
        for _ in range(200):
            m = (low + high) / 2
            if sum(r["size"] * min(2, math.exp(m * r["size"] / mean)) for r in own) < target:
                low = m
            else:
                high = m
        assert all(math.isclose(r["rate"], min(2, math.exp(m * r["size"] / mean)), rel_tol=1e-5) for r in own)


def test_near_the_target_and_the_same_again(spark):
    docs = [(i, "w " * (1 + i * 13 % 90), None, ["a", "b", "c", "d"][min(3, i % 7)], 0) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = [r.asDict() for r in mixing.mix(df).collect()]
    want, taken = check(rows, docs)
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    again = [r.asDict() for r in mixing.mix(df.repartition(7)).collect()]
    assert sorted((r["id"], r["taken"]) for r in rows) == sorted((r["id"], r["taken"]) for r in again)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 1000, None: 3}, {"a": 0, "b": 5}, {"a": 7}, {None: 4, "": 9, "é": 90, "z": 2}, {"a": 0}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = plain_targets(sizes)
    assert {r["source"] for r in got} == set(sizes)
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = [r.asDict() for r in mixing.mix(odd_docs).collect()]
    assert len(rows) == len(odd_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(no_docs).count() == 0


def test_stage_copies_rows(odd_docs, no_docs):
    taken = mixing.mix(odd_docs).collect()
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r["copies"] for r in taken)
    assert sum(words(r["text"]) for r in out.collect()) == sum(r["taken"] for r in taken)
    assert mixing.apply_mix(no_docs).count() == 0
