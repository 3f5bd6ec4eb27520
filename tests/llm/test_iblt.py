import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import iblt

SETS = st.lists(st.tuples(st.sets(st.integers(0, 60), max_size=40), st.sets(st.integers(0, 60), max_size=40)), max_size=5)


def digests(numbers):
    return np.array([int(hashlib.md5(str(n).encode()).hexdigest()[:16], 16) for n in sorted(numbers)], dtype=np.uint64)


@settings(max_examples=120, deadline=None)
@given(SETS, st.sampled_from([1, 2, 8]))
def test_recovers_exact_differences(pairs, cells):
    a, b = [digests(x) for x, _ in pairs], [digests(y) for _, y in pairs]
    for x, y, (only_x, only_y) in zip(a, b, iblt.differences(a, b, cells)):
        assert set(only_x.tolist()) == set(x.tolist()) - set(y.tolist())
        assert set(only_y.tolist()) == set(y.tolist()) - set(x.tolist())


def test_large_difference_is_retried():
    a, b = digests(range(3000)), digests(range(2000, 9000))
    (only_a, only_b), = iblt.differences([a], [b])
    assert len(only_a) == 2000 and len(only_b) == 6000


def test_copies_of_a_paragraph_count():
    assert len(set(iblt.digests("a.\na.\na.").tolist())) == 3
    assert iblt.likeness([iblt.digests("a\nb")], [iblt.digests("a\na")]) == [0.5]
    assert iblt.likeness([iblt.digests("")], [iblt.digests(None)]) == [1.0]


def want(rows):
    """By brute force: the order, the edited text, the shares of common paragraphs."""
    from collections import Counter

    def like(x, y):
        x, y = (Counter(p for p in iblt._CUT.split(t) if p) for t in (x, y))
        n = sum(x.values()) + sum(y.values())
        return 2 * sum((x & y).values()) / n if n else 1.0

    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, n), 9)))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows), key=str)


def test_query(run, table):
    rows = sorted(((r["doc_id"], r["text"]) for r in table("documents")), reverse=True)
    assert got(run("op9_fingerprints")) == want(rows)
    prints = {}
    for (d, t) in rows:
        prints.setdefault(t, set()).add(next(r["fingerprint"] for r in run("op9_fingerprints") if r["doc_id"] == d))
    assert all(len(p) == 1 for p in prints.values())


def test_pieces_and_odd_rows(spark, odd_docs, odd_rows, no_docs):
    from pyspark.sql import functions as F

    keyed = odd_docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["doc_id"], r["text"]) for r in keyed), key=lambda r: r[:3])
    expected = want([(r[3], r[4]) for r in order])
    for pieces in (1, 2, 7, 200):
        assert got(iblt.compare_editions(odd_docs, pieces).collect()) == expected
    assert iblt.compare_editions(no_docs).count() == 0
    one = spark.createDataFrame([(4, "abcd")], "doc_id bigint, text string")
    assert got(iblt.compare_editions(one).collect()) == want([(4, "abcd")])
