import numpy as np
import pytest

from runlens.llm import ann

SHAPE = "vec_id bigint, embedding array<float>"


def brute(rows, is_query, k):
    """Exact neighbours of the different (id, vector) rows that take part."""
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = {}
    for i, v in own:
        if is_query(i):
            near = sorted((-float((np.float32(v).astype(float) * np.float32(w).astype(float)).sum()), j) for j, w in own if j != i and len(w) == len(v))
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return {q: n for q, n in out.items() if n}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    x = np.random.default_rng(0).normal(size=(5, 48))
    assert np.allclose((ann.turned(x, 3) ** 2).sum(axis=1), (x**2).sum(axis=1))


def test_nearest_axis():
    assert ann.axes(np.array([[0.1, -3.0, 2.0]]), 3).tolist() == [[3, 4, 0]]


def test_query_recall(run, table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings")]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in sorted(run("op4_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({n[1] for n in want[q]} & {n[1] for n in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, j): s for q in want for _, j, s in brute(rows, lambda i, q=q: i == q, 10**6)[q]}
    assert all(abs(s - exact[q, j]) < 1e-12 for q in got for _, j, s in got[q])
    assert all([n[0] for n in got[q]] == list(range(1, len(got[q]) + 1)) for q in got)


@pytest.mark.parametrize("slices", [1, 8192])
def test_all_probes_are_exact(spark, monkeypatch, slices):
    """With every axis probed the search is brute force: ties, copies and lengths included."""
    monkeypatch.setattr(ann, "ROWS", slices)
    rng = np.random.default_rng(3)
    base = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(30, 8))]
    rows = [(i, base[i % 30] if i % 4 else base[0]) for i in range(90)]
    rows += [(100 + i, [c * 3 for c in base[i]]) for i in range(10)] + [rows[7], rows[7]]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] + [1.0] * 7), (205, [None] + [1.0] * 7), (None, base[3]), (206, [1.0, 2.0]), (220, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SHAPE + ", key string, norm double").repartition(3)
    got = found(ann.nearest(df, lambda c: c % 20 == 0, k=5, probes=32))
    want = brute(rows, lambda i: i % 20 == 0, 5)
    assert {q: [n[:2] for n in v] for q, v in got.items()} == {q: [n[:2] for n in v] for q, v in want.items()}


def test_fewer_candidates_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.5])], SHAPE)
    assert found(ann.nearest(two, lambda c: c % 20 == 0, probes=4)) == {0: [(1, 1, 1.0)]}
    assert ann.nearest(two.where("false"), lambda c: c % 20 == 0).count() == 0


def recall(spark, monkeypatch, vectors, k=20, **settings):
    """Share of the exact neighbours that are found, and the fewest rows of a query."""
    for name, value in settings.items():
        monkeypatch.setattr(ann, name, value, raising=False)
    x = vectors.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SHAPE).repartition(3)
    got = found(ann.nearest(df, lambda c: c % 20 == 0, k=k))
    hits, x = 0, x.astype(float)
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:k].tolist()) & {n[1] for n in got[q]})
    return hits / (k * len(range(0, len(x), 20))), min(len(got.get(q, [])) for q in range(0, len(x), 20))


@pytest.mark.parametrize("lengths", ["outlier", "three", "lognormal"])
def test_unequal_lengths(spark, monkeypatch, lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "lognormal":
        x *= rng.lognormal(size=(len(x), 1))
    else:
        x[7] *= {"outlier": 100, "three": 3}[lengths]
    share, least = recall(spark, monkeypatch, x, WHOLE=300)
    assert share >= 0.9 and least == 20


@pytest.mark.parametrize(("n", "dim", "k", "whole"), [(3000, 384, 20, 300), (15, 64, 20, 2048), (15, 64, 20, 1)])
def test_recall_in_any_dimension(spark, monkeypatch, n, dim, k, whole):
    x = np.random.default_rng(6).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share, least = recall(spark, monkeypatch, x, min(k, n - 1), WHOLE=whole)
    assert share >= (0.9 if n > 100 else 1.0) and least == min(k, n - 1)


def test_choice_of_probes():
    """The target is met whatever the sizes, at least cost; bands that would cost as much are seen whole."""
    found = [(0, r % 5) for r in range(80)] + [(9, 100 + r) for r in range(20)]
    for n in (10**5, 10**9):
        plan = ann.choose_probes({0: n, 9: n}, found, 128, 8)
        assert plan[0] == 5 and 9 not in plan
    assert ann.choose_probes({0: 10**6, 5: 10**6}, [(0, 0)] * 95 + [(5, 3)] * 5, 128, 8) == {0: 1, 5: 1}
    assert ann.choose_probes({0: 10**6}, [(0, 0)], 4, 8) == {}
