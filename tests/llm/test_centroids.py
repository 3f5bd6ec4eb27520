import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from runlens.llm import centroids


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """(id, vector) rows -> Counter of (id, cluster, distance, cluster inertia, inertia, centroid)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    def rank(row):
        return hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    cs = [v for _, v in sorted(kept, key=rank)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == c]
            cs[c] = [sum(col) // len(members) for col in zip(*members)]
    placed = [(i, *nearest(v)) for i, v in kept]
    each = Counter()
    for _, d, c in placed:
        each[c] += d
    return Counter((i, c, d, each[c], sum(each.values()), tuple(cs[c])) for i, d, c in placed)


def got(df):
    return Counter((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in df.collect())


def test_query(run, table):
    want = plain([(r["vec_id"], r["embedding"]) for r in table("embeddings")])
    rows = Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in run("op11_centroids"))
    assert rows == Counter({(*k[:5], centroids.digest(k[5])): n for k, n in want.items()})


@pytest.mark.parametrize("seed", range(4))
def test_walk_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    spread = [2, 5, 40, 1000][seed]  # few values: many ties
    c = rng.integers(-spread, spread, (11, 6))
    c[7] = c[2]
    v = np.concatenate([rng.integers(-spread, spread, (300, 6)), c])
    best, dist, met = centroids.SortedLists(c).nearest(v)
    exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (dist == exact.min(axis=1)).all()
    assert (met >= 1).all() and (met <= 11).all()


def test_walk_stops_early():
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (64, 4))
    _, _, met = centroids.SortedLists(c).nearest(c + 1)
    assert met.mean() < 16  # of 64 centroids


def odd(rng):
    base = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 0.0]), (104, [float("nan"), 0.0, 0.0]), (105, [float("-inf"), 0.0, 0.0])]
    return rows + [(None, base[0]), (None, base[1]), (3, base[4]), (5, base[5]), (5, base[5]), (200, [-0.0, 0.5, 1e4])]


def test_odd_rows(spark):
    rows = odd(random.Random(3))
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, q string, id int, cluster int").repartition(5)
    for k, rounds in [(16, 3), (4, 2), (1, 1), (100, 3)]:
        assert got(centroids.cluster(df, k=k, rounds=rounds, dims=3)) == plain(rows, k, rounds, 3)


def test_empty_and_all_left_out(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    out = centroids.cluster(spark.createDataFrame([(1, [1.0]), (2, None)], schema))
    assert out.collect() == [] and out.columns == ["id", "cluster", "distance", "met", "cluster_inertia", "inertia", "centroid"]


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(df).collect()
