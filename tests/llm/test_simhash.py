import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from runlens.llm import simhash

xxhash = pytest.importorskip("xxhash")


def plain_print(text, shingle=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not w:
        return 0
    grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=3):
    """(id, text) rows -> Counter of (id, fingerprint, component id)."""
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return Counter((r[0], p, least[g]) for r, p, g in zip(rows, prints, group))


def got_groups(df):
    return Counter((r["id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for places in [rng.sample(range(64), radius) for _ in range(3000)] + list(itertools.combinations(range(0, 64, 7), radius)):
        differ = sum(1 << p for p in places)
        assert any(m & differ == 0 for m in masks)


def test_spanning_links_connect_what_is_linked():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    x = np.array(sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) % (1 << 64) for b in base for _ in range(60)}), dtype=np.uint64)
    links = simhash.spanning_links(x, 3)
    assert len(links) < len(x) and all((a ^ b).bit_count() <= 3 for a, b in links)

    def sets(pairs):
        own = {int(v): {int(v)} for v in x}
        for a, b in pairs:
            if own[a] is not own[b]:
                own[a] |= own[b]
                for v in own[b]:
                    own[v] = own[a]
        return {frozenset(s) for s in own.values()}

    every = [(int(a), int(b)) for a, b in itertools.combinations(x, 2) if (int(a) ^ int(b)).bit_count() <= 3]
    assert sets(links) == sets(every)


def near_prints(spark, n=260):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < n:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(50)}
    return sorted(values), spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)], "x bigint")


@pytest.mark.parametrize("block", [4, 32, 4096])
def test_large_buckets_in_blocks(spark, block):
    values, frame = near_prints(spark)
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame, 3, block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    label = {v: v for v in values}

    def joined(pairs):
        own = {v: {v} for v in label}
        for a, b in pairs:
            if own[a] is not own[b]:
                own[a] |= own[b]
                for v in own[b]:
                    own[v] = own[a]
        return {frozenset(s) for s in own.values()}

    assert joined(got) == joined([(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3])


def test_runs_across_batches():
    rows = pd.DataFrame({"t": 0, "k": [1] * 5 + [2] * 2 + [3], "x": np.arange(8, dtype=np.int64)}).astype({"t": "int32"})
    whole = pd.concat(simhash._links_of_sorted(3, 100)([rows]))
    parts = pd.concat(simhash._links_of_sorted(3, 100)([rows[i:i + 1].reset_index(drop=True) for i in range(8)]))
    assert sorted(map(tuple, whole.to_numpy())) == sorted(map(tuple, parts.to_numpy())) and len(whole) == 5
    marks = pd.concat(simhash._links_of_sorted(3, 3)([rows[i:i + 2].reset_index(drop=True) for i in range(0, 8, 2)]))
    assert marks[marks["t"] >= 0][["t", "a"]].values.tolist() == [[0, 1]]


def test_query(run, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in run("op8_simhash"))
    assert got == plain_groups(rows) and all(len(r["fingerprint"]) == 16 for r in run("op8_simhash"))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got_groups(simhash.near_duplicates(odd_docs)) == plain_groups([r[:2] for r in odd_rows])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_stage_keeps_one_of_each_group(odd_docs, odd_rows, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = plain_groups([r[:2] for r in odd_rows])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for _, _, c in groups})
    assert simhash.drop_near_duplicates(no_docs).count() == 0
