import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from runlens.llm import ngramjoin
from runlens.llm.ngramjoin import Bands


def plain_set(text, size=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def plain(rows, size=3, num=9, den=10):
    """(id, text) rows -> Counter of (id, n_shingles, component_id)."""
    sets = [plain_set(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and group[i] != group[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return Counter((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group))


def got(df):
    return Counter((r["id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_query(run, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run("op12_ngram_join")) == plain(rows)


def similar(a, b, num, den):
    return den * np.intersect1d(a, b).size >= num * np.union1d(a, b).size


def meet(x, y, bands, hot):
    """Whether the larger set looks up a key under which the smaller one is indexed."""
    def keys(own, other_kind):
        key, kind = ngramjoin.signatures(own, bands, *hot)
        return set(key[kind != other_kind].tolist())

    x, y = sorted((x, y), key=len)
    return bool(keys(x, 1) & keys(y, 2))


@pytest.mark.parametrize("num, den", [(9, 10), (8, 10), (1, 2)])
@pytest.mark.parametrize("frequent", [0.0, 0.5, 1.0])
def test_no_similar_pair_is_missed(num, den, frequent):
    """Every similar pair meets under some key, whatever subsets count as frequent."""
    rng = np.random.default_rng(num + int(10 * frequent))
    bands, met = Bands(num, den), 0
    for _ in range(600):
        size = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        change = int(rng.integers(0, max(2, size * (den - num) // num + 1)))
        keep = rng.permutation(x)[min(x.size, int(rng.integers(0, change + 1))):]
        y = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, change + 1)), dtype=np.uint64))))
        if not y.size or not similar(x, y, num, den) or np.array_equal(x, y):
            continue
        own = [bands.of(s.size) for s in (x, y)]
        every = [ngramjoin.whole_keys(*ngramjoin.cut(ngramjoin.mix(s), b, bands.segments(b))[1:]) for s, b in zip((x, y), own) if b >= 0]
        keys = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        keys = keys[rng.random(keys.size) < frequent]
        hot = keys, rng.integers(64, 5000, keys.size)
        assert meet(x, y, bands, hot)
        met += 1
    assert met > 100


def test_word_hashes():
    texts = ["", " \n", "a", "A b\tC\r\x0b\x0cd", "x" * 64 + " " + "x" * 65 + " " + "x" * 66, "é É \u00a0 \x1c \x1d", "ab ba aab aba", "y" * 63 + " " + "y" * 64]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in texts]
    hashes = [ngramjoin.word_hashes(t.encode()).tolist() for t in texts]
    assert list(map(len, words)) == list(map(len, hashes))
    pairs = {(w, h) for ws, hs in zip(words, hashes) for w, h in zip(ws, hs)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_points_cover_all_sizes():
    bands = Bands(9, 10)
    assert bands.of(8) == -1 and bands.of(9) == 0
    for size in range(9, 900):
        for other in range(9, size + 1):
            common = bands.common(size, other)
            if common > other:
                continue
            band = bands.of(other)
            assert bands.of(size) - band in (0, 1)
            assert bands.points(size, band) > size + other - 2 * common
            assert bands.segments(band) >= bands.points(size, band)


def near_copies(rng, n, words=90, change=2, vocabulary=2000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, block_sets", [(1 << 21, 8192), (1 << 21, 16)])
def test_groups_of_near_copies(spark, monkeypatch, block, block_sets):
    """Groups around a text, links that only lead through others, and groups cut into blocks."""
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", block_sets)
    rng = random.Random(block_sets)
    texts = near_copies(rng, 70) + near_copies(rng, 40, 60, 1) + near_copies(rng, 30, 400, 9)
    chain = [f"c{i}" for i in range(150)]
    for i in range(25):  # each is linked to the next only
        texts.append(" ".join(chain))
        chain = chain[4:] + [f"d{i}.{j}" for j in range(4)]
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(ngramjoin.similar_documents(df)) == plain(rows)


@pytest.mark.parametrize("shingle, num, den", [(1, 1, 2), (3, 1, 1)])
def test_other_parameters(spark, shingle, num, den):
    rng = random.Random(shingle)
    texts = [t for _ in range(12) for t in near_copies(rng, 4, rng.choice([5, 12, 40, 100]), 6, 60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngramjoin.similar_documents(df, shingle=shingle, num=num, den=den)) == plain(rows, shingle, num, den)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(ngramjoin.similar_documents(odd_docs)) == plain([r[:2] for r in odd_rows])
    assert ngramjoin.similar_documents(no_docs).count() == 0
