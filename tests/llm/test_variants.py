import random
import re
import zlib
from collections import Counter

import pytest

from runlens.llm import variants


def edit_neighbours(word, known):
    letters = {c for w in known for c in w}
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    return {w for w in out if w in known and w != word}


def plain_words(rows, every=199, least=6, count=5):
    n = Counter()
    for i, text in rows:
        for r in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m.group().lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % every == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            n[low] += len(low) >= least
    return {w: c for w, c in n.items() if c >= count and len(w) >= least}


def plain(rows, every=199, least=6, count=5, ratio=5):
    n = plain_words(rows, every, least, count)
    near = {w: edit_neighbours(w, n) for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = df.collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(run, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents")]
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in run("op13_variants")}
    assert got == plain(rows) and any(r[1] for r in got)


def word_rows(rng):
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    base += ["abcdef", "abcdeg", "abcdefg", "bacdef", "aaaaaaa", "aaaaaa", "aaaaaaaa", "y" * 300, "y" * 301, "×÷×÷×÷", "×÷×÷×"]
    for w in list(base):
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1:], w[:i] + rng.choice("abz") + w[i + 1:], w + "a"]
    words = [w for w in base for _ in range(rng.choice([1, 2, 5, 9, 40, 220]))]
    rng.shuffle(words)
    return [(i, " ".join(words[i::90]).title() if i % 7 else "1".join(words[i::90])) for i in range(90)]


@pytest.mark.parametrize("groups, home_words", [(5, 2048), (3, 1)])
def test_near_words(spark, groups, home_words):
    rng = random.Random(groups)
    known = plain_words(word_rows(rng), least=1, count=1)
    df = spark.createDataFrame([(w,) for w in known], "word string")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in variants.near_words(df, groups, home_words).collect()]
    want = {tuple(sorted((w, x))) for w in known for x in edit_neighbours(w, known)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("every, least, count, ratio", [(199, 6, 5, 5), (2, 4, 1, 2)])
def test_variants(spark, every, least, count, ratio):
    rows = word_rows(random.Random(every))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(variants.variants(df, every=every, least=least, count=count, ratio=ratio)) == plain(rows, every, least, count, ratio)


def test_long_chains(spark):
    """Every word is a variant of the next, five times as frequent."""
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg"]
    rows = [(i, " ".join(w for j, w in enumerate(words) for _ in range(5 ** (j + 1) // 25 + (i < 5 ** (j + 1) % 25)))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain(rows, every=10**10)
    assert got(variants.variants(df, every=10**10)) == want and {r[2] for r in want} == {"akjihg"}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(variants.variants(odd_docs, least=3, count=1)) == plain([r[:2] for r in odd_rows], least=3, count=1)
    assert variants.variants(no_docs).count() == 0


def test_ratio(spark, no_docs):
    with pytest.raises(ValueError):
        variants.variants(no_docs, ratio=1)
