import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runlens.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, how = rng.randrange(len(out) + 1), rng.random()
        if how < 0.33:
            out.insert(at, rng.choice("abé😀 "))
        elif out and how < 0.66:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice("abé😀 ")
    return "".join(out)


def plain(rows, threshold, least):
    """(id, text) -> (kept text, lines that go as copies, lines that go as near copies), by brute force."""
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if len(line) >= max(least, threshold + 1) and (line not in first or key(d) < key(first[line])):
                first[line] = d
    group = {x: x for x in first}
    names = list(first)
    for i, a in enumerate(names):
        for b in names[:i]:
            if group[a] != group[b] and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                old = group[b]
                group = {x: group[a] if g == old else g for x, g in group.items()}
    best = {}
    for x, g in group.items():
        rank = (key(first[x]), hashlib.md5(x.encode()).digest())
        if g not in best or rank < best[g][0]:
            best[g] = (rank, x)
    out = []
    for d, t in rows:
        kept, exact, nearly, met = [], 0, 0, set()
        for line in t.split("\n") if t is not None else []:
            if line not in first:
                kept.append(line)
                continue
            stays = best[group[line]][1] == line
            if stays and first[line] == d and line not in met:
                met.add(line)
                kept.append(line)
            elif stays:
                exact += 1
            else:
                nearly += 1
        out.append((d, "\n".join(kept) if t is not None else None, exact, nearly))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["row"]["doc_id"], r["kept"], r["exact"], r["nearly"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(2500):
        a = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(4, 15)))
        rows.append((a, edited(rng, a, rng.randint(0, 5))))
    return rows, spark.createDataFrame(rows, "a string, b string").cache()


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(pairs, threshold):
    rows, df = pairs
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", linededup.near(a, b, threshold).alias("n"), linededup.may_be_near(a, b, threshold).alias("m")).collect():
        near = distance(r["a"], r["b"]) <= threshold
        assert r["n"] == near and (r["m"] or not near)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_near_lines_share_a_key(pairs, threshold):
    _, df = pairs
    f, p = linededup.keys(F.col("a"), F.length("a"), threshold, threshold + 1)
    g, q = linededup.keys(F.col("b"), F.length("b"), threshold, threshold + 1)
    near = df.where((F.levenshtein("a", "b") <= threshold) & (F.length("a") > threshold) & (F.length("b") > threshold))
    met = F.arrays_overlap(f, F.concat(g, q)) | F.arrays_overlap(g, F.concat(f, p))
    assert near.count() > 500 and near.where(~met).count() == 0


@pytest.mark.parametrize(("threshold", "least"), [(1, 24), (2, 10), (3, 30)])
def test_documents(spark, threshold, least):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 60))) for _ in range(25)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6)))) for i in range(70)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, rows[3][1]), (None, "é" * 40), rows[5], (5, base[0]), (5, base[0] + "\n" + base[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(linededup.dedup(df, threshold, least)) == plain(rows, threshold, least)


@pytest.mark.parametrize("paired", [1, 16])
def test_many_lines_with_one_key(spark, monkeypatch, paired):
    """Keys that many lines share are replaced by finer ones; no link is lost."""
    monkeypatch.setattr(linededup, "PAIRED", paired)
    rng = random.Random(paired)
    base = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(3)] + ["a" * 30]
    texts = [edited(rng, b, n) for b in base for n in [0, 1, 1, 1, 2, 2, 3] * 6]
    texts += [base[0][:20] + "".join(rng.choice("xyz") for _ in range(20)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[i::20])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert got(linededup.dedup(df, 1, 20)) == plain(rows, 1, 20)


def test_few_lines_get_finer_keys(spark, monkeypatch):
    """Lines that share a crowded half and nothing else are told apart by longer keys, not by one key a character."""
    finer, given = linededup.finer_pairs, []

    def counted(lines, *places):
        given.append(lines.count())
        return finer(lines, *places)

    monkeypatch.setattr(linededup, "finer_pairs", counted)
    rng = random.Random(7)
    half = "".join(rng.choice("abcdefgh ") for _ in range(40))
    texts = [half + "".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(60)]
    texts += [texts[0][:-5] + "#" + texts[0][-4:], texts[1][:50] + texts[1][51:], texts[2][:60] + "#" + texts[2][60:]]
    rows = [(i, "\n".join(texts[i::9])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain(rows, 1, 20)
    assert sum(n for *_, n in want) == 3
    assert got(linededup.dedup(df, 1, 20)) == want and given == [0]


def test_finer_pairs(spark):
    rng = random.Random(1)
    lines = sorted({edited(rng, "abcabbéa😀aab", rng.randint(0, 3)) for _ in range(300)})
    df = spark.createDataFrame([(t.encode(), t) for t in lines], "id binary, line string")
    group = {t: t for t in lines}

    def join(a, b):
        old = group[b]
        for t, g in group.items():
            if g == old:
                group[t] = group[a]

    for r in linededup.finer_pairs(df).collect():
        a, b = bytes(r["a"]).decode(), bytes(r["b"]).decode()
        assert distance(a, b) == 1
        join(a, b)
    found = dict(group)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            assert distance(a, b) > 1 or found[a] == found[b]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(linededup.dedup(odd_docs)) == plain([r[:2] for r in odd_rows], linededup.THRESHOLD, linededup.LEAST)
    assert linededup.dedup(no_docs).count() == 0


def test_stage(odd_docs, odd_rows, no_docs):
    out = linededup.drop_lines(odd_docs)
    assert out.columns == odd_docs.columns
    want = [r for r in plain([r[:2] for r in odd_rows], linededup.THRESHOLD, linededup.LEAST)]
    total = {}
    for d, t in [r[:2] for r in odd_rows]:
        total.setdefault((d, len((t or "").split("\n")) if t is not None else 0), 0)
    kept = out.collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str((d, k)) for d, k, e, n in want if not (k == "" and e + n))
    assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None and r["doc_id"] is not None)
    assert linededup.drop_lines(no_docs).count() == 0


def test_work_per_line(spark, odd_docs, monkeypatch):
    """The documents are read three times before the result; each time a text is split once, a line
    hashed once, and no whole line is shuffled but those that met another one."""
    plans = {}

    def recorded(df, name, *args, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialise(df, name, *args, **options)

    materialise = linededup.materialise
    monkeypatch.setattr(linededup, "materialise", recorded)
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        linededup.dedup(odd_docs)
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    reads = {name: (plan.count("split("), plan.count("md5(")) for name, plan in plans.items() if "md5(" in plan}
    assert reads == {"lines": (1, 1), "texts": (1, 1), "gone": (1, 1)}
    assert "Aggregate [line" not in plans["lines"]


def test_number_of_lines(odd_docs, odd_rows):
    lines = {r["row"]["text"]: r["lines"] for r in linededup.dedup(odd_docs).collect()}
    assert lines == {r[1]: 0 if r[1] is None else len(r[1].split("\n")) for r in odd_rows}


def test_query(run, table):
    want = {d: (e, n, hashlib.sha256(k.encode()).hexdigest()) for d, k, e, n in plain([(r["doc_id"], r["text"]) for r in table("documents")], linededup.THRESHOLD, linededup.LEAST)}
    assert {r["doc_id"]: (r["exact_removed"], r["near_removed"], r["kept_sha256"]) for r in run("op5_lines")} == want
