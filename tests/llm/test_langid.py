import zlib

import numpy as np
from pyspark.sql import functions as F

from runlens.llm import langid


def brute_mixture(counts, logs, weight=langid.WEIGHT):
    """Best proportions of every set of languages that grows by the greatest penalised gain."""
    def fit(use):
        p, pi = np.exp(logs[use]), np.full(len(use), 1 / len(use))
        for _ in range(400):
            pi = pi * (p @ (counts / (pi @ p))) / counts.sum()
        return float(counts @ np.log(pi @ p)), pi

    use = [int((logs @ counts).argmax())]
    best, pi = fit(use)
    while len(use) < len(logs):
        gain, new = max((fit(use + [k])[0] - best, k) for k in range(len(logs)) if k not in use)
        if gain <= weight * 0.5 * np.log(counts.sum() + 1):
            break
        use.append(new)
        best, pi = fit(use)
    share = np.zeros(len(logs))
    share[use] = pi
    return share


def test_mixture_matches_brute_force():
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.full(60, 0.3), size=4) * 0.99 + 0.01 / 60)
    for true in ([1, 0, 0, 0], [0.6, 0.4, 0, 0], [0.3, 0.3, 0.4, 0], [0, 0, 0.02, 0.98]):
        counts = rng.multinomial(800, np.array(true) @ np.exp(logs) / (np.array(true) @ np.exp(logs)).sum()).astype(float)
        assert np.abs(langid.mixture(counts, logs) - brute_mixture(counts, logs)).max() < 0.05


def test_held_out_accuracy(run, table):
    lang = {r["doc_id"]: r["lang"] for r in table("documents")}
    rows = run("op2_language")
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_training_counts(spark):
    docs = spark.createDataFrame([("ab", "x"), ("ab ab", "x"), (None, "x"), ("zz", None), ("12", "y")], "text string, lang string")
    model = langid.train(docs)
    assert list(model) == ["x"]
    grams = np.concatenate([langid.trigrams("ab"), langid.trigrams("ab ab")])
    want = np.bincount(grams, minlength=langid.BUCKETS) + 0.1
    assert np.allclose(model["x"], np.log(want / want.sum()))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = langid.predict_documents(odd_docs).collect()
    assert len(got) == len(odd_rows)
    texts = {}
    for r in odd_rows:
        texts.setdefault(r[0], set()).add(any(c.isalpha() for c in r[1] or ""))
    for r in got:
        if len(texts[r["doc_id"]]) == 1:
            assert (r["lang_pred"] == "und") == (not next(iter(texts[r["doc_id"]])))
        assert r["lang_pred"] in ("en", "de", "und") and (r["lang_pred"] != "und" or r["score"] == 0)
    assert langid.predict_documents(no_docs).count() == 0


def test_stage_keeps_clean_rows_and_columns(odd_docs, odd_rows, no_docs):
    kept = langid.drop_unknown(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted((r[1] for r in odd_rows if any(c.isalpha() for c in r[1] or "")))
    assert sorted(r["text"] for r in kept.collect()) == want
    assert langid.drop_unknown(no_docs).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [tuple(r)[2:] for r in langid.predict_documents(docs).collect()] == [("und", 0.0)]


def test_null_id_is_in_the_fold_of_the_empty_text(spark):
    row = spark.range(1).select(langid.held_out(F.lit(None).cast("bigint")).alias("h")).first()
    assert row["h"] == (zlib.crc32(b"") % 5 == 0)
