import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from runlens.llm import bpe, entry, langid, mixing

from .test_lines import plain as plain_lines
from .test_simhash import plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixture", "tokens"]


def test_against_brute_force(spark, small):
    """Every stage against a plain version of it, over what the stage before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    own = bpe.Tokenizer(open(entry.VOCABULARY, encoding="utf-8").read())
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, small), name)
        if name == "tokens":
            want = Counter((d, hashlib.sha256(own.encode(t).encode()).hexdigest()) for d, t in rows)
            assert Counter((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == want
            return
        assert out.columns == COLUMNS
        kept = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "language":
            assert sorted(kept) == sorted(r for r in rows if langid.trigrams(r[1]).size)
        elif name == "lines":
            assert sorted(kept) == sorted((d, k) for d, k, e, n in plain_lines(rows, 1, 24) if not (k == "" and e + n))
        elif name == "near_duplicates":
            assert sorted(d for d, _ in kept) == sorted({c for _, _, c in plain_groups(rows)})
        elif name == "mixture":
            copies = {r["id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert Counter(kept) == Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
        docs, rows = out, kept


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(spark, small, table, request):
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, small), name)
        assert name == "tokens" or docs.columns == columns
    assert docs.count() >= 0
