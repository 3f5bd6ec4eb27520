import hashlib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import bpe, entry

tokenizers = pytest.importorskip("tokenizers")
REFERENCE = tokenizers.Tokenizer.from_file(entry.VOCABULARY)
OWN = bpe.Tokenizer(open(entry.VOCABULARY, encoding="utf-8").read())


def plain(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abcdehinorst 'sS.!<|>1")))))
def test_same_ids_and_text_as_the_library(text):
    ids = plain(text)
    assert OWN.encode(text) == " ".join(map(str, ids))
    assert OWN.decode(OWN.encode(text)) == REFERENCE.decode(ids, skip_special_tokens=False)


MARKS = [chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))]


def test_marks_of_all_years():
    """Marks that the library's tables do not have yet, in every order."""
    rng = random.Random(5)
    for text in ["a\u033d\u1df9", "a\u0301\u08d2", "\u0e49\u1ac7\u1ac8x"] + [
            "".join(rng.choice(MARKS) if rng.random() < 0.6 else rng.choice("aeo1 \u00e9\u0f71") for _ in range(rng.randint(1, 8))) for _ in range(20000)]:
        assert OWN.encode(text) == " ".join(map(str, plain(text)))


def test_one_very_long_word(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_STATES", 20)
    own = bpe.Tokenizer(open(entry.VOCABULARY, encoding="utf-8").read())
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    assert own.encode(word) == " ".join(map(str, plain(word)))
    assert len(own.automaton.known) <= 2 * bpe.TABLE_STATES + 2


def merged(word, merges):
    """Merging by rank, pair by pair."""
    parts = list(word)
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        pair = tuple(parts[min(ranked)[1]:][:2])
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i:i + 2]) == pair:
                out.append("".join(pair))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_automaton_of_any_merge_list(data):
    tokens, merges = ["a", "b", "c"], []
    for _ in range(data.draw(st.integers(0, 12))):
        pair = data.draw(st.tuples(st.sampled_from(tokens), st.sampled_from(tokens)))
        if "".join(pair) not in tokens:
            tokens.append("".join(pair))
            merges.append(pair)
    ends = [t + "</w>" for t in "abc"]
    automaton = bpe.Automaton({t: i for i, t in enumerate(tokens + ends)}, merges)
    ranks = {m: i for i, m in enumerate(merges)}
    for word in data.draw(st.lists(st.text(alphabet="abc", min_size=1, max_size=14), max_size=20)):
        parts = merged([*word[:-1], word[-1] + "</w>"], ranks)
        assert [(tokens + ends)[i] for i in automaton.word(word)] == parts


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton({t: i for i, t in enumerate(["a", "aa", "aaa"])}, [("a", "a"), ("aa", "a"), ("a", "aa")])


def test_bounded_tables_and_caches(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_STATES", 50)
    monkeypatch.setattr(bpe, "CACHED_BYTES", 5 * bpe.ENTRY_BYTES)
    own = bpe.Tokenizer(open(entry.VOCABULARY, encoding="utf-8").read())
    text = "the quick brown fox jumps over lazy dogs and the quick onatstering brown fox again " * 3
    assert own.encode(text) == " ".join(map(str, plain(text)))
    assert len(own.words) <= 5


def test_query(run, table):
    want = {}
    for r in table("documents"):
        ids = plain(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(REFERENCE.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run("op1_bpe")} == want


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = entry.encode_documents(odd_docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((r[0] or -1, len(plain(r[1]))) for r in odd_rows)
    assert entry.encode_documents(no_docs).count() == 0


def test_id_array(spark):
    got = spark.createDataFrame([("1 20 3",), ("",)], "ids string").select(bpe.id_array(F.col("ids")).alias("a")).collect()
    assert [r["a"] for r in got] == [[1, 20, 3], []]
