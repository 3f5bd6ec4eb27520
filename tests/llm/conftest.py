import random

import pytest

from runlens.llm import entry

#: Names that the operators use inside, here as columns of the input.
CLASHING = "id bigint, x string, row string, k1 string, size string, copies string, lines string, kept string, d1 string, key string, bucket string, label string, score string, target string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(4)
    line = sentence(rng, 14)
    texts = ["\n".join(sentence(rng) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += [None, "", " \n ", "123 456", "\n\n", line, line + "\n" + sentence(rng), line[:-2] + "x.", texts[0], texts[0], texts[1].upper()]
    texts += [" ".join(sentence(rng) for _ in range(1500)), "é Σ ΑΣ <|endoftext|> 'S ' x", "a" * 3000]
    rows = [(i * 3 % 101, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None, "é"]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[7], "en", "a", 1), (None, None, None, None, None), (None, texts[9], "de", None, 2)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    extra = len(CLASHING.split(","))
    return spark.createDataFrame([(*r, *([7] + ["clash"] * (extra - 1))) for r in odd_rows], f"{DOCS}, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    """The given tables at the smallest size."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def run(spark, small):
    """Rows of a registered query over the smallest tables, as dicts; run once."""
    done = {}

    def rows(name):
        if name not in done:
            done[name] = [r.asDict() for r in entry.QUERIES[name][0](spark, small).collect()]
        return done[name]

    return rows


@pytest.fixture(scope="session")
def table(spark, small):
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{small}/{name}.parquet").collect()]
