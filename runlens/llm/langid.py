"""Language identification: a mixture of languages fitted to each document.

Training counts hashed character trigrams per language over every labelled
document (each task sums its own documents; Spark adds the tasks' sums).  A
language is a smoothed distribution over ``BUCKETS`` trigram buckets.

A document is a mixture: expectation-maximisation finds the proportions that
give its trigrams the greatest likelihood.  The set of languages grows from the
single best one; another joins only if the log-likelihood gains more than a
penalty (half the log of the trigram count, times ``WEIGHT`` since neighbouring
trigrams overlap).  The log-likelihood is concave in the proportions, so the
slope towards a language bounds what it can gain; where every slope is below
the penalty no fit is needed, and the result is the same.

The predicted language has the largest proportion, which is the score.

Defined results: null text and text without a letter give ``und`` and score 0,
as does everything when nothing was learned; null languages are not learned;
repeated rows count as often as they come; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 14
WEIGHT = 3.0
ROUNDS, TOLERANCE = 40, 1e-4
#: The model (languages x BUCKETS doubles) is sent to every executor; more languages than this are refused.
MAX_LANGUAGES = 1024
UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the character trigrams of a text, case folded, other than letters as one space; none without a letter."""
    letters = _GAPS.sub(" ", (text or "").lower()).strip()
    if not letters:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> log probability of each bucket, learned from all rows with a language."""
    small_batches(docs.sparkSession)

    def count(frames):
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                found = trigrams(text)
                if found.size:
                    sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    sums[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        table = np.zeros((len(languages), BUCKETS))
        found = counts.toPandas()  # at most MAX_LANGUAGES x BUCKETS numbers
    finally:
        counts.unpersist()
    table[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy(dtype=np.int64)] = found["n"]
    table = np.log((table + 0.1) / (table.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    return dict(zip(languages, table))


def mixture(counts: np.ndarray, logs: np.ndarray, weight: float = WEIGHT) -> np.ndarray:
    """Proportions of the languages (rows of ``logs``, over the buckets counted) in one document."""
    n, total = len(logs), counts.sum()
    single = logs @ counts
    share = np.zeros(n)
    share[int(single.argmax())] = 1.0
    if n == 1:
        return share
    peak = logs.max(axis=0)
    p = np.exp(logs - peak)
    penalty = weight * 0.5 * np.log(total + 1)
    mixed = share @ p
    while True:
        slope = p @ (counts / mixed) - total
        slope[share > 0] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= penalty:
            return share
        now = float(counts @ np.log(mixed))
        trial = share * 0.7
        trial[new] = 0.3
        use = np.flatnonzero(trial)
        part, pi = p[use], trial[use]
        for _ in range(ROUNDS):
            step = pi * (part @ (counts / (pi @ part))) / total
            moved, pi = np.abs(step - pi).max(), step
            if moved < TOLERANCE:
                break
        if float(counts @ np.log(pi @ part)) - now <= penalty:
            return share
        share = np.zeros(n)
        share[use] = pi
        mixed = share @ p


def predictor(model: dict[str, np.ndarray], weight: float = WEIGHT) -> Callable[[str | None], tuple[str, float]]:
    """text -> (language, score)."""
    names, logs = list(model), np.array(list(model.values())).reshape(len(model), BUCKETS)

    def predict(text):
        found = trigrams(text)
        if not found.size or not names:
            return UNKNOWN, 0.0
        counts = np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        share = mixture(counts[at].astype(float), logs[:, at], weight)
        best = int(share.argmax())
        return names[best], min(1.0, float(share[best]))

    return predict


def identify(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", weight: float = WEIGHT) -> Column:
    """struct(lang_pred, score) of a text column of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(batch: pd.Series) -> pd.DataFrame:
        predict = predictor(shared.value, weight)
        return pd.DataFrame([predict(t) for t in batch], columns=["lang_pred", "score"])

    return language(F.col(text_col))


def held_out(id_col: Column) -> Column:
    """Whether an id belongs to the fold that is never learned from (null: the fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document; learned from the other folds' documents."""
    own = docs.select("doc_id", "text", "lang")
    model = train(own.where(~held_out(F.col("doc_id"))))
    rows = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(own, model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents in no language: null texts, and texts without a letter."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    packed = docs.select(F.struct("*").alias("row"), identify(docs, model).alias("p"))
    return packed.where(F.col("p.lang_pred") != UNKNOWN).select("row.*")
