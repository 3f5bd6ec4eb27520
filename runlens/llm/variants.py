"""Spelling variants: blocked Gram matrices of letter counts, edits verified.

A word is a vector of letter counts.  One replaced code point changes the
squared distance of two vectors to exactly two, one inserted or deleted code
point changes it to exactly one, so near words lie at squared distance at most
two in the same or in adjacent length blocks.  Distances of whole blocks come
from one NumPy product each (|a|^2 + |b|^2 - 2 a.b); the pairs kept are verified
letter by letter.

Length blocks are cut further into cells: the alphabet is dealt into ``GROUPS``
groups of letters of similar total count, and a cell holds the words with equal
counts in each group.  An inserted code point raises one group's count by one,
a replaced one leaves all counts or moves one from a group to another, so a
word's near words lie in few neighbouring cells, known beforehand.  Each pair of
cells meets at one of the two (its home); home words are held in blocks of
bounded size while the other words stream by.

Defined results: null texts have no words and null ids are the empty text; words
with fewer code points or occurrences than asked are left out; of near words
that occur equally often the first in code-point order is the form; a word
without near words has n_near 0.  Repeated rows count as often as they come.
Other columns are not read; an empty table has no words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LETTERS = "A-Za-zÀ-ÿ"
GROUPS = 5
HOME_WORDS, HOME_BYTES = 2048, 1 << 22  # bounds of a block of home words
PRODUCT = 1 << 22  # elements of one Gram matrix at most


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6) -> DataFrame:
    """``word`` per run of letters, one code point short where ``every`` divides the run's checksum."""
    # runs shorter than ``least`` only get shorter
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))
    rows = rows.select("id", lower_ascii(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6, count: int = 5) -> DataFrame:
    """Distinct words and their number n."""
    return occurrences(docs, id_col, text_col, every, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters met, dealt into groups of similar weight (the alphabet bounds what reaches the driver)."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    out, weight = [""] * groups, [0] * groups
    for r in sorted((r for r in letters if r["c"]), key=lambda r: (-r["n"], r["c"])):
        lightest = weight.index(min(weight))
        out[lightest] += r["c"]
        weight[lightest] += r["n"]
    return out


def _neighbours(groups: int) -> list[list[int]]:
    """Home cell minus own cell, for each cell pair in which a word is the one that streams by."""
    def unit(*signs):
        step = [0] * groups
        for i, s in signs:
            step[i] += s
        return step

    same, shorter = [unit()], [unit((i, -1)) for i in range(groups)]
    return same + shorter + [unit((i, -1), (j, 1)) for i in range(groups) for j in range(i + 1, groups)]


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts (words x 256) of a matrix of Latin-1 codes of equally long words."""
    n = len(codes)
    flat = codes.astype(np.int64) + 256 * np.arange(n)[:, None]
    return np.bincount(flat.ravel(), minlength=256 * n).reshape(n, 256).astype(np.float32)


def codes_of(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equally long words differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` are rows of ``a`` with one code point more."""
    width = a.shape[1]
    front = np.logical_and.accumulate(a == b[:, :width], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= width


class Home:
    """A block of equally long words that others are compared with."""

    def __init__(self, words: list[str]):
        self.words, self.codes = np.array(words, dtype=object), codes_of(words)
        self.length = self.codes.shape[1]
        full = counts(self.codes)
        self.used = np.flatnonzero(full.any(axis=0))
        self.counts, self.square = full[:, self.used], (full * full).sum(axis=1)

    def near(self, words: list[str], same_cell: bool):
        """Pairs (home word, other word) at one edit; the others are equally long or longer by one."""
        step = max(1, PRODUCT // len(self.words))
        for at in range(0, len(words), step):
            other = words[at : at + step]
            codes = codes_of(other)
            full = counts(codes)
            gram = full[:, self.used] @ self.counts.T
            want = 2 if codes.shape[1] == self.length else 1
            gram *= -2
            gram += (full * full).sum(axis=1)[:, None]
            gram += self.square
            j, i = np.nonzero(gram == want)
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = replaced(self.codes[a], codes[b]) if want == 2 else inserted(self.codes[a], codes[b])
                one, two = self.words[a[ok]], np.array(other, dtype=object)[b[ok]]
                if same_cell:
                    once = one < two
                    one, two = one[once], two[once]
                yield one, two


def _pairs_of_sorted(frames):
    """Rows sorted by (cell, block, kind): home words (kind 0), then words that stream by."""
    key, home, held = None, None, []
    for frame in frames:
        out = []
        bounds = frame[["cell", "block", "kind"]].ne(frame[["cell", "block", "kind"]].shift()).any(axis=1).to_numpy().nonzero()[0]
        for s, e in zip(bounds, [*bounds[1:], len(frame)]):
            part = frame.iloc[s:e]
            cell, block, kind = part["cell"].iat[0], part["block"].iat[0], part["kind"].iat[0]
            if (cell, block) != key:
                key, home, held = (cell, block), None, []
            if kind == 0:
                held += part["word"].tolist()
                continue
            if home is None and held:
                home, held = Home(held), []
            if home is not None:
                out += home.near(part["word"].tolist(), kind == 1)
        yield pd.DataFrame({"a": np.concatenate([a for a, _ in out]) if out else [], "b": np.concatenate([b for _, b in out]) if out else []}, dtype=object)


def near_words(words: DataFrame, groups: int = GROUPS, home_words: int = HOME_WORDS) -> DataFrame:
    """Pairs (a, b) of the distinct ``words.word`` at exactly one edit, each once."""
    words = words.select("word")
    letters = letter_groups(words, groups)

    def cell_of(i: int) -> Column:  # letters of a group in the word
        return F.length("word") - F.length(F.translate("word", letters[i], "")) if letters[i] else F.lit(0)

    own = words.select("word", F.array(*[cell_of(i) for i in range(groups)]).alias("own"))
    name = lambda a: F.array_join(a.cast("array<string>"), " ")
    homes = own.select("word", name(F.col("own")).alias("cell"), F.length("word").alias("len"))
    rows_a_block = F.greatest(F.lit(1), F.least(F.lit(home_words), F.floor(F.lit(HOME_BYTES) / F.col("len"))))
    cells = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("words"), F.first("len").alias("len"))
    cells = cells.select("cell", F.ceil(F.col("words") / rows_a_block).cast("int").alias("blocks"))
    steps = F.array(*[F.struct(F.lit(1 if not any(s) else 2 + (sum(s) == 0)).alias("kind"), F.array(*[F.lit(x) for x in s]).alias("step")) for s in _neighbours(groups)])
    to = own.select("word", "own", F.explode(steps).alias("t")).select("word", "t.kind", name(F.zip_with("own", "t.step", lambda a, b: a + b)).alias("cell"))
    by = to.join(cells, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "kind", "word")
    held = homes.join(cells, "cell").select("cell", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "word")
    dealt = held.unionByName(by).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return dealt.mapInPandas(_pairs_of_sorted, "a string, b string")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6, count: int = 5, ratio: int = 5, **options) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    if ratio < 2:
        raise ValueError("a form occurs at least twice as often as the word")
    words = materialise(vocabulary(docs, id_col, text_col, every, least, count), "words")
    pairs = materialise(near_words(words, **options), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # the most frequent near word, of several the first: least of (-n, word)
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    rows = words.join(best, words["word"] == best["a"], "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    rows = materialise(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    # a form occurs at least ``ratio`` times as often, so chains are short: pointers are doubled until all have arrived
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1
    hops = 1
    while count * ratio**hops <= most:
        hops *= 2
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        links = materialise(links.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "links")
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
