"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches.

A document is the set of its paragraphs' digests (lines, long ones cut after
sentences; the n-th copy of a paragraph has a digest of its own).  A sketch
files every digest in one cell of each of three parts; a cell holds a count, a
sum of digests and a sum of checks (modulo 2^64).  Two sketches of one size
subtract cell by cell; what remains is the difference of the two sets, and
cells that hold a single digest are peeled off until nothing is left.  If some
cells are left, both documents are sketched again four times as large.

The fingerprint is the first-size sketch.  Equal texts have equal fingerprints.

Likeness of two documents: twice the shared digests over all digests of both
(from the recovered difference); 1 for two documents without a paragraph.

All documents of a batch are sketched and peeled together in numpy.

Defined results: a null text is empty; empty lines are no paragraphs; an empty
text has the sketch of zeros.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Cells of each of the three parts of the first sketch, and the growth of the next one.
CELLS, GROWTH = 8, 4
_CUT = re.compile(r"\n+|(?<=[.!?])\s+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def digests(text: str | None) -> np.ndarray:
    """The digests of a text's paragraphs."""
    import xxhash

    seen: dict[str, int] = {}
    out = []
    for part in _CUT.split(text or ""):
        if part:
            n = seen[part] = seen.get(part, -1) + 1
            out.append(xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), n))
    return np.array(out, dtype=np.uint64)


def _mixed(d: np.ndarray, part: int) -> np.ndarray:
    d = (d ^ (d >> np.uint64(31))) * _MIX[part]
    return d ^ (d >> np.uint64(29))


def checks(d: np.ndarray) -> np.ndarray:
    return _mixed(d, 3)


def places(d: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each part: 3 rows."""
    return np.array([_mixed(d, p) % np.uint64(cells) + np.uint64(p * cells) for p in range(3)], dtype=np.int64).reshape(3, -1)


class Sketches:
    """Sketches of one size for many documents."""

    def __init__(self, sets: list[np.ndarray], cells: int):
        self.cells, self.n = cells, len(sets)
        d = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.count, self.sum, self.check = (np.zeros(3 * cells * self.n, dtype=t) for t in (np.int64, np.uint64, np.uint64))
        self._add(d, of, np.ones(len(d), np.int64))

    def _add(self, d: np.ndarray, of: np.ndarray, sign: np.ndarray) -> None:
        c, s = checks(d), sign.astype(np.uint64)  # -1 is 2^64 - 1: sums are modulo 2^64
        for row in places(d, self.cells):
            at = row + of * (3 * self.cells)
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, d * s)
            np.add.at(self.check, at, c * s)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches([], self.cells)
        out.n, out.count, out.sum, out.check = self.n, self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def text(self, i: int) -> str:
        """The fingerprint of document ``i`` as text."""
        at = slice(3 * self.cells * i, 3 * self.cells * (i + 1))
        return base64.b85encode(self.count[at].astype("<u2").tobytes() + self.sum[at].astype("<u8").tobytes() + (self.check[at] >> np.uint64(32)).astype("<u4").tobytes()).decode()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests, their documents, their signs; and which documents came out whole."""
        got_d, got_of, got_sign, width = [], [], [], 3 * self.cells
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            d = self.sum[at] * self.count[at].astype(np.uint64)
            sound = checks(d) == self.check[at] * self.count[at].astype(np.uint64)
            # a digest belongs in its cell: else the cell holds several by chance
            own = places(d, self.cells)[at % width // self.cells, np.arange(len(at))] == at % width if len(at) else np.empty(0, bool)
            at, d = at[sound & own], d[sound & own]
            if not len(at):
                break
            of, sign = at // width, self.count[at]
            _, first = np.unique(np.stack([of.astype(np.uint64), d]), axis=1, return_index=True)
            d, of, sign = d[first], of[first], sign[first]
            self._add(d, of, -sign)
            got_d.append(d), got_of.append(of), got_sign.append(sign)
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        whole = ~left.reshape(self.n, width).any(axis=1) if self.n else np.empty(0, bool)
        if not got_d:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), whole
        return np.concatenate(got_d), np.concatenate(got_of), np.concatenate(got_sign), whole


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets: the digests of only the first, and of only the second."""
    out: list = [None] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        first, second = Sketches([a[i] for i in todo], cells), Sketches([b[i] for i in todo], cells)
        d, of, sign, whole = first.minus(second).peel()
        order = np.argsort(of, kind="stable")
        d, of, sign = d[order], of[order], sign[order]
        ends = np.searchsorted(of, np.arange(len(todo) + 1))
        for j in np.flatnonzero(whole):
            s = slice(ends[j], ends[j + 1])
            out[todo[j]] = d[s][sign[s] > 0], d[s][sign[s] < 0]
        todo, cells = todo[~whole], cells * GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Likeness of each pair, from the recovered differences."""
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differences(a, b)):
        both = len(x) + len(y)
        out.append((both - len(only_x) - len(only_y)) / both if both else 1.0)
    return out


def fingerprints(texts) -> list[str]:
    s = Sketches([digests(t) for t in texts], CELLS)
    return [s.text(i) for i in range(s.n)]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SHAPE = "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(frames):
    """Rows in order (a row, then the one that follows it) -> the fingerprints of every row that is no copy."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        yield from _compared(frame)
        held = frame.iloc[-1:]


def _compared(f: pd.DataFrame):
    bucket, copy = f["bucket"].to_numpy(), f["copy"].to_numpy()
    at = np.flatnonzero((bucket[1:] == bucket[:-1]) & ~copy[:-1])
    texts = [t or "" for t in f["text"]]
    own = [texts[i] for i in at]
    new = [edited(texts[i], texts[i + 1]) for i in at]
    sets = {i: digests(texts[i]) for i in sorted({*at, *(at + 1)})}
    a, n, e = [sets[i] for i in at], [sets[i + 1] for i in at], [digests(t) for t in new]
    first, second = Sketches(a, CELLS), Sketches(e, CELLS)
    yield pd.DataFrame({
        "doc_id": f["doc_id"].iloc[at].to_numpy(), "n_chars": np.array([len(t) for t in own], dtype=np.int64),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        "fingerprint": [first.text(i) for i in range(len(at))], "edited_fingerprint": [second.text(i) for i in range(len(at))],
        "near_edited": likeness(a, e), "near_next": likeness(a, n),
    })


def compare_editions(docs: DataFrame, pieces: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text and against the next document, by descending id.

    Null ids come last, in the order of their texts' hashes; equal ids are
    ordered likewise.  After the last document comes the first.

    The ids are cut into ``pieces`` ranges.  A range's rows are sorted in one
    task, and the first row of the next range is copied to its end, so that
    each text is shuffled once and neighbours meet without a global order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = pieces or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shares = [i / pieces for i in range(1, pieces)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 5 * pieces).alias("cuts")).first() if shares else None
    cuts = sorted({int(c) for c in found["cuts"] or ()}) if found else []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    below = F.size(F.filter(bounds, lambda c: c > F.col("doc_id")))  # 0 for the largest ids
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(below).cast("int")
    rows = rows.withColumns({"bucket": bucket, "o2": F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "o3": F.xxhash64("text")})
    # at most one row for each range reaches the driver
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("o2", "o3")).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return rows.select("doc_id").where("false").mapInPandas(lambda frames: frames, _SHAPE).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    first = {r["bucket"]: (r["first"]["o2"], r["first"]["o3"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)}
    o2, o3, to = (F.get(F.array(*[F.lit(first.get(b, (0, 0, None))[k]).cast("bigint") for b in range(len(cuts) + 2)]), F.col("bucket")) for k in range(3))
    leads = (o2 == F.col("o2")) & (o3 == F.col("o3"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    copy = F.struct(to.cast("int").alias("bucket"), F.lit(True).alias("copy"))
    dealt = rows.withColumn("to", F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own)))).select("to.bucket", "to.copy", F.col("doc_id").cast("string").alias("doc_id"), "text", "o2", "o3")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "copy", "o2", "o3").select("bucket", "copy", "doc_id", "text")
    return dealt.mapInPandas(_compare, _SHAPE).withColumn("doc_id", F.col("doc_id").cast("bigint"))
