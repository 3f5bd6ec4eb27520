"""SimHash fingerprints and near-duplicate groups by covering LSH.

Fingerprint: one bit per position, set when more than half of the shingle
hashes have it set.  Groups: a family of 2^(r+1)-1 bit masks is built from a
map of the 64 positions to non-zero vectors of r+1 bits; mask ``v`` keeps the
positions whose vector has odd parity with ``v``.  The vectors of any r
positions span at most r dimensions, so some ``v`` is orthogonal to all of
them: every pair within the radius agrees on all kept bits of some mask and
meets in that table.  No pair can be missed.

Equal fingerprints are one node.  The members of a bucket are sorted next to
each other and checked in one pass that emits only a spanning forest of the
links, never all pairs.  Buckets over ``BLOCK`` members are cut into blocks,
and every pair of blocks is checked in a task of its own.

Defined results: null or empty text has fingerprint zero and links like any
other; null ids take part, but a component's id is its smallest non-null id
(null if it has none); repeated rows are returned as often as they come.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialise, small_batches

SEED = 42  # of XXH64
BLOCK = 4096  # bucket members checked in one go


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or b"").lower().split()


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest, grams = xxhash.xxh64_intdigest, zip(*(w[i:] for i in range(shingle)))
    hashes = np.fromiter((digest(g, SEED) for g in map(b" ".join, grams)), dtype="<u8", count=len(w) - shingle + 1)
    # a histogram of each byte position gives the bit counts in 8 look-ups a hash
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > hashes.size, bitorder="little").view("<u8")[0])


_OFFSETS = (np.arange(8) * 256).astype(np.uint16)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_column(text, shingle: int = 3):
    """A bigint column: the SimHash of a string column."""

    @F.pandas_udf(T.LongType())
    def simhash(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return simhash(text.cast("binary"))


def covering_masks(radius: int) -> list[int]:
    """The masks of the covering family, as signed 64-bit numbers."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + i % size for i in range(64)]
    masks = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the distinct values ``x``."""
    links, label = [], np.arange(x.size)
    for i in range(1, x.size):
        near = np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius)
        if near.size:
            trees, first = np.unique(label[near], return_index=True)
            links += [(int(x[i]), int(x[near[j]])) for j in first]
            label[: i + 1][np.isin(label[: i + 1], trees)] = i
    return links


def _links_of_sorted(radius: int, block: int):
    """Runs of equal (t, k) in a sorted partition -> links, or a mark for a run over ``block``."""

    def runs(frames):
        held = None  # rows of the run that the last frame left open
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            t, k, x = (frame[c].to_numpy() for c in ("t", "k", "x"))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate(([0], cut))
            if len(frame) - starts[-1] > block:  # an open run that is too large already: its mark is enough
                held = frame.iloc[starts[-1] : starts[-1] + block + 1]
            else:
                held = frame.iloc[starts[-1] :]
            yield from emit(t, k, x, starts[:-1], cut)
        if held is not None and len(held):
            t, k, x = (held[c].to_numpy() for c in ("t", "k", "x"))
            yield from emit(t, k, x, np.array([0]), np.array([len(held)]))

    def emit(t, k, x, starts, ends):
        length = ends - starts
        two = starts[length == 2]
        close = two[np.bitwise_count(x[two].view(np.uint64) ^ x[two + 1].view(np.uint64)) <= radius]
        rows = [pd.DataFrame({"t": np.int32(-1), "a": x[close], "b": x[close + 1]})]
        for s, e in zip(starts[length > 2], ends[length > 2]):
            if e - s > block:
                rows.append(pd.DataFrame({"t": [t[s]], "a": [k[s]], "b": [np.int64(0)]}))
            elif links := spanning_links(x[s:e].view(np.uint64), radius):
                pairs = np.array(links, dtype=np.uint64).view(np.int64)
                rows.append(pd.DataFrame({"t": np.int32(-1), "a": pairs[:, 0], "b": pairs[:, 1]}))
        yield pd.concat(rows, ignore_index=True).astype({"t": "int32", "a": "int64", "b": "int64"})

    return runs


def _links_of_blocks(radius: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        pairs = np.array(spanning_links(group["x"].to_numpy().view(np.uint64), radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return links


def links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``prints.x`` within ``radius`` bits."""
    spark = prints.sparkSession
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("x").bitwiseAND(F.lit(m).cast("bigint")).alias("k"))
        for t, m in enumerate(covering_masks(radius))
    ]))
    keyed = prints.select(tables.alias("h"), "x").select("h.t", "h.k", "x")
    found = materialise(
        keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInPandas(_links_of_sorted(radius, block), "t int, a bigint, b bigint"), "links")
    hot = found.where("t >= 0").select("t", F.col("a").alias("k")).distinct()
    members = keyed.join(hot, ["t", "k"])
    blocks = members.groupBy("t", "k").agg(F.ceil(F.count(F.lit(1)) / F.lit(block / 2)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("x"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = members.join(blocks, ["t", "k"]).select("t", "k", "x", own.alias("i"), other.alias("j"))
    dealt = dealt.select("t", "k", "x", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    split = dealt.groupBy("t", "k", "i", "j").applyInPandas(_links_of_blocks(radius), "a bigint, b bigint")
    return found.where("t < 0").select("a", "b").unionByName(split)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (bigint), text_key (XXH64 of the text) and component_id.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own included.  ``keep`` is true for
    the rows that stand for their group: smallest id, then smallest text_key.
    """
    small_batches(docs.sparkSession)
    # a column of the input may have any name: only these two are taken, under names of our own
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = materialise(rows.select("id", F.xxhash64("text").alias("text_key"), fingerprint_column(F.col("text"), shingle).alias("x")), "prints")
    nodes = prints.groupBy("x").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first"))
    nodes = materialise(nodes, "nodes")
    roots = components(links(nodes.select("x"), radius))
    placed = nodes.join(roots, nodes["x"] == roots["node"], "left").select("x", "first", F.coalesce("root", "x").alias("root"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    label = placed.join(best, "root").select("x", "best")
    return prints.join(label, "x").select(
        "id", F.col("x").alias("fingerprint"), "text_key", F.col("best.id").alias("component_id"),
        (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.text_key") == F.col("text_key"))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group: the smallest id (of equal ids the smallest text key)."""
    def keyed(df, text_key):  # null ids as a key of plain columns
        return df.withColumns({"k1": F.coalesce("id", F.lit(0)), "k2": F.col("id").isNull(), "k3": text_key})

    keys = ["k1", "k2", "k3"]
    kept = near_duplicates(docs, id_col, text_col, shingle, radius).where("keep")
    kept = keyed(kept, F.col("text_key")).select(*keys).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = keyed(packed, F.xxhash64("text")).drop("text")
    return packed.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
