"""Jaccard join of documents on word n-grams by a partitioned universe.

A document is the set of its distinct shingles.  Sets are sorted into size
bands; in a band with room for at most H differing shingles between two sets,
every shingle is hashed into one of H + 1 segments, which cuts a set into as
many subsets.  Every set is indexed in its own band under each subset, and in
the first segments also under each subset less one shingle.  A set looks for
partners of its own or smaller size in its own band and in the one below.

Pigeonhole: a set that may differ from a partner in h shingles spends h + 1
points on segments.  One point looks up the subset itself; a second point on one
of the first segments also finds subsets that differ by one shingle (its own
less one, and the indexed less one).  If all of these miss, the sets differ in
more than h shingles, so no pair is lost however the points are dealt.  They
are dealt by cost: a subset that many documents share costs that number (counted
over all documents; the most frequent are sent to the tasks, at most ``HOT_KEYS``
numbers), one shingle less costs its number of look-ups.  Thus a passage that a
third of the documents repeat is not looked up where the set has other subsets.

Sets that meet under a key are candidates.  A key gives one edge per set, never
pairs; sets connected by such edges form a group, and only within a group are sets
compared: sizes, then parity bitmaps (their distance never exceeds the number
of differing shingles), then the sets themselves, exactly.  Sets that are already
connected by links are not compared again.  Groups beyond ``BLOCK`` shingles are cut
into blocks: first each block alone, then one set of each class that this found,
and only sets that are still apart after that meet in pairs of blocks.  Before texts
are shuffled to their groups, a bit map of fixed size keeps most others back.

Equal sets are one node: a 64-bit digest, whose clashes are looked for (and
raise an error); shingles are 64-bit hashes.

Defined results: null or empty text has an empty set, is linked with nothing and
is a component of its own; null ids take part, but a component's id is its
smallest non-null id (null if it has none); repeated rows are returned as often
as they come.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, small_batches
from .linededup import sieve

HOT_KEYS, LEAST_HOT = 1 << 17, 64  # keys sent to the tasks at most; number of documents that makes a key frequent at least
BLOCK, BLOCK_SETS = 1 << 21, 8192  # shingles and sets compared in one go
NODES_SEEN, HELD = 200_000, 1 << 20  # bounds of what a task remembers
BITS = 512  # of a parity bitmap
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEYS = "key bigint, ord int, node bigint"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _random(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


LONG = 64  # bytes of a word that the tables hash
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BYTE, _PLACE = _random(256, 1), _random(LONG, 2) | np.uint64(1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, all words at once: a sum over bytes and places."""
    letters = np.frombuffer(text.lower(), np.uint8)  # of bytes: A-Z only
    gap = np.ones(letters.size + 2, bool)
    gap[1:-1] = _GAP[letters]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    if not starts.size:
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    value = _BYTE[letters[~gap[1:-1]]] * _PLACE[np.minimum(place, LONG - 1)]
    h = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > LONG):
        import xxhash

        h[i] = xxhash.xxh64_intdigest(letters[starts[i] : starts[i] + lengths[i]].tobytes())
    return h


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text; fewer words than ``size`` are one shingle."""
    h = word_hashes(text or b"")
    if not h.size:
        return h
    span = min(size, h.size)
    out = np.full(h.size - span + 1, span, np.uint64)
    for i in range(span):
        out = out * _ODD + h[i : h.size - span + 1 + i]
    out = np.sort(mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Bands:
    """Size bands for Jaccard similarities of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # the smallest size that may have a partner of another size
        self.least = -(-num // (den - num)) if num < den else None
        self.low: list[int] = []
        self.high: list[int] = []
        self._points: dict[tuple[int, int], int] = {}

    def segments(self, band: int) -> int:
        top = self.high[band]
        return (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num) + 1

    @staticmethod
    def widened(segments: int) -> int:
        """The first segments that are also indexed less one shingle."""
        return max(1, segments // 16)

    def of(self, size: int) -> int:
        """The band of a size (-1: none)."""
        if self.least is None or size < self.least:
            return -1
        while not self.high or self.high[-1] < size:
            low = self.high[-1] + 1 if self.high else self.least
            self.low.append(low)
            self.high.append(max(low, low * self.den // self.num))
        return bisect_left(self.high, size)

    def common(self, a: int, b: int) -> int:
        """The least size of the intersection of similar sets."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def points(self, size: int, band: int) -> int:
        """Points to spend on partners of at most ``size`` in ``band``; 0 if there can be none."""
        if (size, band) in self._points:
            return self._points[size, band]
        s = np.arange(self.low[band], min(self.high[band], size) + 1)
        common = -(-self.num * (s + size) // (self.num + self.den))
        s, common = s[common <= s], common[common <= s]
        if len(self._points) > 1 << 16:
            self._points.clear()
        return self._points.setdefault((size, band), int((s + size - 2 * common).max()) + 1 if s.size else 0)


def cut(mixed: np.ndarray, band: int, segments: int):
    """Of a set's mixed shingles in a band: the segment of each, the sums of the subsets and the salts of the segments."""
    at = (((mixed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, at, mixed)
    salts = mix((np.uint64(band) << np.uint64(32)) + np.arange(segments, dtype=np.uint64) + _ODD)
    return at, sums, salts


def whole_keys(sums: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return mix(sums ^ salts)


def less_keys(sums: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return mix(sums ^ ~salts)


def signatures(x: np.ndarray, bands: Bands, hot: np.ndarray, hot_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and their kinds: 0 indexed and looked up, 1 looked up, 2 indexed."""
    keys, kinds = [], []

    def add(k, kind):
        keys.append(k)
        kinds.append(np.full(k.size, kind, np.int32))

    own, mixed = bands.of(x.size), mix(x)
    for band in (own, own - 1):
        if band < 0:
            continue
        m = bands.segments(band)
        at, sums, salts = cut(mixed, band, m)
        whole = whole_keys(sums, salts)
        wide = bands.widened(m)
        inside = at < wide
        less = sums[at[inside]] - mixed[inside]  # each subset of the first segments less one shingle
        points = bands.points(x.size, band)
        spot = np.minimum(np.searchsorted(hot, whole), max(0, hot.size - 1))
        cost = np.where(hot[spot] == whole, hot_counts[spot], 1) if hot.size else np.ones(m, np.int64)
        second = cost[:wide] + np.bincount(at[inside], minlength=wide)[:wide] + 1
        chosen = np.argsort(np.concatenate((cost, second)), kind="stable")[:points]
        first = np.zeros(m, bool)
        first[chosen[chosen < m]] = True
        again = chosen[chosen >= m] - m
        if band == own:
            add(whole[first], 0)
            add(whole[~first], 2)
            add(less_keys(less, salts[at[inside]]), 2)
        else:
            add(whole[first], 1)
        if again.size:
            add(less_keys(sums[again], salts[again]), 1)
            mine = np.isin(at[inside], again)
            add(whole_keys(less[mine], salts[at[inside]][mine]), 1)
    return (np.concatenate(keys), np.concatenate(kinds)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int32))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of the number of shingles that fall on each bit."""
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for i, x in enumerate(sets):
        odd = (np.bincount((x >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)
        out[i] = np.packbits(odd, bitorder="little").view(np.uint64)
    return out


def classes(sets: list[np.ndarray], bands: Bands, label: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """The labels after all links between sets of different label (and, with
    ``side``, of different sides) have joined theirs; a class takes its least."""
    n = len(sets)
    size = np.array([x.size for x in sets])
    bits = bitmaps(sets)
    # the set nearest to the majority first: in a group of copies it is linked to most
    majority = np.packbits((np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) * 2 > n).astype(np.uint8)).view(np.uint64)
    order = np.argsort(np.bitwise_count(bits ^ majority).sum(axis=1), kind="stable")
    label = label.copy()
    for k in range(1, n):
        x, before = order[k], order[:k]
        apart = label[before] != label[x]
        if side is not None:
            apart &= side[before] != side[x]
        y = before[apart]
        if not y.size:
            continue
        total = size[y] + size[x]
        common = -(-bands.num * total // (bands.num + bands.den))
        distance = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
        fits = (common <= np.minimum(size[y], size[x])) & (distance <= total - 2 * common)
        y = y[fits][np.argsort(distance[fits], kind="stable")]
        while y.size:
            other, y = y[0], y[1:]
            if np.intersect1d(sets[x], sets[other], assume_unique=True).size >= bands.common(size[x], size[other]):
                joined = label[x], label[other]
                label[(label == joined[0]) | (label == joined[1])] = min(joined)
                y = y[label[y] != label[x]]
    return label


def prints(docs: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """id, text_key, node, sure (a second digest), n and the whole keys of the own band, per row of (id, text)."""

    def rows(batches):
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            keys = []
            for x in sets:
                own = bands.of(x.size)
                keys.append(whole_keys(*cut(mix(x), own, bands.segments(own))[1:]).view(np.int64) if own >= 0 else np.empty(0, np.int64))
            digest = [(xxhash.xxh3_64_intdigest(b), xxhash.xxh64_intdigest(b)) if b else None for b in map(np.ndarray.tobytes, sets)]
            node, sure = ([None if d is None else d[i] - (d[i] >> 63 << 64) for d in digest] for i in (0, 1))
            offsets = np.concatenate(([0], np.cumsum([k.size for k in keys])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(node, pa.int64()), pa.array(sure, pa.int64()), pa.array([x.size for x in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))],
                names=["id", "text_key", "node", "sure", "n", "keys"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text_key", F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, f"id {id_type}, text_key bigint, node bigint, sure bigint, n bigint, keys array<bigint>")


def frequent(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys that many documents share, sorted, and by how many: at most HOT_KEYS, for no more occur so often."""
    rows = keys.count()
    often = max(LEAST_HOT, -(-rows // HOT_KEYS))
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often).toPandas()
    key, n = hot["key"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def keyed(docs: DataFrame, shingle: int, bands: Bands, hot) -> DataFrame:
    """key, ord (0 indexed and looked up, 1 looked up, 2 indexed) and node."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(batches):
        import xxhash

        seen = set()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                x = shingle_set(text, shingle)
                if not x.size:
                    continue
                node = xxhash.xxh3_64_intdigest(x.tobytes())
                if node in seen:  # an equal set gives equal rows
                    continue
                if len(seen) >= NODES_SEEN:
                    seen.clear()
                seen.add(node)
                key, kind = signatures(x, bands, *shared.value)
                out.append((key.view(np.int64), kind, np.full(key.size, node, np.uint64).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "ord", "node"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(rows, _KEYS)


def _edges_of_sorted(batches):
    """Rows sorted by (key, ord) -> edges (a, b) from one set of a key to each other set that it may match."""
    key = hub = kind = None
    waiting: list[np.ndarray] = []  # sets that look up a key under which none is indexed so far

    def flush(out):
        if waiting:
            b = np.concatenate(waiting)
            waiting.clear()
            out.append((np.full(b.size, hub), b))

    for batch in batches:
        k, o, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ord", "node"))
        starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [k.size]))
        lone = np.diff(starts) == 1
        lone[[0, -1]] = False  # their keys may go on in another batch
        out = []
        for s, e in zip(starts[:-1][~lone], starts[1:][~lone]):
            if key is None or k[s] != key:
                waiting.clear()
                key, hub, kind = k[s], x[s], o[s]
            if kind == 2:  # nobody looks it up
                continue
            part = x[s:e]
            if kind == 0:
                out.append((np.full(e - s, hub), part))
                continue
            waiting.append(part[o[s:e] == 1])
            indexed = part[o[s:e] == 2]
            if indexed.size or sum(w.size for w in waiting) > HELD:
                flush(out)
                out.append((np.full(indexed.size, hub), indexed))
        if out:
            a, b = (np.concatenate(c) for c in zip(*out))
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _classes_of_blocks(shingle: int, bands: Bands):
    def joined(frames):
        key, held = None, {}

        def solve():
            label, side = (np.array([v[i] for v in held.values()]) for i in (1, 2))
            after = classes([v[0] for v in held.values()], bands, label, side if (side != side[0]).any() else None)
            return pd.DataFrame({"a": label, "b": after})[label != after].drop_duplicates()

        for frame in frames:
            for root, i, j, side, node, label, text in zip(*(frame[c] for c in ("root", "i", "j", "side", "node", "label", "text"))):
                if (root, i, j) != key:
                    if len(held) > 1:
                        yield solve()
                    key, held = (root, i, j), {}
                if node not in held:
                    held[node] = (shingle_set(text, shingle), label, side)
        if len(held) > 1:
            yield solve()

    return joined


def joined_labels(docs: DataFrame, members: DataFrame, shingle: int, bands: Bands, pairs: bool = False) -> DataFrame:
    """Labels (a) and the least label of their class (b), where links join ``members``
    (root, node, label, n, id, text_key) of equal root.

    Each block alone: a member is in one block, so b is final for it.  Or every two
    blocks of a group (``pairs``): a label may come several times.
    """
    sums = members.groupBy("root").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))
    blocks = sums.select("root", F.greatest(F.ceil(F.col("s") / BLOCK), F.ceil(F.col("c") / BLOCK_SETS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = F.col("own")
    if pairs:
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
    else:
        i = j = own
    placed = placed.select("root", i.alias("i"), j.alias("j"), (own == i).cast("int").alias("side"), "node", "label", F.col("id").alias("m_id"), F.col("text_key").alias("m_key"))
    placed = materialise(placed, "placed")
    met = sieve(docs, placed.select(F.col("m_key").alias("text_key")), "text_key")
    texts = met.join(placed, (met["text_key"] == F.col("m_key")) & met["id"].eqNullSafe(F.col("m_id")))
    dealt = texts.select("root", "i", "j", "side", "node", "label", F.col("text").cast("binary").alias("text"))
    return materialise(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(_classes_of_blocks(shingle, bands), "a bigint, b bigint"), "joined")


def relabelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``members`` with the labels that ``joined`` (a, b) gives."""
    rows = members.join(joined, members["label"] == joined["a"], "left").withColumn("label", F.coalesce("b", "label"))
    return rows.drop("a", "b")


def labels_of(docs: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, bands: Bands) -> DataFrame:
    """node and label (the same for all nodes of a class) of the nodes (node, n, id, text_key) of the candidate groups (node, root)."""
    members = materialise(nodes.join(groups, "node").select("root", "node", F.col("node").alias("label"), "n", "id", "text_key"), "members")
    members = materialise(relabelled(members, joined_labels(docs, members, shingle, bands)), "labelled")

    def apart(rows: DataFrame) -> DataFrame:  # of groups of several blocks that are still several classes
        sums = rows.groupBy("root").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"), F.min("label").alias("p"), F.max("label").alias("q"))
        wide = sums.where(((F.col("s") > BLOCK) | (F.col("c") > BLOCK_SETS)) & (F.col("p") != F.col("q")))
        return materialise(rows.join(wide.select("root"), "root", "left_semi"), "apart")

    rest = apart(members)
    if rest.isEmpty():
        return members.select("node", "label")
    one = rest.groupBy("root", "label").agg(F.min(F.struct("node", "n", "id", "text_key")).alias("m")).select("root", "label", "m.*")
    members = materialise(relabelled(members, joined_labels(docs, one, shingle, bands)), "labelled")
    rest = apart(members)
    if rest.isEmpty():
        return members.select("node", "label")
    met = components(joined_labels(docs, rest, shingle, bands, pairs=True))
    return relabelled(members, met.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "label")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per row of ``docs``: id, n_shingles and component_id, linking Jaccard similarities of at least ``num / den``."""
    if not 0 < num <= den:
        raise ValueError("the similarity lies above 0 and at most at 1")
    small_batches(docs.sparkSession)
    bands = Bands(num, den)
    # a column of the input may have any name: only these two are taken, under names of our own
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    own = materialise(prints(rows, shingle, bands), "prints")
    keys = own.select(F.explode("keys").alias("key"))
    hot = frequent(keys)
    nodes = own.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first"), F.min("n").alias("n"),
        (F.min("sure") != F.max("sure")).alias("clash"))
    nodes = materialise(nodes.select("node", "n", "first.id", "first.text_key", "clash"), "nodes")
    if not nodes.where("clash").isEmpty():
        raise RuntimeError("two sets of shingles have one digest")
    # sorted by node too: the keys of a group of copies then share their hub, and few rounds find the groups
    edges = keyed(rows, shingle, bands, hot).repartition("key").sortWithinPartitions("key", "ord", "node").mapInArrow(_edges_of_sorted, "a bigint, b bigint")
    groups = components(materialise(edges, "candidates"))
    found = labels_of(rows, nodes, groups, shingle, bands).withColumnRenamed("node", "member")
    placed = nodes.join(found, nodes["node"] == F.col("member"), "left").select("node", "id", F.coalesce("label", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    label = placed.join(least, "root").select(F.col("node").alias("of"), "component_id")
    out = own.join(label, own["node"] == label["of"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
