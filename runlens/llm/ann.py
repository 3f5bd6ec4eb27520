"""Nearest neighbours by cross-polytope hashing.

A table turns vectors by a pseudo-rotation (three rounds of random signs and a
fast Hadamard transform) and files each under the signed axis nearest to it.
A query looks into the ``probes`` axes nearest to it in each of ``TABLES``
tables; every vector found there is ranked by its exact inner product.

Only the direction matters for the hash, while a long vector can be near under a wide
angle.  So vectors are filed in bands of similar length, and every band has a number
of probes of its own: queries look into more axes for long vectors, fewer for short
ones.  A band of at most ``WHOLE`` vectors is not hashed: every query sees all of it.

Equal vectors are one class: a class is searched once, and its ids (the 21
smallest suffice for 20 neighbours and the query itself) are put back at the end.
A bucket's vectors are dealt into slices of about ``ROWS`` and a query visits
every slice of its buckets, so no task holds a whole large bucket.  Each visit
returns only its best ``k + 1``; pairs are never written out.

The probes are measured, not guessed: about ``SAMPLE`` queries of each dimension are
compared with all vectors, and the bands get the cheapest probes under which the tables
hold ``TARGET`` of the sample's neighbours.  Where probes would cost as much as seeing
the whole band, queries see the whole band.  A query that still meets fewer than
k + 1 classes is compared with all vectors.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part; vectors of another length than the query's
are no candidates; null ids take no part; an id that comes again with the same
vector counts once; only fewer candidates than k give fewer rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

TABLES, ROWS, SEED = 8, 8192, 20240607
WHOLE = 2048  # vectors of a band that every query sees
RATIO = 1.25  # of the lengths in a band
SAMPLE, TARGET = 256, 0.95


def band_of(v: np.ndarray) -> int:
    """The band of a vector's length (not zero); length 1 is in the middle of its band."""
    most = np.abs(v).max()
    return math.floor((math.log(most) + math.log(((v / most) ** 2).sum()) / 2) / math.log(RATIO) + 0.5)


def choose_probes(sizes: dict[int, int], found: list[tuple[int, int]], axes_: int, tables: int) -> dict[int, int]:
    """Band -> probes, for the hashed bands of one dimension; bands that are to be seen whole are left out.

    ``sizes``: vectors of each hashed band; ``found``: (band, best rank of its axis in any
    table) of the sample's neighbours.
    """
    ranks: dict[int, list[int]] = {b: [] for b in sizes}
    for band, rank in found:
        ranks.get(band, []).append(rank)
    most = (axes_ - 1) // tables  # more probes cost no less than the whole band
    options = {}
    for band, n in sizes.items():
        hits = np.searchsorted(np.sort(ranks[band]), np.arange(1, most + 1))
        options[band] = [(p, n * tables * p / axes_, int(h)) for p, h in zip(range(1, most + 1), hits)] + [(0, float(n), len(ranks[band]))]
    at = {band: own[0] for band, own in options.items()}
    missed = sum(map(len, ranks.values())) - sum(h for _, _, h in at.values())
    while missed > (1 - TARGET) * len(found):
        # the step that finds most for its cost
        band, step = max(((b, o) for b, own in options.items() for o in own if o[2] > at[b][2]), key=lambda x: (x[1][2] - at[x[0]][2]) / (x[1][1] - at[x[0]][1]))
        missed -= step[2] - at[band][2]
        at[band] = step
    return {band: p for band, (p, _, _) in at.items() if p}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of the rows (a power of two long)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def turned(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The rows turned by the pseudo-rotation of a table, padded to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], size=(3, width))
    for s in signs:
        out = hadamard(out * s)
    return out


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first: 2 * axis, + 1 for its negative side."""
    both = np.empty((len(y), 2 * y.shape[1]))
    both[:, 0::2], both[:, 1::2] = y, -y
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _vectors(packed, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(-1, dim).astype(np.float64)


def _pack(kind: str):
    def pack(frames):
        for f in frames:
            vectors = [np.asarray(v, dtype=kind) for v in f["v"]]
            packed = [v.tobytes() for v in vectors]
            yield pd.DataFrame({
                "id": f["id"], "dim": [len(v) for v in vectors], "key": [hashlib.sha256(p).digest() for p in packed], "vector": packed,
                "band": [band_of(v.astype(np.float64)) for v in vectors],
            }).astype({"dim": "int32", "band": "int32"})

    return pack


def _file(plan: dict[int, dict[int, int]], kind: str, tables: int):
    """Rows (key, dim, vector, band) -> one row per table, or one row with table -1 where the band is seen whole."""

    def file(frames):
        for f in frames:
            for dim, rows in f.groupby("dim"):
                probes = rows["band"].map(plan.get(dim, {})).fillna(0).astype(np.int32)
                whole = rows[probes == 0]
                yield pd.DataFrame({"dim": np.int32(dim), "t": np.int32(-1), "axis": np.int32(-1), "probes": np.int32(0), "key": whole["key"], "vector": whole["vector"]})
                rows, probes = rows[probes > 0], probes[probes > 0]
                x = _vectors(rows["vector"], dim, kind)
                for t in range(tables if len(rows) else 0):
                    yield pd.DataFrame({
                        "dim": np.int32(dim), "t": np.int32(t), "axis": axes(turned(x, t), 1).ravel().astype(np.int32), "probes": probes.to_numpy(),
                        "key": rows["key"].to_numpy(), "vector": rows["vector"].to_numpy(),
                    })

    return file


def _ask(plan: dict[int, dict[int, int]], kind: str, tables: int):
    """Queries (key, dim, vector) -> one row per table and axis to look into (``near``: its rank), one for what is seen whole."""

    def ask(frames):
        for f in frames:
            for dim, rows in f.groupby("dim"):
                yield pd.DataFrame({"dim": np.int32(dim), "t": np.int32(-1), "axis": np.int32(-1), "near": np.int32(-1), "key": rows["key"], "vector": rows["vector"]})
                x, most = _vectors(rows["vector"], dim, kind), max(plan.get(dim, {}).values(), default=0)
                for t in range(tables if most else 0):
                    found = axes(turned(x, t), most)
                    width = found.shape[1]
                    yield pd.DataFrame({
                        "dim": np.int32(dim), "t": np.int32(t), "axis": found.ravel().astype(np.int32), "near": np.tile(np.arange(width, dtype=np.int32), len(x)),
                        "key": np.repeat(rows["key"].to_numpy(), width), "vector": np.repeat(rows["vector"].to_numpy(), width),
                    })

    return ask


def _sample_best(shared, kind: str, k: int):
    """The vectors of a partition nearest to each query of the sample."""

    def best(frames):
        kept = {}
        for f in frames:
            for dim, rows in f.groupby("dim"):
                if dim not in shared.value:
                    continue
                q = _vectors(shared.value[dim], dim, kind)
                if dim not in kept:
                    kept[dim] = np.full((len(q), k), -np.inf), np.empty((len(q), k), object), np.zeros((len(q), k), np.int32)
                fresh = q @ _vectors(rows["vector"], dim, kind).T, rows["vector"].to_numpy(), rows["band"].to_numpy()
                pool = [np.hstack([old, np.broadcast_to(new, fresh[0].shape)]) for old, new in zip(kept[dim], fresh)]
                near = np.argpartition(-pool[0], k - 1, axis=1)[:, :k]
                kept[dim] = tuple(np.take_along_axis(p, near, axis=1) for p in pool)
        for dim, (score, vector, band) in kept.items():
            i, j = np.nonzero(score > -np.inf)
            yield pd.DataFrame({"dim": np.int32(dim), "s": i.astype(np.int32), "score": score[i, j], "vector": vector[i, j], "band": band[i, j]})

    return best


def _sample_ranks(shared, kind: str, tables: int):
    """The rank of the axis under which a neighbour is filed, among those of its query: the best over the tables."""

    def ranks(frames):
        for f in frames:
            for dim, rows in f.groupby("dim"):
                s, q, x = rows["s"].to_numpy(), _vectors(shared.value[dim], dim, kind), _vectors(rows["vector"], dim, kind)
                best = np.full(len(x), np.iinfo(np.int32).max, np.int64)
                for t in range(tables):
                    place = np.argsort(axes(turned(q, t), 4 * dim), axis=1)
                    best = np.minimum(best, place[s, axes(turned(x, t), 1).ravel()])
                own = np.array([shared.value[dim][i] for i in s], object) == rows["vector"].to_numpy()
                yield pd.DataFrame({"dim": np.int32(dim), "band": rows["band"].to_numpy(), "near": best.astype(np.int32)})[~own]

    return ranks


def measured(index: DataFrame, queries: DataFrame, large: dict[int, dict[int, int]], kind: str, k: int, tables: int) -> dict[int, dict[int, int]]:
    """dim -> band -> probes, by the exact neighbours of a sample of the queries among all vectors."""
    spark = index.sparkSession
    asked = {r["dim"]: r["count"] for r in queries.where(F.col("dim").isin(list(large))).groupBy("dim").count().collect()}
    place, sample = F.pmod(F.xxhash64("key"), F.lit(1 << 40)), {}
    for dim, n in asked.items():
        rows = queries.where((F.col("dim") == dim) & (place < F.lit(math.ceil(min(1.0, SAMPLE / n) * (1 << 40))))).select("key", "vector").collect()
        if rows:
            sample[dim] = [bytes(r["vector"]) for r in sorted(rows, key=lambda r: bytes(r["key"]))]
    shared = spark.sparkContext.broadcast(sample)
    best = index.select("dim", "vector", "band").mapInPandas(_sample_best(shared, kind, k + 1), "dim int, s int, score double, vector binary, band int")
    by_score = Window.partitionBy("dim", "s").orderBy(F.desc("score"), "vector")
    best = best.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).select("dim", "s", "vector", "band")
    found: dict[int, list[tuple[int, int]]] = {dim: [] for dim in large}
    for r in best.mapInPandas(_sample_ranks(shared, kind, tables), "dim int, band int, near int").collect():  # at most k + 1 rows a query of the sample
        found[r["dim"]].append((r["band"], r["near"]))
    return {dim: choose_probes(sizes, found[dim], 2 << max(0, dim - 1).bit_length(), tables) for dim, sizes in large.items()}


def best_in_block(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``x`` and scores of each query's best ``k``; a score depends on its two vectors alone."""
    score = q @ x.T
    k = min(k, len(x))
    near = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    i, j = np.repeat(np.arange(len(q)), k), near.ravel()
    return i, j, (q[i] * x[j]).sum(axis=1)


def _rank(kind: str, k: int):
    def rank(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            dim = int(key[0])
            q, x = _vectors(queries["vector"], dim, kind), _vectors(rows["vector"], dim, kind)
            qk, xk = queries["key"].to_numpy(), rows["key"].to_numpy()
            step = max(1, 4_000_000 // len(x))
            for at in range(0, len(q), step):
                i, j, score = best_in_block(q[at : at + step], x, k)
                found.append(pd.DataFrame({"query": qk[at + i], "found": xk[j], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "found": [], "score": []})

    return rank


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found to each row for which ``is_query(id column)`` holds."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = "<f8" if dict(rows.dtypes)[vector_col] == "array<double>" else "<f4"
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>" if kind == "<f8" else "array<float>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = own.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0))
    all_rows = materialise(own.mapInPandas(_pack(kind), "id bigint, dim int, key binary, vector binary, band int"), "vectors")

    # the smallest ids of each class; the first one's row stands for it
    by_id = Window.partitionBy("key").orderBy("id")
    members = materialise(all_rows.dropDuplicates(["key", "id"]).withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1), "members")
    index = members.where("n = 1").select("key", "dim", "vector", "band")
    asked = all_rows.where(is_query(F.col("id"))).select("key", "id").distinct()
    queries = materialise(asked.select("key").distinct().join(index, "key").select("key", "dim", "vector"), "queries")

    large: dict[int, dict[int, int]] = {}
    for r in index.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WHOLE).collect():
        large.setdefault(r["dim"], {})[r["band"]] = r["size"]
    if probes:
        plan = {dim: dict.fromkeys(sizes, probes) for dim, sizes in large.items()}
    else:
        plan = measured(index, queries, large, kind, k, tables) if large else {}

    places = ["dim", "t", "axis", "probes"]
    filed = index.mapInPandas(_file(plan, kind, tables), "dim int, t int, axis int, probes int, key binary, vector binary")
    counts = filed.groupBy(*places).agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS)).cast("int").alias("slices"))
    counts = materialise(counts, "buckets")
    filed = filed.join(counts, places).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")).drop("slices")
    parts = counts.select(*[F.col(c).alias(f"to_{c}") for c in [*places, "slices"]])
    first = members.where("n = 1").select(F.col("key").alias("found"), F.col("id").alias("first"))
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "first")

    def classes_in(visits: DataFrame) -> DataFrame:
        """The k + 1 best classes of each query in the buckets it visits, in order of score, then smallest id."""
        visits = visits.select("dim", *[F.col(f"to_{c}").alias(c) for c in places[1:]], "key", "vector", F.explode(F.sequence(F.lit(0), F.col("to_slices") - 1)).alias("slice"))
        bucket = [*places, "slice"]
        pairs = visits.groupBy(*bucket).cogroup(filed.groupBy(*bucket)).applyInPandas(_rank(kind, k + 1), "query binary, found binary, score double")
        pairs = pairs.groupBy("query", "found").agg(F.max("score").alias("score"))
        return pairs.join(first, "found").withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1).select("query", "found", "score")

    visits = queries.mapInPandas(_ask(plan, kind, tables), "dim int, t int, axis int, near int, key binary, vector binary")
    visits = visits.join(parts, [*[visits[c] == parts[f"to_{c}"] for c in places[:3]], visits["near"] < parts["to_probes"]])
    classes = materialise(classes_in(visits), "classes")

    # queries that met too few see every bucket of one table
    sizes = index.groupBy("dim").agg(F.count(F.lit(1)).alias("all"))
    met = classes.groupBy(F.col("query").alias("key")).agg(F.count(F.lit(1)).alias("met"))
    few = queries.join(sizes, "dim").join(met, "key", "left").where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k + 1), F.col("all")))
    few = materialise(few.select("key", "dim", "vector"), "few")
    if not few.isEmpty():
        every = few.join(parts.where("to_t <= 0"), F.col("dim") == F.col("to_dim"))
        again = few.select(F.col("key").alias("query"))
        classes = classes.join(again, "query", "left_anti").unionByName(classes_in(every))

    # their ids
    ids = classes.join(members.select(F.col("key").alias("found"), "id"), "found")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ids = ids.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).select("query", "id", "score")
    out = ids.join(asked.select(F.col("key").alias("query"), F.col("id").alias("query_id")), "query").where("id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
