"""Skew-safe ranking and last-write-wins against their window definitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators.ranking import last_by_key, seq_rank
from runlens.operators import reports as R
from runlens.sources import testdata as TD

from conftest import SF_SMALL


def test_seq_rank_many_chunks_equals_row_number(spark):
    runs = TD.runs(spark, SF_SMALL)
    keys = ["scene_id", "model", "scheme", "param_set"]
    got = R.with_repeat_idx(runs, keys, chunk=7).select("run_seq", "repeat_idx")
    exp = runs.select("run_seq", F.row_number().over(Window.partitionBy(*keys).orderBy("run_seq"))
                      .cast("int").alias("repeat_idx"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_seq_rank_hot_key(spark):
    # one key holds ~90% of the rows, sequence values are sparse
    df = spark.range(5000).select((F.col("id") * 3 + 11).alias("seq"),
                                  F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"))
    got = seq_rank(df, ["k"], "seq", "r", chunk=64)
    exp = df.select("seq", "k", F.row_number().over(Window.partitionBy("k").orderBy("seq")).cast("int").alias("r"))
    assert got.select("seq", "k", "r").exceptAll(exp).count() == 0
    assert got.count() == 5000


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("b", 2, 20.0), ("a", 2, 25.0)],
                               "k string, seq long, v double")
    got = {r.k: (r.seq, r.v) for r in last_by_key(df, ["k"], "seq").collect()}
    assert got == {"a": (3, 30.0), "b": (2, 20.0)}


def test_null_keys_keep_their_rows(spark):
    from runlens.operators.ranking import seq_rank

    rows = [(i, None if i % 3 == 0 else "a", None if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "run_seq long, k string, l string")
    got = {r.run_seq: r["rank"] for r in seq_rank(df, ["k", "l"], "run_seq", "rank", chunk=7).collect()}
    seen, want = {}, {}
    for i, k, v in rows:
        seen[k, v] = want[i] = seen.get((k, v), 0) + 1
    assert got == want


def test_seq_rank_sparse_and_bursty_values(spark):
    """Microsecond-like values with bursts and a hot key: few chunks, each of bounded size."""
    from runlens.operators.ranking import BORDERS, key_borders, place_of, seq_rank

    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id") * 10**12).otherwise(10**17 + F.col("id")).alias("seq"),
                                  F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).otherwise("hot").alias("k"))
    got = {r.seq: r.r for r in seq_rank(df, ["k"], "seq", "r", chunk=50).collect()}
    want, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        seen[r.k] = want[r.seq] = seen.get(r.k, 0) + 1
    assert got == want
    borders = {r.k: r.borders for r in key_borders(df.where("k is not null"), "k", "seq", 50).collect()}
    sizes = df.where("k = 'hot'").select(place_of(F.col("seq"), F.array(*[F.lit(b) for b in borders["hot"]])).alias("c")).groupBy("c").count().collect()
    assert len(sizes) <= BORDERS + 1 and max(r["count"] for r in sizes) <= 12
