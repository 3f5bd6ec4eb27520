"""Order-dependent operators that stay balanced under skew.

``row_number() OVER (PARTITION BY key ORDER BY seq)`` puts a whole key in one
task; with one key holding a third of the rows that task holds a third of the
data.  ``seq_rank`` gives the same numbers with bounded tasks:

1. keys are counted; those with more than ``chunk`` rows get borders, quantiles
   of their own ``seq`` values from a mergeable sketch, so that their chunks
   hold similar numbers of rows however the values are spread;
2. rows are numbered inside each (key, chunk) -- a window over a bounded group;
3. rows are counted per (key, chunk), and a running sum over this small table
   gives each chunk's offset;
4. the offset is added (equi-join on key + chunk; the big side is already
   hash-partitioned on it by step 2 and is not shuffled again).

At most ``MAX_KEYS`` keys get borders, the largest ones; no other key can hold
more than 1 / ``MAX_KEYS`` of all rows.  With ``BORDERS`` borders each, what is
broadcast has a fixed bound (32 MB).  Steps 1 and 3 read only the key and
``seq`` columns and combine map-side.

``global_rank`` numbers all rows of a relation in one order, by ranges.

"Last write wins" and "first value" use aggregation (``max_by`` /
``min_by``), which Spark combines map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 20
MAX_KEYS, BORDERS = 4096, 1023  # (one less than a power of two)


def key_borders(rows: DataFrame, key: str, seq: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``key`` and ``borders`` (ascending values of ``seq``) of the keys with more than ``chunk`` rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk)
    large = counts.orderBy(F.col("__n").desc(), key).limit(MAX_KEYS).select(key)
    at = F.expr("array(" + ", ".join(f"{i / (BORDERS + 1)!r}D" for i in range(1, BORDERS + 1)) + ")")
    of_large = rows.join(F.broadcast(large), key, "left_semi")
    return of_large.groupBy(key).agg(F.percentile_approx(seq, at, 10 * BORDERS).alias("borders"))


def place_of(value: Column, borders: Column) -> Column:
    """How many of the ascending ``borders`` are not above ``value``, by halving steps (0 without borders)."""
    steps = [1 << e for e in range(BORDERS.bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(borders, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
    return F.when(borders.isNull(), F.lit(0)).otherwise(found)


def seq_rank(df: DataFrame, keys: list[str], seq: str, out: str = "rank",
             chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """1-based position of each row within its key, in ascending ``seq``.

    ``seq`` must be unique per key; its values may be as sparse as they like.
    NULL key parts are values like any other (a key with a NULL part is a key).
    """
    # key and chunk as one struct: fields compare null-safely inside it, and
    # the window, the counts and the join all hash on the same column
    b, k = "__chunk", "__key"
    keyed = df.withColumn(k, F.struct(*keys))
    borders = key_borders(keyed.select(k, seq), k, seq, chunk).withColumnRenamed("borders", "__borders")
    place = place_of(F.col(seq), F.col("__borders")).alias("c")
    staged = keyed.join(F.broadcast(borders), k, "left").withColumn(b, F.struct(k, place)).drop("__borders")
    local = staged.withColumn("__local", F.row_number().over(Window.partitionBy(b).orderBy(seq)))
    counts = staged.groupBy(b).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn(
        "__off",
        F.coalesce(F.sum("__n").over(
            Window.partitionBy(f"{b}.{k}").orderBy(f"{b}.c")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(offsets.select(b, "__off"), b)
    return joined.withColumn(out, (F.col("__off") + F.col("__local")).cast("int")).select(
        *[c for c in df.columns if c != out], out)


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """0-based position of each row in the order of ``order`` (unique together).

    Rows are dealt by ranges of the order columns (Spark samples the borders)
    and sorted within them; a row's place in its range is added to the number
    of rows in the ranges before.  The borders are sampled anew whenever a plan
    runs, so the dealt rows are checkpointed once: pass narrow rows.
    """
    from runlens.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    p, i = "__range", "__place"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({p: F.spark_partition_id(), i: F.monotonically_increasing_id()}).checkpoint(eager=True)
    sizes = dealt.groupBy(p).agg(F.count(F.lit(1)).alias("__n"), F.min(i).alias("__first"))
    # one row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(p, (before - F.col("__first")).alias("__off"))
    return dealt.join(F.broadcast(offsets), p).withColumn(out, F.col(i) + F.col("__off")).drop(p, i, "__off")


def last_by_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keep, for each key, the row with the largest ``seq`` (last write wins)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys)
            .agg(F.max_by(packed, F.col(seq)).alias("__last"))
            .select(*keys, *[F.col("__last." + c).alias(c) for c in others]))


def first_by(col: str, seq: str) -> Column:
    """Value of ``col`` on the earliest row of the group."""
    return F.min_by(F.col(col), F.col(seq))
