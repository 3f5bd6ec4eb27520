"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; a target stops at twice its source's words, and the
excess is shared out again by weight until none is above.

Rates: within a source the copies of a document follow the rates closest to
one in relative entropy whose words meet the target with no rate above the
limit.  The convex dual of that problem has one multiplier per source and its
solution is the exponential tilt ``rate = min(limit, exp(m * size / mean size))``.
Newton steps, kept within a bracket, solve all sources' multipliers at
once.  They run on counts of equal sizes per source, never on documents again.

Copies: the whole part of a rate is always taken.  The fractions are rounded
by systematic choice: a document's hash (uniform in 0 to 1) over its fraction
gives an order in which documents with larger fractions come earlier in
proportion; documents are taken in that order until the words come as near to
the target as they can.  The order is cut at one of ``BINS`` steps, so only
sums per step are needed; a source of few documents has one document per step.
At last the one document whose adding or leaving out brings the words nearest
to the target is added or left out.

Defined results: null text has size 0; documents of size 0 take 0 words and one copy;
null sources are a source of their own; null ids hash like any value; repeated
rows of one id and size share the same hash, so they are taken or left
together; an empty table gives an empty result.  Only the named columns are
read, and every step gives the same rows on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
BINS = 1 << 16
STEPS, CLOSE = 80, 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Sharing out again by weight until nothing is above its limit ends with
    ``min(limit * size, level * weight)`` for one level.  With the sources in
    the order of ``limit * size / weight`` the level follows from running sums:
    the sources before some point stop at their limit, the rest share what is left.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    picks = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(picks, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumn("cap", F.lit(limit) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    s = s.withColumns({
        "total": F.lit(share) * F.sum("source_size").over(every),
        "capped": F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    # the first source whose limit is not reached sets the level; before it the level is above the limit
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    s = s.withColumn("level", F.max("level").over(every))  # after the first the level only falls
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def multipliers(sizes: DataFrame, goal: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The tilt of each source: (source_key, m, full).

    ``sizes``: (source_key, size, n); ``goal``: (source_key, source_size, docs,
    target).  ``full`` marks sources whose target is the limit itself.
    """
    spark = sizes.sparkSession
    goal = goal.withColumns({"mean": F.col("source_size") / F.greatest("docs", F.lit(1)), "full": F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)})
    state = materialise(goal.where("target > 0 and not full").select("source_key", "mean", "target", F.lit(0.0).alias("m"), F.lit(-float(1 << 40)).alias("low"), F.lit(float(1 << 40)).alias("high"), F.lit(False).alias("done")), "tilt")
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(limit), F.exp(F.least(F.col("m") * x, F.lit(50.0))))
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        words = F.col("n") * F.col("size")
        sums = sizes.where("size > 0").join(state.where("not done"), "source_key").groupBy("source_key").agg(
            # exact sums: the same whatever the order of the rows
            F.sum((words * rate).cast("decimal(38,6)")).cast("double").alias("taken"),
            F.sum(F.when(rate < limit, words * rate * x).otherwise(0.0).cast("decimal(38,6)")).cast("double").alias("slope"))
        s = state.join(sums, "source_key", "left").withColumn("off", F.col("taken") - F.col("target"))
        s = s.withColumns({
            "low": F.when(F.col("off") < 0, F.greatest("low", "m")).otherwise(F.col("low")),
            "high": F.when(F.col("off") > 0, F.least("high", "m")).otherwise(F.col("high")),
        })
        newton = F.when(F.col("slope") > 0, F.col("m") - F.col("off") / F.col("slope"))
        # outside the bracket: its middle, or twice as far where a side is still open
        middle = (F.when(F.col("high") == float(1 << 40), F.greatest(2 * F.col("m"), F.lit(1.0)))
                  .when(F.col("low") == -float(1 << 40), F.least(2 * F.col("m"), F.lit(-1.0)))
                  .otherwise((F.col("low") + F.col("high")) / 2))
        to = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        met = F.col("done") | (F.abs("off") <= CLOSE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-14 * (1 + F.abs("m")))
        state = materialise(s.select("source_key", "mean", "target", F.when(met, F.col("m")).otherwise(to).alias("m"), "low", "high", met.alias("done")), "tilt")
    solved = state.select("source_key", "m")
    return materialise(goal.select("source_key", "mean", "full", "target").join(solved, "source_key", "left"), "tilts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, rate, copies, taken."""
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    # a join key without nulls, that no source value equals
    rows = materialise(own.withColumn("source_key", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))), "sizes")
    sizes = materialise(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = sizes.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    named = sources.withColumn("source", F.when(F.col("source_key") != "0", F.expr("substring(source_key, 2)")))
    goal = targets(named.select("source", "source_size"), weights, share, limit)
    goal = goal.withColumn("source_key", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    goal = materialise(goal.drop("source").join(sources.select("source_key", "docs"), "source_key"), "goal")
    tilt = multipliers(sizes, goal, limit)

    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("full"), F.lit(limit)).when(F.col("m").isNull(), F.lit(0.0)).otherwise(F.least(F.lit(limit), F.exp(F.least(F.col("m") * x, F.lit(50.0)))))
    rated = rows.join(tilt, "source_key").withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate))
    # one minus a uniform hash to the power 1 / fraction would sample without order; the ratio does so for systematic choice
    fraction = F.col("rate") - F.floor("rate")
    uniform = (F.pmod(F.xxhash64("id", "size"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rank = F.when(fraction > 0, uniform / fraction)
    rated = rated.withColumn("bin", F.when(rank.isNotNull(), F.floor(F.lit(BINS) * rank / (rank + 1)).cast("int")))

    whole = F.sum(F.floor("rate") * F.col("size")).alias("whole")
    bins = materialise(rated.groupBy("source_key", "bin").agg(whole, F.sum(F.when(F.col("bin").isNotNull(), F.col("size"))).alias("words")), "bins")
    base = bins.groupBy("source_key").agg(F.sum("whole").alias("whole"))
    upto = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    steps = bins.where("bin is not null").select("source_key", "bin", F.sum("words").over(upto).alias("words"))
    steps = steps.unionByName(base.select("source_key", F.lit(-1).alias("bin"), F.lit(0).cast("bigint").alias("words")))
    off = steps.join(base, "source_key").join(goal.select("source_key", "target"), "source_key")
    off = off.select("source_key", "bin", (F.col("whole") + F.col("words") - F.col("target")).alias("off"))
    cut = off.groupBy("source_key").agg(F.min(F.struct(F.abs("off").alias("far"), "bin", "off")).alias("best"))
    cut = materialise(cut.select("source_key", F.col("best.bin").alias("cut"), F.col("best.off").alias("off")), "cuts")
    # one document more or less may come nearer still
    chosen = rated.where("bin is not null").join(cut, "source_key").withColumn("change", F.when(F.col("bin") <= F.col("cut"), -F.col("size")).otherwise(F.col("size")))
    swap = chosen.withColumn("far", F.abs(F.col("off") + F.col("change"))).where(F.col("far") < F.abs("off")).groupBy("source_key").agg(F.min(F.struct("far", F.xxhash64("id").alias("h"), "id", "size", F.sign("change").alias("by"))).alias("swap"))
    last = goal.select("source_key", "source_size", "target").join(cut.select("source_key", "cut"), "source_key").join(swap, "source_key", "left")
    last = materialise(last, "last")

    picked = F.when(F.col("bin") <= F.col("cut"), 1).otherwise(0)
    swapped = F.col("bin").isNotNull() & F.col("id").eqNullSafe(F.col("swap.id")) & (F.col("size") == F.col("swap.size"))
    copies = (F.floor("rate") + picked + F.when(F.coalesce(swapped, F.lit(False)), F.col("swap.by")).otherwise(0)).cast("int")
    done = rated.drop("target", "mean").join(last, "source_key").withColumn("copies", copies)
    return done.select("id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every document as often as the mix takes it."""
    taken = mix(docs)

    def keyed(df, size):  # null ids and sources as keys of plain columns
        return df.withColumns({"k1": F.coalesce("id", F.lit(0)), "k2": F.col("id").isNull(), "k3": F.coalesce("source", F.lit("")), "k4": F.col("source").isNull(), "k5": size})

    keys = ["k1", "k2", "k3", "k4", "k5"]
    # equal keys have equal copies: the hash and the rate depend on nothing else
    copies = keyed(taken, F.col("size")).groupBy(*keys).agg(F.max("copies").alias("copies")).where("copies > 0")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "source", size_of(F.col("text")).alias("size"))
    packed = keyed(packed, F.col("size")).drop("id", "source", "size")
    return packed.join(copies, keys).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
