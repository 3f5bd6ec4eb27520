"""Line dedup: a segment-partition edit join over all lines.

Two lines are near when at most ``threshold`` edits apart.  A line is cut into
threshold + 1 segments of even length; edits can touch at most ``threshold`` of
them, so a near line holds one segment unchanged, at a place that its length and
the segment's number confine.  Every line files its segments under (length,
number, content) and probes, for its own and the shorter lengths, the
substrings at those places.  Lines that meet are verified by a banded
bit-parallel edit distance: a machine word holds the differences along the
2 * threshold + 1 diagonals that matter.

Equal lines are one line throughout.  Keys are hashes; rows that share no key
with another line are dropped before anything is paired.

A key that more than ``PAIRED`` rows share is not joined with itself.  At one edit,
the lines that hold such a key are filed anew under longer keys: the line without
one of ``BLOCKS`` even blocks, which lines one edit apart share for the block
that the edit is in.  Where such a key is crowded too, its lines are filed under finer
keys: the line without its i-th character, for each i in that block, once with its place and length (lines that
differ in that character) and once against whole lines (lines with one character
less).  All that share such a key are within one edit, so one link from the first of
them to each other is enough, and a key holds no more lines than there are letters
to replace or insert.  With larger thresholds all keys are joined.

Near lines form classes (chains count).  Of each class the line that occurs
first (smallest document id, then smallest digest) stays, once, in the first document that
has it; all other occurrences go.

Only DataFrame functions are used.  Defined results: a null text has no lines
and stays null; lines shorter than ``least`` code points are never removed; a
null document id is larger than any other; rows equal in id and text are
treated alike; a document that loses every line is left with an empty text
(``drop_lines`` can leave such documents out); other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise

THRESHOLD, LEAST = 1, 24
SIEVE_BITS = 23
PAIRED, BLOCKS = 16, 16
_LAST = (1 << 63) - 1


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(x: int) -> Column:
    return F.lit(x).cast("bigint")


def may_be_near(a: Column, b: Column, threshold: int, pieces: int = 8, m: Column | None = None, n: Column | None = None) -> Column:
    """False only for strings more than ``threshold`` edits apart: edits touch at most as many
    of the pieces of ``a``; the others stand in ``b``, at most ``threshold`` places away.

    ``m`` and ``n`` are the lengths, where columns have them.  The pieces are written
    out one by one: a lambda is not compiled, and neither is what it is applied to.
    """
    m, n = F.length(a) if m is None else m, F.length(b) if n is None else n
    size = F.floor(m / pieces).cast("int")
    places = sorted(range(-threshold, threshold + 1), key=abs)

    def stands(i):
        piece = F.substring(a, i * size + 1, size)
        return reduce(or_, [(i * size + by >= 0) & (F.substring(b, i * size + by + 1, size) == piece) for by in places])

    return (F.abs(m - n) <= threshold) & (reduce(add, [F.when(stands(i), 1).otherwise(0) for i in range(pieces)]) >= pieces - threshold)


def _shared_start(a: Column, b: Column) -> Column:
    """Characters that two strings share at their start, by halving steps."""
    return F.aggregate(F.array(*[F.lit(1 << e) for e in range(30, -1, -1)]), F.lit(0), lambda at, step: F.when(
        (at + step <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), at + step) == F.substring(b, F.lit(1), at + step)), at + step).otherwise(at))


def near(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are at most ``threshold`` edits apart.

    What both share at the start and at the end is set aside first.
    """
    def middle(start):
        x, y = (F.substring(t, start + 1, F.length(t)) for t in (a, b))
        return _let(F.struct(x.alias("a"), y.alias("b"), _shared_start(F.reverse(x), F.reverse(y)).alias("end")), lambda v: _let(
            F.struct(*[F.concat(F.substring(v[c], F.lit(1), F.length(v[c]) - v["end"]), F.lit("\0" * threshold)).alias(c) for c in "ab"]),
            lambda w: _banded(w["a"], w["b"], threshold)))

    return (F.abs(F.length(a) - F.length(b)) <= threshold) & _let(_shared_start(a, b), middle)


def _banded(a: Column, b: Column, threshold: int) -> Column:
    """The same for strings that end in ``threshold`` equal characters.

    Column j of the edit matrix is kept as its vertical differences on the band
    of rows j - threshold ... j + threshold, one bit each.  A step adds a
    character of ``b`` and moves the band down a row.  The lowest diagonal is
    scored until it meets the last row of the matrix, then the last row is.
    """
    k, width = threshold, 2 * threshold + 1
    full, none, one = _number((1 << width) - 1), _number(0), _number(1)
    powers, bits = F.array(*[_number(1 << bit) for bit in range(width)]), F.array(*[F.lit(bit) for bit in range(width)])

    def step(t, s, j):
        letter = F.get(t["b"], j - 1)
        equal = F.aggregate(bits, none, lambda x, bit: F.when((j - k + bit >= 1) & (F.get(t["a"], j - k + bit - 1) == letter), x.bitwiseOR(F.get(powers, bit))).otherwise(x))
        return _let(equal, lambda x: _let(
            (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(full), lambda diagonal: moved(t, s, j, diagonal)))

    def moved(t, s, j, diagonal):
        more = s["vn"].bitwiseOR(diagonal.bitwiseOR(s["vp"]).bitwiseXOR(full))
        less = diagonal.bitwiseAND(s["vp"])
        return _let(F.struct(more.alias("more"), less.alias("less"), F.shiftrightunsigned(diagonal, 1).alias("below"), diagonal.alias("d")), lambda v: F.struct(
            v["less"].bitwiseOR(v["below"].bitwiseOR(v["more"]).bitwiseXOR(full)).alias("vp"), v["below"].bitwiseAND(v["more"]).alias("vn"),
            (s["score"] + F.when(j + k <= t["m"], F.when(v["d"].bitwiseAND(_number(1 << (width - 1))) != 0, none).otherwise(one)).otherwise(along(v, t["m"] - j + k))).alias("score")))

    def along(v, bit):  # the change along the last row, where it crosses the band
        mark = F.get(powers, bit)
        return F.when(v["more"].bitwiseAND(mark) != 0, one).when(v["less"].bitwiseAND(mark) != 0, _number(-1)).otherwise(none)

    start = F.struct(_number(((1 << width) - 1) ^ ((1 << k) - 1)).alias("vp"), none.alias("vn"), _number(k).alias("score"))
    # strings as arrays of characters; their lengths, measured once
    taken = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("m"), F.length(b).alias("n"))
    return _let(taken, lambda t: F.aggregate(F.sequence(F.lit(1), t["n"]), start, lambda s, j: step(t, s, j), lambda s: s["score"]) <= k)


def key_columns(line: Column, n: Column, threshold: int, least: int) -> tuple[list[Column], list[Column]]:
    """(hashes a line files, further hashes it only probes): bigint columns, those probed null where a line has none.

    ``n`` is a column with the line's length: measured once, not in every key.

    A line files its segments; these are also what it probes among lines of its
    own length at the segments' own places.  The places probed for a line
    ``shift`` characters shorter are those that leave enough edits for what lies
    before and for what lies after them.
    """
    parts = threshold + 1

    def hashed(shift, i, by):
        length = n - shift
        size, short = F.floor(length / parts).cast("int"), F.lit(parts) - F.pmod(length, F.lit(parts))  # the first segments are the shorter ones
        start = F.lit(i) * size + F.greatest(F.lit(i) - short, F.lit(0)) + by
        width = size + F.when(F.lit(i) >= short, 1).otherwise(0)
        key = F.xxhash64(length, F.lit(i), F.substring(line, start + 1, width))
        if (shift, by) == (0, 0):
            return key
        return F.when((length >= least) & (start >= 0) & (start + width <= n), key)

    probed = [hashed(shift, i, by) for shift in range(threshold + 1) for i in range(parts)
              for by in range(max(-i, shift - (threshold - i)), min(i, shift + (threshold - i)) + 1) if (shift, by) != (0, 0)]
    return [hashed(0, i, 0) for i in range(parts)], probed


def keys(line: Column, n: Column, threshold: int, least: int) -> tuple[Column, Column]:
    """``key_columns`` as two array<bigint>, without nulls."""
    filed, probed = key_columns(line, n, threshold, least)
    return F.array(*filed), F.array_compact(F.array(*probed)) if probed else F.array().cast("array<bigint>")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d1, d2, pos, line) per line; d1 and d2 name the document: its id (null: the largest) and its text's hash."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("d1"), F.xxhash64(text_col).alias("d2"), F.split(F.col(text_col), "\n").alias("lines"))
    # not posexplode, for which texts would be split three times: to drop nulls, to drop empty arrays, and to explode
    return rows.select("d1", "d2", F.posexplode_outer("lines").alias("pos", "line")).where("line is not null")


def digest(line: Column) -> Column:
    """The line's name.  It cannot be null as far as Spark knows: joins on it would hash each line again, to drop nulls."""
    return F.coalesce(F.unhex(F.md5(line)), F.lit(b""))


def mark(line: Column) -> Column:
    """A number that is worked out faster than the digest, for sieves."""
    return F.xxhash64(line)


def _block(n: Column, j: Column | int) -> tuple[Column, Column]:
    """Where block j of a line of n characters begins and ends (places from 0, the end excluded)."""
    j = F.lit(j) if isinstance(j, int) else j
    start, end = (F.floor(by * n / BLOCKS).cast("int") for by in (j, j + 1))
    return start, end


def block_columns(line: Column, n: Column) -> tuple[list[Column], list[Column]]:
    """(hashes filed, hashes probed) of a line without each block.

    A line probes lines one character shorter without their block and, in its place, one character more of its own.
    """
    def hashed(shift, j):
        start, end = _block(n - shift, j)
        return F.xxhash64(n - shift, F.lit(j), F.substring(line, F.lit(1), start), F.substring(line, end + shift + 1, n))

    return [hashed(0, j) for j in range(BLOCKS)], [hashed(1, j) for j in range(BLOCKS)]


def meetings(keyed: DataFrame, names: list[str], filed: int) -> DataFrame:
    """(h, at, own, id, rows): the keys, in the columns ``names``, that lines of ``keyed`` share with others.

    ``at`` is the key's column; the first ``filed`` are a line's own.  ``rows`` counts the key's holders.
    """
    hashes = keyed.select("id", F.posexplode_outer(F.array(*names)).alias("at", "h")).where("h is not null").select("h", "at", (F.col("at") < filed).alias("own"), "id")
    every = Window.partitionBy("h")
    return hashes.withColumns({"rows": F.count(F.lit(1)).over(every), "filed": F.max("own").over(every)}).where("rows > 1 and filed").drop("filed")


def meeting_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a key at least one of them filed."""
    left, right = met.where("own").select("h", F.col("id").alias("a")), met.select("h", F.col("id").alias("b"), "own")
    # two lines that both filed the key meet once
    pairs = left.join(right, "h").where((F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def crowded_pairs(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) that link all distinct ``lines`` (id, line, chars) at one edit: those that share a
    longer key, and where that is crowded, a finer one."""
    filed, probed = block_columns(F.col("line"), F.col("chars"))
    names = [f"b{j}" for j in range(2 * BLOCKS)]
    # dealt by id: few lines can make many keys
    met = materialise(meetings(lines.repartition("id").select("id", *[h.alias(c) for c, h in zip(names, filed + probed)]), names, BLOCKS), "blocks")
    still = met.where(F.col("rows") > PAIRED).groupBy("id").agg(F.collect_set(F.when(F.col("own"), F.col("at"))).alias("own"), F.collect_set(F.when(~F.col("own"), F.col("at") - BLOCKS)).alias("longer"))

    def places(n: Column, blocks: str, shift: int) -> Column:
        def of(j):
            start, end = _block(n, j)
            return F.when(end + shift > start, F.sequence(start + 1, end + shift)).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(blocks, of))

    n = F.col("chars")
    finer = lines.join(still, "id").select("id", "line", places(n, "own", 0).alias("replaced"), places(n - 1, "longer", 1).alias("deleted"))
    return meeting_pairs(met.where(F.col("rows") <= PAIRED)).unionByName(finer_pairs(finer, F.col("replaced"), F.col("deleted")))


def finer_pairs(lines: DataFrame, replaced: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """Pairs (a, b) that link all distinct ``lines`` (id, line) at one edit: a character replaced at one of the
    places ``replaced``, or the character at one of the places ``deleted`` left out (from 1; unless given, all)."""
    n = F.length("line")
    replaced, deleted = (F.sequence(F.lit(1), n) if at is None else at for at in (replaced, deleted))

    def without(i: Column) -> Column:
        return F.concat(F.substring("line", F.lit(1), i - 1), F.substring("line", i + 1, n))

    def keyed(kind: int, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    apart = F.transform(replaced, lambda i: keyed(1, F.xxhash64(n, i, without(i))))
    shorter = F.transform(F.array_distinct(F.transform(deleted, without)), lambda t: keyed(2, F.xxhash64(t)))
    whole = F.array(keyed(0, F.xxhash64("line")))
    # a whole line and lines with one character more share a key, kind 0 first
    rows = lines.select("id", F.explode(F.concat(whole, apart, shorter)).alias("k")).select("id", "k.*", (F.col("k.kind") == 1).alias("replaced"))
    first = F.first("id").over(Window.partitionBy("replaced", "key").orderBy("kind", "id"))
    kind = F.first("kind").over(Window.partitionBy("replaced", "key").orderBy("kind", "id"))
    met = rows.select("id", first.alias("hub"), kind.alias("hub_kind")).where("id <> hub and hub_kind < 2")
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def sieve(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``, before a join shuffles them.

    A bit map of hashes: it has at most 2^(SIEVE_BITS - 6) words whatever the
    data, so it can be broadcast.  It lets every wanted row pass.
    """
    # neither word nor bit can be null, so no filter works them out a second time
    place = F.xxhash64(column).bitwiseAND(_number((1 << SIEVE_BITS) - 1))
    bits = wanted.select(place.alias("p")).select(F.expr("shiftrightunsigned(p, 6) AS word"), F.expr("shiftleft(1L, cast(p & 63 AS int)) AS bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("mask"))
    held = rows.withColumn("p", place).withColumn("word", F.expr("shiftrightunsigned(p, 6)")).join(F.broadcast(words), "word")
    return held.where("mask & shiftleft(1L, cast(p & 63 AS int)) <> 0").select(*rows.columns)


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line that occurs again, exactly or nearly: line (digest), mark, keep (whether it stays), first (the document where), size of its class."""
    lines = lines_of(docs, id_col, text_col).where(F.length("line") >= max(least, threshold + 1))
    filed, probed = key_columns(F.col("line"), F.col("chars"), threshold, least)
    names = [f"h{i}" for i in range(len(filed) + len(probed))]
    # lines move as their digests and keys; equal lines have equal keys
    hashed = lines.withColumn("chars", F.length("line")).select("d1", digest(F.col("line")).alias("id"), mark(F.col("line")).alias("mark"), *[h.alias(c) for c, h in zip(names, filed + probed)])
    distinct = hashed.groupBy("id").agg(F.min("d1").alias("first"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ["mark", *names]])
    distinct = materialise(distinct, "lines")

    met = materialise(meetings(distinct, names, len(filed)).drop("at"), "met")
    many = F.col("rows") > PAIRED if threshold == 1 else F.lit(False)
    pairs = meeting_pairs(met.where(~many))
    # every line that met another one, read once: for the finer keys and for the check
    wanted = materialise(met.select("id").distinct(), "wanted")
    texts = sieve(lines.select(digest(F.col("line")).alias("id"), "line"), wanted, "id").join(wanted, "id").distinct()  # a semi join would be moved before the sieve
    texts = materialise(texts.withColumn("chars", F.length("line")), "texts")
    if threshold == 1:
        crowded = met.where(many).select("id").distinct()
        pairs = pairs.unionByName(crowded_pairs(texts.join(crowded, "id")))
    pairs = materialise(pairs.distinct(), "pairs")

    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("chars").alias(f"chars_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(may_be_near(F.col("line_a"), F.col("line_b"), threshold, m=F.col("chars_a"), n=F.col("chars_b")))
    links = materialise(both.where(near(F.col("line_a"), F.col("line_b"), threshold)).select("a", "b"), "links")

    roots = components(links)
    placed = distinct.select("id", "mark", "first", "n").join(roots, F.col("id") == F.col("node"), "left").where("root is not null or n > 1")
    placed = placed.withColumn("root", F.coalesce("root", "id"))
    best = placed.groupBy("root").agg(F.min(F.struct("first", "id")).alias("best"), F.sum("n").alias("size"))
    return placed.join(best, "root").select(F.col("id").alias("line"), "mark", (F.col("best.id") == F.col("id")).alias("keep"), F.col("best.first").alias("first"), F.col("root").alias("class"), "size")


def removals(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d1, d2, drop, exact, nearly) per document that loses lines: their positions (from 0), and how many go
    as copies of the line that stays and as near copies of it."""
    classes = materialise(line_classes(docs, threshold, least, id_col, text_col), "classes")
    lines = lines_of(docs, id_col, text_col).where(F.length("line") >= max(least, threshold + 1))
    held = sieve(lines.withColumn("mark", mark(F.col("line"))), classes, "mark")
    met = held.select("d1", "d2", "pos", digest(F.col("line")).alias("line")).join(classes.drop("mark"), "line")
    own = met.groupBy("d1", "d2", "line").agg(F.collect_set("pos").alias("at"), F.first("keep").alias("keep"), F.first("first").alias("first"))
    stays = F.col("keep") & (F.col("first") == F.col("d1"))
    gone = F.when(stays, F.array_except("at", F.array(F.array_min("at")))).otherwise(F.col("at"))
    own = own.select("d1", "d2", "keep", gone.alias("gone")).where(F.size("gone") > 0)
    return own.groupBy("d1", "d2").agg(
        F.flatten(F.collect_list("gone")).alias("drop"),
        F.sum(F.when(F.col("keep"), F.size("gone")).otherwise(0)).alias("exact"),
        F.sum(F.when(F.col("keep"), 0).otherwise(F.size("gone"))).alias("nearly"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the whole row of ``docs``), kept (its text without the removed lines), lines, exact, nearly."""
    gone = materialise(removals(docs, threshold, least, id_col, text_col), "gone")
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("d1"), F.xxhash64(text_col).alias("d2"))
    rows = packed.join(gone, ["d1", "d2"], "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    # the lines are bound once: named inside the inner function they would be split anew for each line
    rest = _let(lines, lambda all_lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("drop")), lambda i: F.get(all_lines, i)), "\n"))
    kept = F.when(F.col("drop").isNull(), text).otherwise(rest)
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1  # texts that lose nothing are not split
    return rows.select("row", kept.alias("kept"), F.coalesce(n_lines, F.lit(0)).alias("lines"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("exact", "nearly")])


def drop_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``docs`` with the shortened texts (and n_chars); documents that lost every line are left out."""
    rows = dedup(docs, threshold, least).where((F.col("exact") + F.col("nearly") == 0) | (F.col("exact") + F.col("nearly") < F.col("lines")))
    fields = {"text": F.col("kept")} | ({"n_chars": F.when(F.col("exact") + F.col("nearly") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.select(*[fields.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
