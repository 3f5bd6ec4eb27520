"""Splittable reading of quoted formats: records that lines alone don't show.

A quoted CSV record may hold line breaks, and a JSON text has no line structure
at all, so a reader that starts in the middle of a file cannot tell where it
is.  Whole-file readers therefore give a file to one task.  Here the text
source reads byte ranges in parallel, split at a separator (a line feed, or the
quote itself), and the state at the start of a range follows from the ranges
before it:

1. each range counts its quotes, and what it would hold if it started outside
   or inside a quoted text (one pass over numbers, a row a range);
2. a prefix sum over the ranges of a file gives the parity of quotes before the
   range, hence whether it starts inside a quoted text and which of the two holds;
3. each range is read again from that state, and pieces that belong together are
   joined as they come;
4. what a range's last record lacks is at the head of the next ranges, and only
   those ends are joined across ranges.

The pieces stay where they are read: they are neither shuffled nor sorted, and a
task holds one Arrow batch and one record at a time, whatever the size of the
file and of its ranges.  Reading twice gives the same ranges.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# executors get these functions with the job: they need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = ["f", "b"]  # file, first byte of the range
_ALL_BEFORE = (Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """f, t (modification time), b and the piece between two separators, in the file's order."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"),
                      F.col("_metadata.file_block_start").alias("b"), F.col("value").alias("piece"))


def quotes(text: str) -> Column:
    return F.length(text) - F.length(F.translate(text, '"', ""))


def csv_texts(before, so_far, blank):
    """Of pieces with ``before`` quotes: which belong to a record, the record's
    number, and the last number; ``so_far`` is the number before them."""
    import numpy as np

    outside = before % 2 == 0
    starts = outside & (blank == 0)  # an empty line between records is none
    numbers = so_far + np.cumsum(starts)
    return starts | ~outside, numbers, int(numbers[-1])


def json_texts(before, so_far, told):
    """Of pieces with ``before`` quotes: which belong to a string that is an
    element, the string's number, and what was told last (1: elements follow, 0:
    others do, -1: nothing yet); ``so_far`` was told before them."""
    import numpy as np

    inside = before % 2 == 1
    said = np.where(inside, -1, told)
    last = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
    now = np.where(last >= 0, said[last], so_far)
    return inside & (now == 1), before, int(now[-1])


def _slices(batches):
    """The batches, cut where another range starts: (whether one does, slice)."""
    import numpy as np
    import pyarrow.compute as pc

    at = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        f, b = batch.column("f"), batch.column("b").to_numpy()
        other = (b[1:] != b[:-1]) | pc.not_equal(f[1:], f[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            here = (f[i].as_py(), int(b[i]))
            yield here != at, batch.slice(i, j - i)
            at = here


def _before(q, at: int):
    """How many quotes stand before each piece, and after the last."""
    total = q.cumsum()
    return at + total - q, at + int(total[-1])


def _range_sums(texts, first: int):
    """Per range: its quotes, and where ``texts`` gets to from outside (``out``) and from inside (``within``)."""
    def sums(batches):
        import pyarrow as pa

        key = None

        def row():
            return pa.RecordBatch.from_pydict({"f": [key[0]], "b": [key[1]], "q": [n], "out": [ends[0]], "within": [ends[1]]})

        for starts, part in _slices(batches):
            if starts:
                if key:
                    yield row()
                key, n, ends = (part.column("f")[0].as_py(), part.column("b")[0].as_py()), 0, [first, first]
            before, after = _before(part.column("q").to_numpy(), n)
            mark = part.column("mark").to_numpy()
            ends = [texts(before + k, ends[k], mark)[2] for k in (0, 1)]
            n = after
        if key:
            yield row()

    return sums


def _joined(texts, separator: bytes, ends_only: bool):
    """The pieces of each text as one, by its number; ``broken``: it may go on in another range."""
    def rows(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["f", "t", "b", "number", "broken", "text"]
        opened = None  # f, t, b, number, pieces so far of the last text

        def ended(broken: bool):
            f, t, b, number, parts = opened
            if broken or not ends_only:
                yield pa.RecordBatch.from_arrays([f, t, b, pa.array([number], pa.int64()), pa.array([broken]), pa.array([separator.join(parts)], pa.binary())], names)

        def held(part, numbers, rest, i):
            return *(part.column(c).slice(0, 1) for c in "ftb"), int(numbers[i]), rest[i:].to_pylist()

        for starts, part in _slices(batches):
            if starts:
                if opened:
                    yield from ended(opened[3] == head or after % 2 == 1)
                opened, after, so_far = None, part.column("at")[0].as_py(), part.column("so_far")[0].as_py()
                # the text that an earlier range leaves open
                head = None if after % 2 == 0 else after if texts is json_texts else so_far
            before, after = _before(part.column("q").to_numpy(), after)
            keep, numbers, so_far = texts(before, so_far, part.column("mark").to_numpy())
            if not keep.any():
                continue
            numbers, rest = numbers[keep], part.column("piece").filter(pa.array(keep))
            firsts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            if opened and opened[3] == numbers[0]:
                upto = int(firsts[1]) if len(firsts) > 1 else len(rest)
                opened[4].extend(rest[:upto].to_pylist())
                firsts = firsts[1:]
            if not len(firsts):
                continue
            if opened:
                yield from ended(opened[3] == head)
            if len(firsts) > 1:  # all but the last one end here
                whole = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), rest)
                own = numbers[firsts[:-1]]
                broken = np.zeros(len(own), bool) if head is None else own == head
                fixed = [pc.take(part.column(c), pa.array(np.zeros(len(own), np.int64))) for c in "ftb"]
                batch = pa.RecordBatch.from_arrays([*fixed, pa.array(own, pa.int64()), pa.array(broken), pc.binary_join(whole, separator)], names)
                yield batch.filter(pa.array(broken)) if ends_only else batch
            opened = held(part, numbers, rest, int(firsts[-1]))
        if opened:
            yield from ended(opened[3] == head or after % 2 == 1)

    return rows


def _texts(spark: SparkSession, path: str, separator: str, marked, texts, first: int, state, of_ranges: str = "true") -> DataFrame:
    """f, t, number and text of each text in the files; ``marked`` adds q and mark to
    the pieces, ``state`` is where ``texts`` starts in a range, from the sums of the
    ranges before.  ``of_ranges`` picks ranges by that state (``so_far``)."""
    read = marked(pieces(spark, path, separator)).withColumns({"q": F.col("q").cast("bigint"), "mark": F.col("mark").cast("int")})
    sums = read.select(*HEAD, "q", "mark").mapInArrow(_range_sums(texts, first), "f string, b bigint, q bigint, out bigint, within bigint")
    earlier = Window.partitionBy("f").orderBy("b").rowsBetween(*_ALL_BEFORE)
    starts = sums.withColumn("at", F.coalesce(F.sum("q").over(earlier), F.lit(0)))
    starts = starts.withColumn("to", F.when(F.col("at") % 2 == 0, F.col("out")).otherwise(F.col("within")))
    starts = starts.select(*HEAD, "at", state(earlier).cast("bigint").alias("so_far")).where(of_ranges)
    # a row a range, no more than the listing of files that Spark holds anyway; the pieces stay in their order
    read = read.join(F.broadcast(starts), HEAD)
    read = read.select("f", F.unix_micros("t").alias("t"), "b", "q", "mark", "at", "so_far", F.col("piece").cast("binary").alias("piece"))
    shape = "f string, t bigint, b bigint, number bigint, broken boolean, text binary"
    records = lambda ends: read.mapInArrow(_joined(texts, separator.encode(), ends), shape).withColumn("text", F.col("text").cast("string"))
    # what a range leaves open goes on at the heads of the next ranges
    part = F.sort_array(F.collect_list(F.struct("b", "text")))
    mended = records(True).groupBy("f", "number").agg(F.max("t").alias("t"), F.array_join(F.transform(part, lambda p: p["text"]), separator).alias("text"))
    whole = records(False).where("not broken").select("f", "number", "t", "text").unionByName(mended)
    return whole.select("f", F.timestamp_micros("t").alias("t"), "number", "text")


def csv_records(spark: SparkSession, path: str, headers_only: bool = False) -> DataFrame:
    """f, t, row (its place in the file, the header's is 0) and text of each CSV record.

    ``headers_only``: of those of row 0.  Ranges that begin after a file's second record are left out."""
    def marked(lines):
        return lines.withColumns({"q": quotes("piece"), "mark": F.col("piece").isin("", "\r")})

    # numbers go on from the records of the ranges before
    found = _texts(spark, path, "\n", marked, csv_texts, 0, lambda earlier: F.coalesce(F.sum("to").over(earlier), F.lit(0)) - 1,
                   "so_far <= 0" if headers_only else "true")
    found = found.where("number = 0") if headers_only else found
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "^\ufeff", "")
    return found.select("f", "t", F.col("number").alias("row"), text.alias("text"))


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """f and text of each string that is an element of an array, for JSON files of any size.

    The pieces are split at quotes; a quote after an odd number of backslashes
    belongs to the string.  Between strings, the last bracket or colon says whether
    the strings after it are elements; what follows a nested array or object counts as
    belonging to none.
    """
    def marked(split):
        backslashes = F.length("piece") - F.length(F.rtrim("piece", F.lit("\\")))
        marks = F.regexp_replace("piece", r"[^\[\]{}:]", "")
        return split.withColumns({"q": F.when(backslashes % 2 == 0, 1).otherwise(0), "mark": F.when(marks == "", -1).when(marks.endswith("["), 1).otherwise(0)})

    # what a range is told last holds until a later range is told anew
    found = _texts(spark, path, '"', marked, json_texts, -1, lambda earlier: F.coalesce(F.last(F.when(F.col("to") >= 0, F.col("to")), ignorenulls=True).over(earlier), F.lit(-1)))
    text = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), "text", F.lit('"'))), "$", "string")
    return found.select("f", text.alias("text"))
