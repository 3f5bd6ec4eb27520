"""File sources: score CSVs, raw per-run JSON documents, progress files.

Schemas are never inferred.  The experiment writes its CSVs with pandas
(UTF-8 with BOM, output text with line breaks, column order depending on
which row shapes occur), so a CSV is read with its header as all-string
columns and *conformed by name* to the run schema: renamed, cast with
``try_cast`` (an empty field is NULL), missing columns NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas as S
from runlens.operators.ranking import global_rank
from runlens.sources.ordered import csv_records, json_strings

# reference column name -> our column name
RENAMES = {"group": "group_id", S.SCORE_NOTE_KEY: "score_note",
           **{k: c for c, k, _ in S.DIMENSIONS}}


def conform(df: DataFrame, schema: T.StructType = S.RUNS) -> DataFrame:
    """Rename reference columns, cast to ``schema``, add missing columns as
    NULL; NaN becomes NULL so averages skip it."""
    present = {RENAMES.get(c, c): c for c in df.columns}
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in present:
            src = F.col(f"`{present[f.name]}`")
            if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                # "3.0" is how a column with gaps spells 3; large numbers keep every digit
                c = F.coalesce(src.try_cast(f.dataType), src.try_cast("double").cast(f.dataType))
            elif isinstance(f.dataType, T.DoubleType):
                c = src.try_cast("double")
                c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
            elif isinstance(f.dataType, T.BooleanType):
                c = src.cast("string").try_cast("boolean")
            else:
                c = src.cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    consumed = {present[f.name] for f in schema.fields if f.name in present}
    extra = [F.col(c) for c in df.columns if c.startswith("_") and c not in consumed]
    return df.select(*cols, *extra)


#: Columns that a score CSV may have.
MAX_CSV_COLUMNS = 128


def _fields(text: str) -> Column:
    """The fields of a CSV record as an array (NULL beyond the last)."""
    names = [f"c{i}" for i in range(MAX_CSV_COLUMNS + 1)]
    row = f"from_csv({text}, '{', '.join(f'{n} string' for n in names)}', map('escape', '\"'))"
    return F.expr(f"get(transform(array({row}), r -> array({', '.join(f'r.{n}' for n in names)})), 0)")


def read_runs_csv(spark: SparkSession, path: str, with_file_order: bool = True) -> DataFrame:
    """A score CSV (``all_scores.csv`` / ``results.csv``) as runs.

    Fields may hold line breaks, and still a file is read by as many tasks as
    its size asks for (``sources.ordered``).  Columns are found by each file's
    own header, so files with other columns or another order of them may lie in
    one folder.  Exports of this library carry ``run_seq``.  For other files,
    ``with_file_order`` orders rows by (modification time, file name, row in
    the file) and numbers them: the file's place in the upper digits, the row's
    in the lower ones.
    """
    records = csv_records(spark, path)
    names = _fields("text")
    names = F.when(F.get(names, F.lit(MAX_CSV_COLUMNS)).isNull(), names).otherwise(
        F.raise_error(F.lit(f"a score CSV has at most {MAX_CSV_COLUMNS} columns")).cast("array<string>"))
    spelt = {f.name: [f.name] + [k for k, v in RENAMES.items() if v == f.name] for f in S.RUNS.fields}
    spellings = [s for names in spelt.values() for s in names]
    # one row a file; only these are ranked.  Where each spelling stands is looked up once a file
    heads = csv_records(spark, path, headers_only=True).select("f", "t", names.alias("names"))
    heads = heads.select("f", F.array(*[(F.array_position("names", F.lit(s)) - 1).cast("int") for s in spellings]).alias("at"),
                         F.row_number().over(Window.orderBy("t", "f")).alias("nth"))
    # the rows stay with the task that reads them
    rows = records.where("row > 0").select("f", "row", _fields("text").alias("values")).join(F.broadcast(heads), "f")

    def field(name: str) -> Column:
        return F.coalesce(*[F.get("values", F.get("at", F.lit(spellings.index(s)))) for s in spelt[name]])

    rows = rows.select(*[field(c).alias(c) for c in spelt],
                       ((F.col("nth") - 1) * F.lit(1 << 33) + F.col("row") - 1).cast("bigint").alias("_nth"))
    df = conform(rows)
    return df.withColumn("run_seq", F.coalesce("run_seq", "_nth") if with_file_order else F.col("run_seq")).drop("_nth")


def file_order(spark: SparkSession, path: str) -> DataFrame:
    """f (path) and place of each file: the second of its modification time in the
    upper digits, its place within that second by (time, path) in the lower ones.

    Only the listing is read.  The files are ranked by ranges, so any number of
    them may bear one time.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("f"), F.col("modificationTime").alias("t"))
    ranked = global_rank(files, ["t", "f"], "nth").withColumn("second", F.floor(F.unix_micros("t") / 1_000_000).cast("bigint"))
    first = ranked.groupBy("second").agg(F.min("nth").alias("first"))
    return ranked.join(first, "second").select("f", (F.col("second") * F.lit(1 << 32) + F.col("nth") - F.col("first")).alias("place"))


def read_raw_outputs(spark: SparkSession, path: str, one_document_per_file: bool = True) -> DataFrame:
    """Raw per-run JSON documents -- one pretty-printed object per file as
    the experiment writes them, or JSON Lines as ``write_raw_outputs`` does.

    ``run_seq`` is the recorded one where the documents carry it.  Else, for
    one document per file, it is the file's place in ``file_order``; JSON Lines
    must carry it.  ``file_name`` is kept for key derivation.
    """
    raw = (spark.read.schema(S.RAW_RECORD).option("multiLine", one_document_per_file).json(path)
           .select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("_f")))
    df = conform(raw.withColumnRenamed("file_name", "_file_name"))
    if one_document_per_file:
        # names alone are ranked, the documents only meet their place
        df = df.join(file_order(spark, path).withColumnRenamed("f", "_f"), "_f").withColumn("run_seq", F.coalesce("run_seq", "place")).drop("place")
    else:
        df = df.withColumn("run_seq", F.coalesce("run_seq", F.raise_error(F.lit("JSON Lines documents need run_seq"))))
    return df.withColumnRenamed("_file_name", "file_name").drop("_f")


def list_raw_output_names(spark: SparkSession, path: str) -> DataFrame:
    """S3: names of the raw-output files (content is not read: the binary
    source only loads it when the column is selected).

    A name is the first part of the path under ``path`` that ends in ``.json``: a file's own
    name, or the folder's where a run has a folder (``file_name=<name>.json``).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/=]+\.json)(/.*)?$", 1).alias("file_name"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A progress file ``{"completed": [key, ...]}`` -> one key per row.

    The file is one JSON text; its array is never built, and a large file is
    read by many tasks (``sources.ordered``).
    """
    return json_strings(spark, path).select(F.col("text").alias("run_key"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The primary run table: parquet with the ``RUNS`` schema (+ extras)."""
    return spark.read.parquet(path)
