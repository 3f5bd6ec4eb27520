"""Sinks: the run table, raw per-run documents, CSV exports, report tables.

Parquet is the primary format; CSV is an export (header, quoted line
breaks).  Nothing is collected to the driver: every report is written by the
executors, and the run table that feeds several reports is materialised
once in the shared checkpoint folder so a lost executor recomputes from that
table, not from the sources.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.operators import reports as R
from runlens.operators.ranking import last_by_key
from runlens.plans.resume import normalise_file_part, with_keys_from_names

REPORT_COLUMNS = ["run_seq", "group_id", "design", "repeat_idx", "scene_id", "scene_name", "scheme", "model", "param_set",
                  "temperature", "top_p", "input_tokens", "output_tokens", "elapsed_time", "success",
                  *S.DIM_COLS]


def write_runs(runs: DataFrame, path: str, mode: str = "append", partition_by: str | None = "scene_id") -> None:
    """W2 (primary) / W9: append runs to the parquet run table.  Appending
    *is* marking runs complete -- completed keys are derived from the table."""
    w = runs.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """W2-W6 exports: CSV with header; text with line breaks is quoted, and
    white space around a text is kept."""
    w = df.write.mode(mode).option("header", True).option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def raw_file_key(runs: DataFrame) -> F.Column:
    """Exploratory raw-output file name (without ``.json``).  A missing
    part is printed into the name, so such runs keep a name of their own."""
    parts = ["scene_id", "scheme", "param_set", "model", F.col("repeat_idx").cast("string")]
    return normalise_file_part(F.concat_ws("_", *[F.coalesce(p, F.lit(str(None))) for p in parts]))


RAW_DOCUMENTS = "file_key string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in S.RAW_RECORD.fields if f.name != S.SCORE_NOTE_KEY)


def raw_documents(runs: DataFrame, key: F.Column | None = None) -> DataFrame:
    """Runs under the experiment's field names, with ``file_key``; of equal names the last write."""
    k = key if key is not None else raw_file_key(runs)
    latest = last_by_key(runs.withColumn("file_key", k), ["file_key"], "run_seq")
    return latest.select(
        "file_key", "run_seq", F.col("group_id").alias("group"),
        (F.col("design") if "design" in latest.columns else F.lit(None).cast("string")).alias("design"), "scene_id", "scene_name", "scheme", "model",
        "param_set", "temperature", "top_p", F.col("repeat_idx").cast("int").alias("repeat_idx"), "input_tokens", "output_tokens", "elapsed_time",
        "output_content", "json_valid", "success", "error",
        *[F.col(c).alias(k2) for c, k2, _ in S.DIMENSIONS])


def write_raw_outputs(runs: DataFrame, path: str, key: F.Column | None = None, mode: str = "overwrite") -> None:
    """Per-run JSON documents under the experiment's field names.

    Files with equal names overwrite each other in the experiment; here the
    last write per name is kept explicitly (N3) and documents are written
    partitioned by scene instead of one file per run.
    """
    raw_documents(runs, key).write.mode(mode).partitionBy("scene_id").json(path)


def merge_raw_outputs(runs: DataFrame, path: str, key: F.Column | None = None) -> None:
    """W1 across writes: ``runs`` into documents written before, last write first.

    Only the scenes that ``runs`` touches are read and replaced (partitions are
    swapped when the job commits); the others' files stay as they are.  The
    merged documents are checkpointed before the files they came from go.
    """
    spark = runs.sparkSession
    new = materialise(raw_documents(runs, key))
    scenes = [r[0] for r in new.select("scene_id").distinct().collect()]  # a dimension of the experiment
    try:
        stored = spark.read.schema(RAW_DOCUMENTS).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = new.limit(0)
    touched = F.col("scene_id").isin([s for s in scenes if s is not None])
    if None in scenes:
        touched = touched | F.col("scene_id").isNull()
    both = stored.where(touched).select(*new.columns).unionByName(new)
    merged = materialise(last_by_key(both, ["file_key"], "run_seq").select(*new.columns))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").json(path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in ``spark.checkpoint.dir``."""
    from runlens.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_reports(runs: DataFrame, out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """Every report table of the exploratory experiment into one folder.

    The aggregate reports come from one grouping-sets aggregation over a
    narrow projection of ``runs`` (one scan, partial aggregates shuffled);
    each small result is checkpointed before it is written.  The consistency
    report is written only when it has rows (as in the experiment); the
    per-run detail and the per-scene sheets are partitioned writes.
    """
    narrow = runs.select(*[c for c in REPORT_COLUMNS if c in runs.columns])
    # every aggregate report from one grouping-sets aggregation; its result
    # (one row per group) is what gets checkpointed, not the run table
    tables = R.report_tables(narrow, materialise=materialise)
    # the recorded repeat number is what the sheet shows; only a table that
    # never recorded one is numbered here
    detail_base = narrow if "repeat_idx" in narrow.columns else R.with_repeat_idx(narrow)
    tables["detail"] = R.detail(detail_base)
    # aggregate reports have one row per configuration: one file each; the
    # detail table has one row per run and keeps the full parallelism
    per_run = {"detail"}
    written = {}
    for name, df in tables.items():
        if name == "consistency_report" and df.isEmpty():
            continue
        p = f"{out_dir.rstrip('/')}/{name}"
        out = df if name in per_run else df.coalesce(1)
        (export_csv(out, p) if fmt == "csv" else out.write.mode("overwrite").parquet(p))
        written[name] = p
    sheets = R.detail(detail_base).withColumn("scene_sheet", R.sheet_name("scene_name"))
    p = f"{out_dir.rstrip('/')}/scene_sheets"
    sheets.write.mode("overwrite").partitionBy("scene_sheet").option("header", True).csv(p)
    written["scene_sheets"] = p
    return written


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "run_seq", buckets: int = 256,
                   mode: str = "overwrite") -> None:
    """Write a run-keyed relation as a bucketed, sorted table.

    Two tables bucketed on the same key with the same bucket count join
    without an exchange on either side (J7 at scale: run outputs and judge
    replies are both one row per run).  ``path`` should be on the shared
    filesystem; the catalog entry only records it.
    """
    (df.write.mode(mode).bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))


def write_orthogonal_reports(runs: DataFrame, out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """A8, A10, A12 of the orthogonal experiment into one folder, from one
    grouping-sets pass whose small result is checkpointed once."""
    from runlens.plans.design import orthogonal_designs

    tables = R.orthogonal_report_tables(with_keys_from_names(runs), orthogonal_designs(), materialise=materialise)
    written = {}
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        (export_csv(df.coalesce(1), p) if fmt == "csv" else df.coalesce(1).write.mode("overwrite").parquet(p))
        written[name] = p
    return written
