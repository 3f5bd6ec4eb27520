"""Incremental ingest of raw per-run documents with Structured Streaming.

As runs finish, their JSON documents land in a folder.  A file-source stream
reads new files only, checks the model output (normalise + format checks),
and appends to the parquet run table through the file sink; the checkpoint
location records which files were consumed, so a restarted or re-run job
neither loses nor duplicates runs (exactly-once file sink).  The completed
keys for resuming are then a plain query over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens import schemas as S
from runlens.functions.jsoncheck import check_outputs
from runlens.sources.files import conform

CHECK_COLUMNS = ["structure_valid", "field_names_valid", "data_types_valid", "n_items", "correct_items"]


def raw_output_stream(spark: SparkSession, raw_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of raw documents conformed to the run schema,
    with the format-check columns (the output is parsed once per run)."""
    raw = (spark.readStream.schema(S.RAW_RECORD).option("multiLine", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(raw_dir)
           .select("*", F.col("_metadata.file_name").alias("_file_name"),
                   F.col("_metadata.file_path").alias("_path"),
                   F.col("_metadata.file_modification_time").alias("_mtime")))
    # a stream cannot rank the files of one second: their paths' hashes tell them apart
    second = F.floor(F.unix_micros("_mtime") / 1_000_000).cast("bigint")
    seq = F.shiftleft(second, 32).bitwiseOR(F.xxhash64("_path").bitwiseAND(F.lit((1 << 32) - 1)))
    runs = (conform(raw).withColumn("run_seq", F.coalesce("run_seq", seq))
            .withColumnRenamed("_file_name", "file_name").drop("_mtime", "_path"))
    # json_valid is recomputed from the text; the document's own flag is dropped
    checked = check_outputs(runs.drop("json_valid")
                            .withColumn("__text", F.coalesce("output_content", F.lit(""))), "__text")
    return checked.select(*[c for c in runs.columns], *CHECK_COLUMNS)


def start_ingest(spark: SparkSession, raw_dir: str, table_dir: str, checkpoint_location: str,
                 available_now: bool = True) -> StreamingQuery:
    """Append newly arrived run documents to the run table.

    ``available_now`` processes what is there and stops (a scheduled batch);
    otherwise the stream keeps running with a 30 s trigger.
    """
    w = (raw_output_stream(spark, raw_dir).writeStream.format("parquet")
         .option("path", table_dir).option("checkpointLocation", checkpoint_location)
         .partitionBy("scene_id").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
