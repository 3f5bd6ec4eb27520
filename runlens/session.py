"""Session helpers.

Library code never builds its own session; it takes the caller's.  The helpers
here are for tests, the bench and the command-line entry points.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session we create gets.  AQE re-plans joins and coalesces
# small shuffle partitions at run time; variant duplicate keys follow the
# last-key-wins rule of Python's json module.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the call site of every column function is not recorded: large expressions are built several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "runlens", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session configured for this library."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the library relies on to an existing session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    The deployment must set it.  Only a session of a single local process
    without the setting (tests) gets a temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="runlens-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, set as the session's folder for checkpoints."""
    d = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(d)
    return d


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/runlens-{uuid.uuid4().hex}/{name}"
