"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# A join is broadcast only when its side was measured: estimates before the run take a compressed file for its rows and
# an exploded or parsed row for its source, so they broadcast tables of any size through the driver.
MEASURED_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}
DEFAULTS = MEASURED_JOINS | {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings this package relies on; `master` only for local runs."""
    builder = SparkSession.builder.appName(name)
    conf = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        conf |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def measure_joins(spark: SparkSession) -> None:
    """Set `MEASURED_JOINS` on a session that something else has built."""
    for key, value in MEASURED_JOINS.items():
        spark.conf.set(key, value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which all executors share.

    Only a local session may leave it unset: it gets a temporary folder that goes with the process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="repolens-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration state in the reliable checkpoint folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
