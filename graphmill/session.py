"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for sessions this library creates itself; an existing session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "graphmill", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the library's defaults."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``. Where it is unset a local session takes a temporary folder; a cluster, whose machines do not share one, is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "graphmill-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """``cut`` for what a loop joins again and again: the estimated size is forgotten with the plan. A join multiplies the estimates of its sides, so their digits would double with each round until they fill the driver's memory."""
    rows = cut(df)._jdf.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), df.sparkSession)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Keep Arrow batches to Python workers small, as texts vary from nothing to megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop the plans of earlier rounds of a loop; their shuffle files go with them, and checkpoint files where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
