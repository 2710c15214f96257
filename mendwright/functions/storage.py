"""Results that are used more than once: kept where all executors find them, so that a lost one costs nothing but its task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, or a temporary one in local runs."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        local = context.master.startswith("local")
        folder = f"file://{tempfile.mkdtemp(prefix='mendwright-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/mendwright-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out now and read from the shared folder from here on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
