"""Cutting lineage in iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no folder and all runs on one machine, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the folder of spark.checkpoint.dir, which all executors share, and go on from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or DEFAULT_DIR)
    return df.checkpoint()
