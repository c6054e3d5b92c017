"""What several operators share: the shared folder, size-checked broadcasts, input columns."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and all runs on one machine, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"
#: Rows, and bytes of their strings and lists, that broadcast_if_small() sends to every executor at most.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or DEFAULT_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/chronogrid/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path written by new_path(); the session may be gone already."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  at exit the JVM may have ended
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: later reads survive lost executors and recompute nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where counting proves the size; else the frame as it is, for a shuffled join.

    Call it on materialised frames: the count is an action.
    """
    wide = [F.length(F.col(c).cast("string")) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))]
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(sum(wide[1:], wide[0])) if wide else F.lit(0), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found.rows <= rows and found["size"] <= size else df


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python at most BATCH_ROWS rows and about BATCH_BYTES at a time, for all plans of the session.

    The default of 10,000 rows takes many times that memory, in the JVM and in Python, where texts are long, and
    could pass the 2 GiB that 32-bit offsets reach.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
