"""Cutting lineages in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, but only in one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lexivec-")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint: later jobs read it from the shared folder."""
    own = df.sparkSession.sparkContext
    if not own._jsc.sc().getCheckpointDir().isDefined():
        own.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder that nobody else writes to."""
    return f"{shared_dir(spark)}/lexivec-{name}-{uuid.uuid4().hex}"


#: Bytes of a table up to which it is dealt to all cores, whatever its splits.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df; if its files are small, and so few splits, dealt anew to all cores. Large tables have splits enough and aren't moved."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


#: Bytes and rows of an Arrow batch for Python tasks. Rows are whole texts and lists of their tokens, so Spark's own 10000 rows are tens of MB, and what is made of them several times that in each worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches, so that what Python workers hold doesn't grow with tables or texts; smaller settings stay."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(key).lower().rstrip("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(key, str(most))
