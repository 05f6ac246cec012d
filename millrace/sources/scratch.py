"""Intermediate tables in the folder that the driver and all executors share, and the size of Arrow batches."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in unit tests.
DEFAULT_SHARED = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = DEFAULT_SHARED
    return f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a re-computation,
    and a result that several consumers need is computed once. Rows of megabytes need row groups of
    about ``group_bytes`` as written: sizes are looked at from the 100th row on otherwise, and a reader unpacks a row group at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # The table stands for the shuffles that made it: their files go as soon as it is written.
    before = spark.conf.getAll.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        sizes = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
        df.write.option("compression", "zstd").options(**sizes).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`materialise` result that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/millrace/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> SparkSession:
    """Limit Arrow batches to ``BATCH_BYTES`` unless the session sets a limit: the JVM and its Python worker each hold some."""
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    return spark
