"""Session facts the corpus operators rely on."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and name the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is
    unset on a local master (tests) a temporary one is taken; else it is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attestor-"))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows written as Parquet in the shared checkpoint folder, and read again."""
    path = f"{prepare(spark).sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of steps that are over.

    It does so once the driver's garbage collector has found their owners.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
