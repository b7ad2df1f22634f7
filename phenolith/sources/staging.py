"""Tables written between the rounds of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be sent to every executor.
DIMENSION_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, in local mode, an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """df to be broadcast if it has at most ``most`` rows, which is counted; else as it is, for Spark to choose."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df for work that is heavy for its bytes: over all cores where its files make fewer partitions than that.

    Tables of many files stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
