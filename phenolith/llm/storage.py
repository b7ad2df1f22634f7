"""Tables written between jobs, and bounded bitmaps built from distributed keys.

A table written to the shared folder cuts lineage: a lost executor costs the
rerun of one job, not of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where it is unset, in local mode, an own one."""
    folder = spark.conf.get(SHARED, None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column ``name`` that tells rows apart and is the same whenever docs is read.

    For rows read from files that is their place there; others are written first.
    """
    if "_metadata" in docs.columns:
        raise ValueError("a column of docs is named _metadata")
    place = F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias(name)
    try:
        return docs.select("*", place)
    except AnalysisException:  # no scan of files, or hidden by what follows it
        return written(docs, "numbered").select("*", place)


def placed_rows(df: DataFrame, columns: list[str], file: str, row: str) -> DataFrame:
    """Columns of df and two long ones that tell its rows apart and are the same whenever it is read: file and place in it.

    For rows read from files they are 64 bits of the path and the row's place; others are written first.
    """
    if "_metadata" in df.columns:
        raise ValueError("a column is named _metadata")
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").cast("long").alias(row)]
    try:
        return df.select(*columns, *place)
    except AnalysisException:  # no scan of files, or hidden by what follows it
        return written(df.select(*columns), "placed").select(*columns, *place)


def bitmap(keys: DataFrame, key: str | Column, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with bit ``key mod 2**bits`` set for each long key.

    Its size is fixed by ``bits`` whatever the input, so it may be sent to every task. It only
    ever serves as a filter before an exact join or sort: a set bit says nothing certain.
    """
    position = F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(1 << bits))
    words = (
        keys.select(position.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a key's bit is set. Keys: uint64."""
    p = keys & np.uint64(bits.size * 64 - 1)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
