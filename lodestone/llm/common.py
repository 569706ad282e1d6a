"""Reading, sizing and lineage helpers that the operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again.

    Unlike after cut(), its estimated size is that of its files: estimates of checkpoints carry over, and a join
    multiplies them, so in a loop their length doubles from round to round."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    kept = df.sparkSession.read.schema(df.schema).parquet(folder)
    kept.stored_in = folder
    return kept


def release(*stored: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more.

    Spark's cleaner then drops shuffles that nothing refers to: it acts on the collection of their handles, which a
    driver with little garbage would put off."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if stored:
        spark._jvm.System.gc()


def fold(id_column: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo `parts`; null ids have a null fold."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
