"""Shared helpers: written tables in the cluster's shared folder, partition counts, id columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, a folder of our own. On a cluster such a
    folder would be another one on each machine, and rows would be lost without a word."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes `df` as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, instead of when the driver happens
    to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table from materialize() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, factor: float = 1.0) -> int:
    """Partitions of a shuffle whose volume is in proportion to the input: follows the number of input splits."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, int(factor * df.rdd.getNumPartitions()))


def trimmed(run):
    """An Arrow function whose worker gives the memory it has freed back to the system when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return wrapped
