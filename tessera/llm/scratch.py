"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local session without that setting, where the driver and the tasks are one
    process, gets a temporary folder; on a cluster, where executors don't share
    one, the lack is an error.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the cluster shares")
        named = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set(CHECKPOINT_DIR, named)
    return named


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    _delete(spark, _own_dir(spark))


class Table:
    """A DataFrame written to the shared folder, which cuts its lineage.

    Lost executors cost nothing: readers scan the files again.
    """

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark = df.sparkSession
        self.path = f"{_own_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        release(self.spark)

    def drop(self) -> None:
        """Delete the files; only for tables that no lazy result reads."""
        _delete(self.spark, self.path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` read back from a table in the shared folder, written with ``options``."""
    return Table(df, name, **options).df
