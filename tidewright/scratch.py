"""Tables written to the folder that a cluster's executors share, to cut lineage where a plan must not be evaluated twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; set here only where it is unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-shared-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """The tables of one run. What it stages is deleted when the run ends, but for what `kept` writes.

        with Scratch(spark) as scratch:
            part = scratch.staged(df, "part")
            return scratch.kept(part.join(...), "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written and read back for the time of the run."""
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written beside the run's tables and read back; it outlives the run."""
        return staged(df, name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back: later uses see the same rows, in the same partitions' numbers, once computed."""
    path = f"{shared_dir(df.sparkSession)}/tidewright-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
