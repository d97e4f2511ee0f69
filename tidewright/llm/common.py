"""Scratch tables in the cluster's shared folder, and small helpers that the operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the corpus contracts: space and U+0009 to U+000D. Fixed value.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a regular expression class. Fixed value.
WHITE_CLASS = r"[\x20\x09-\x0D]"

_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    It is set here only where it is unset and the master is local, as in tests; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-shared-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted by whoever is `recording`."""
    path = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}/{name}"
    for known in _scratch:
        known.append(path)
    return path


@contextlib.contextmanager
def recording(paths: list[str]) -> Iterator[list[str]]:
    """Adds to `paths` the scratch paths that are made meanwhile, so that they can be released later."""
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.pop()


def stage_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back, which cuts its lineage.

    Later stages then survive the loss of executors without repeating the work, and repeated reads see the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables. Call it once results that read them are written elsewhere."""
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop().rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, with underscores before where `columns` has them already; Spark's names know no case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame, items: int, *columns: str, most: int = 20_000) -> DataFrame:
    """`df` dealt by `columns` to a task for each of `items` things, `most` at most.

    Rows that stand for much work, such as a path to be read, are small themselves; without a number adaptive execution
    would put all of them into one task.
    """
    return df.repartition(max(1, min(items, most)), *columns)
