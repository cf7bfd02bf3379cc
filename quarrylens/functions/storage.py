"""Tables written between stages into the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many times larger rows of tokens and facts are in memory than in their files, at most: names repeat, numbers are small.
PACKED = 100
#: Bytes of whole files for a task that makes logical lines, and of SQL text for one that lexes: a token takes some 400 bytes a sort.
FILES_A_TASK, SQL_A_TASK = 32 << 20, 1 << 20


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, a function that makes its Path objects)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local master gets one of its own; a cluster raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(df: DataFrame, *keys: str, size: Column | str, per_task: int) -> DataFrame:
    """``df`` by hash of the keys over all ``spark.sql.shuffle.partitions``, however few its bytes: for rows that the next
    step makes many times larger, which adaptive coalescing cannot foresee. A task gets about ``per_task`` of the sum of
    ``size``, so tasks grow in number, not in memory; the sum is a job of its own."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / per_task)), *keys)


@contextmanager
def honest_sizes(spark: SparkSession) -> Iterator[None]:
    """Files count as ``PACKED`` times their bytes while joins are planned: else a table of millions of alike rows in a few
    megabytes is broadcast, through the driver's memory. What is small as rows is still broadcast, at the latest when its
    stage has ended."""
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(float(before), PACKED)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored``, its joins planned with ``honest_sizes``."""
    with honest_sizes(df.sparkSession):
        return stored(df, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: later jobs neither repeat nor lose it. What was
    shuffled for it is deleted once it is written, as nothing reads that again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    home = shared_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.split(":", 1)[-1].lstrip("/").startswith(home.split(":", 1)[-1].lstrip("/")):
            fs, make = file_system(spark, folder)
            fs.delete(make(folder), True)
