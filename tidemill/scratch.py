"""Scratch tables in the folder that the cluster shares, so that a lost executor loses nothing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = "spark.checkpoint.dir"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def aside(path: str) -> str:
    """Where the old state of a folder stands while a new one takes its place."""
    return f"{path.rstrip('/')}.previous"


def move_into_place(spark: SparkSession, fresh: str, path: str) -> None:
    """Renames the folder fresh to path; what was there is moved aside first and removed at last, so that one of both is whole at every moment."""
    jvm = spark._jvm.org.apache.hadoop.fs
    here, new, old = jvm.Path(path), jvm.Path(fresh), jvm.Path(aside(path))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(old, True)
        if not fs.rename(here, old):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, here):
        raise OSError(f"cannot move the new snapshot to {path}")
    fs.delete(old, True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder that the session names; it is removed when the driver ends.

    Where none is named, a local master gets a folder of its own and a cluster gets an error: its
    executors would each write to a disk that the others cannot see."""
    root = spark.conf.get(ROOT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {ROOT} to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "tidemill-scratch")
        spark.conf.set(ROOT, root)
    path = f"{root.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Rows go to Python and back in batches of so many bytes, which bounds what a task holds of long texts.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Where several functions stand one behind the other, each has a process of its own, which holds its batch in several forms.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings for the jobs started inside; the session's own come back afterwards."""
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, batches: dict[str, str] = BATCHES) -> DataFrame:
    """df, written to the shared scratch folder and read again: lineage ends there."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    with settings(spark, batches):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
