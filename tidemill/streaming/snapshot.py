"""The cumulative merge as a stream: each micro-batch adds its new records to the snapshot.

Batches are kept by batch id, so a batch that is replayed after a failure replaces itself.
No watermark is used: history has no end after which a duplicate is welcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import FIELDS, RECORD, START_ID, assign_ids, deduplicate, record_fingerprint


FP = "fp"


def add_batch(batch: DataFrame, batch_id: int, path: str, start: int = START_ID) -> None:
    """batch: the five fields and seq. Writes the new ones under path, as batch_id=<n>, each with its fingerprint,
    so that a later batch reads 32 characters of each old record and hashes none."""
    spark = batch.sparkSession
    old = _stored(spark, path).where(F.col("batch_id") < batch_id)
    row = F.struct(*FIELDS[1:], "seq").alias("row")
    new = deduplicate(batch.select(*FIELDS[1:], "seq")).select(row, record_fingerprint().alias(FP))
    new = new.join(old.select(FP).distinct(), FP, "left_anti").select("row.*", FP)
    last = old.agg(F.coalesce(F.max("id"), F.lit(start - 1)).alias("m")).first()["m"]
    assign_ids(new, start=last + 1).select(*FIELDS, FP).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = T.StructType([*RECORD.fields, T.StructField(FP, T.StringType()), T.StructField("batch_id", T.LongType())])
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches, and batch_id."""
    return _stored(spark, path).drop(FP)


def start(stream: DataFrame, path: str, checkpoint: str, first_id: int = START_ID):
    """Runs what is there and stops; call again for more."""
    return (
        stream.writeStream.foreachBatch(lambda df, n: add_batch(df, n, path, first_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
