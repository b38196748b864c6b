"""Audit of a snapshot: counts, required fields, source families, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists as _exists
from ..sources.json_array import array_objects
from ..sources.store import Store, is_store
from .records import FIELDS, RECORD

UNKNOWN = "未知"


def source_families(records: DataFrame, order: str = "id", top: int = 20) -> DataFrame:
    """The most common sources up to their first '-', ties by first appearance."""
    family = F.split_part(F.coalesce(F.nullif("source", F.lit("")), F.lit(UNKNOWN)), F.lit("-"), F.lit(1))
    counted = records.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(top)


def has_fields(line: Column, fields=FIELDS) -> Column:
    """Whether a JSON object has every required key."""
    missing = F.array_except(F.array(*map(F.lit, fields)), F.json_object_keys(line))  # the keys stand in no lambda, which would read them once for each field
    return F.coalesce(F.size(missing) == 0, F.lit(False))


def head(records: DataFrame, n: int = 3, order: str = "id") -> DataFrame:
    return records.orderBy(order).limit(n)


def summary(records: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row: records, and how many are new against history."""
    out = records.agg(F.count("*").alias("records"))
    return out if history is None else out.crossJoin(history.agg(F.count("*").alias("history")))


def _form(spark: SparkSession, path: str) -> str:
    """What a run's artefact is: table (Parquet), array or lines (JSON), by its files' names or their first character."""
    jvm = spark._jvm.org.apache.hadoop.fs
    here = jvm.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    names, folders = [], [here]
    if fs.getFileStatus(here).isDirectory():
        while folders and not names:
            for s in fs.listStatus(folders.pop(0)):
                if s.isDirectory():
                    folders.append(s.getPath())
                elif s.getLen() and not s.getPath().getName().startswith(("_", ".")):
                    names.append(s.getPath())
    else:
        names = [here]
    if any(p.getName().endswith(".parquet") for p in names) or not names:
        return "table"
    stream = fs.open(names[0])
    try:
        first = stream.read()
        while first in (0x20, 0x09, 0x0A, 0x0D):
            first = stream.read()
    finally:
        stream.close()
    return {0x5B: "array", 0x7B: "lines"}.get(first, "other")


def _counted(objects: DataFrame, fields) -> tuple[int, bool]:
    """How many there are, and whether each has the fields: one pass by all tasks. (To look for the first that lacks one starts with a single task.)"""
    n, lacking = objects.agg(F.count("*"), F.count_if(~has_fields(F.col("value"), fields))).first()
    return n, not lacking


def report(spark: SparkSession, path: str, fields=FIELDS, top: int = 20, first: int = 3) -> dict[str, object]:
    """What an audit says of any artefact of a run: the JSON array, JSON lines (a file or a folder), the table of the snapshot or of batches.

    A missing one is an error (FileNotFoundError), and so is one that is none of these, or an array that is broken (ValueError).
    Rows stand in the order of the file, those of tables in that of their ids."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path}: no snapshot; collect first")
    form, order = "table" if is_store(spark, path) else _form(spark, path), "id"
    if form == "table":
        rows = Store(spark, path).records() if is_store(spark, path) else spark.read.parquet(path)
        complete = set(fields) <= set(rows.columns)
        records = rows.count()
    elif form == "array":
        objects, files = array_objects(spark, path)
        if files.where("NOT whole").take(1):
            raise ValueError(f"{path}: no array of records to its end")
        order = "seq"
        rows = objects.select(F.from_json("value", RECORD).alias("r"), F.struct("file", "begin", "at").alias("seq"), "value").select("r.*", "seq", "value")
        records, complete = _counted(objects, fields)
    elif form == "lines":
        lines = spark.read.text(path).where("trim(value) <> ''")
        rows = lines.select(F.from_json("value", RECORD).alias("r"), F.monotonically_increasing_id().alias("seq")).select("r.*", "seq")
        order = "seq"
        records, complete = _counted(lines, fields)
    else:
        raise ValueError(f"{path}: neither a table nor JSON records")
    return {"records": records, "complete": complete, "families": source_families(rows, order, top), "head": head(rows, first, order).select(*[c for c in FIELDS if c in rows.columns])}
