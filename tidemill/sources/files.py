"""History in, snapshots out: a guarded JSON-array reader, and JSON, JSON Lines and CSV writers.

Snapshots are written to a new folder and moved into place; the old one stays beside it until then, and
read_snapshot() finds it after a crash between the two moves. Single-file artefacts are written in parts by
tasks and joined byte by byte."""

from __future__ import annotations

import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import FIELDS, RECORD
from ..scratch import aside, move_into_place
from ..scratch import exists as _exists
from .json_array import array_objects
from .store import Store, is_store


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array (or of a folder of them) that any number of tasks read, with seq, their order, and line, the object's JSON.

    A file that is no array of objects to its end gives none. Null texts become ''."""
    objects, found = array_objects(spark, path)
    whole = objects.join(F.broadcast(found.where("whole").select("file")), "file", "left_semi")  # dealt by file, all objects of one would meet in a task
    rows = whole.select(F.from_json("value", RECORD).alias("r"), F.struct("file", "begin", "at").alias("seq"), F.col("value").alias("line"))
    return rows.select("r.id", *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in FIELDS[1:]], "seq", "line")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array; none if the file is missing, broken, or not an array. Null texts become ''."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RECORD)
    return array_records(spark, path).select(*FIELDS)


def batch_name(prefix: str, at: datetime) -> str:
    """What the artefacts of a run that began then are called, without their ending."""
    return f"{prefix}_{at:%Y%m%d_%H%M%S}"


def write_table(records: DataFrame, path: str, batch_id: str) -> None:
    """Adds a batch to the table of batches; the same batch again replaces itself."""
    records.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def replace(records: DataFrame, path: str) -> None:
    """Overwrites a snapshot that `records` may itself read: written beside it, then renamed.

    At every moment the new or the old snapshot is whole, at `path` or beside it."""
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    records.write.parquet(fresh)
    move_into_place(records.sparkSession, fresh, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot at path (a table, or a store that grows), the one set aside where a crash left none there, or no records."""
    for p in (path, aside(path)):
        if is_store(spark, p):
            return Store(spark, p).records()
        if _exists(spark, p):
            return spark.read.schema(RECORD).parquet(p)
    return spark.createDataFrame([], RECORD)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.select(*FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; lines that are no objects are left out (broken_lines() has them), null texts become ''."""
    rows = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)
    return rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in FIELDS[1:]])


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: the lines of a file or folder of JSON lines that are no objects. Blank lines are no lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("line")), F.lit(""))
    return lines.where((F.trim("line") != "") & ~kind.startswith("OBJECT"))


CSV = {"escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\r\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(records: DataFrame, path: str) -> None:
    records.select(*FIELDS).write.mode("overwrite").options(header=True, **CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RECORD).options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in FIELDS[1:]])


def _literal(c: str) -> Column:
    """A column as JSON text."""
    if c == "id":
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))
    made = F.to_json(F.struct(F.col(c).alias("x")))
    return F.when(F.col(c).isNull(), "null").otherwise(F.substring(made, F.lit(6), F.length(made) - 6))


def _object(begin: str, between: str, end: str) -> Column:
    parts = [F.concat(F.lit((begin if i == 0 else between) + f'"{c}": '), _literal(c)) for i, c in enumerate(FIELDS)]
    return F.concat(*parts, F.lit(end))


def _quoted(c: str) -> Column:
    """A column as a CSV field, in quotes where it needs them. (The CSV source would also change line breaks within a text.)"""
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


_HEADER = ("\ufeff" + ",".join(FIELDS) + "\r\n").encode()
#: Of each single-file artefact: a record's text, what stands behind each, and the file's head and end. The last record's separator is cut off.
_FORMS = {
    "csv": (lambda: F.concat_ws(",", *map(_quoted, FIELDS)), "\r\n", _HEADER, b"\r\n"),
    "json": (lambda: _object("  {\n    ", ",\n    ", "\n  }"), ",\n", b"[\n", b"\n]"),
    "jsonl": (lambda: _object("{", ", ", "}"), "\n", b"", b"\n"),
}


def export(records: DataFrame, prefix: str, kinds=("json", "jsonl", "csv"), order: str = "id") -> list[str | Path]:
    """Single files, on any store (their names; those of local ones as paths): an indented JSON array, JSON lines, and CSV with a byte order mark.

    Tasks write ranges of the order side by side and commit them; then the driver's JVM joins these bytes, 8 kB at a time,
    in a file beside the target, which takes the target's place at last. A run that dies leaves the old file whole."""
    out, rows = [], records.select(*FIELDS).orderBy(order)
    for kind in kinds:
        target, parts = f"{prefix}.{kind}", f"{prefix}.{kind}.{uuid.uuid4().hex}.parts"
        text, between, head, end = _FORMS[kind]
        rows.select(text().alias("value")).write.option("lineSep", between).text(parts)
        _join(records.sparkSession, parts, target, head, end, len(between))
        out.append(target if "://" in target else Path(target))
    return out


def _join(spark: SparkSession, parts: str, target: str, head: bytes, end: bytes, cut: int) -> None:
    """head, the part files in order without the last one's last `cut` bytes, and end, as one file; of no parts [] or the head."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, here, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (parts, target, f"{target}.{uuid.uuid4().hex}.new"))
    fs = here.getFileSystem(conf)
    found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
    if not found:
        head, end = (b"[", b"]") if end == b"\n]" else (head, b"")
    fs.setWriteChecksum(False)
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(head))
        for i, (name, n) in enumerate(found):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(part, stream, 0, n - (cut if i == len(found) - 1 else 0))
            finally:
                part.close()
        stream.write(bytearray(end))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.getFileSystem(conf).getUri(), conf)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(here), how)
    fs.delete(folder, True)
