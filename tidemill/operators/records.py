"""The six-field record, first-wins deduplication, dense numbering, and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, fingerprint, kept, normalize_time
from ..scratch import materialise

START_ID = 10001
FIELDS = ("id", "title", "text", "time", "source", "url")
RECORD = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(f, T.StringType()) for f in FIELDS[1:]]])


def raw_fields(df: DataFrame, title: Column, text: Column, source: Column, time: Column | None = None, url: Column | None = None, seq: Column | None = None, entities: bool = True) -> DataFrame:
    """The five fields as they came, and seq, the place in the order of collection."""
    fields = {"title": title, "text": text, "time": F.lit("") if time is None else time.cast("string"), "source": source, "url": F.lit("") if url is None else url}
    return df.select(*[c.alias(n) for n, c in fields.items()], *([] if seq is None else [seq.alias("seq")]))


def cleaned(raw: DataFrame, entities: bool = True) -> DataFrame:
    """Records of raw_fields(): id (null), the five fields cleaned, and seq where there is one."""
    fields = [clean_text(F.col(c), entities).alias(c) if c != "time" else normalize_time(F.col(c)).alias(c) for c in FIELDS[1:]]
    return raw.select(F.lit(None).cast("long").alias("id"), *fields, *[c for c in raw.columns if c not in FIELDS])


def make_record(df: DataFrame, title: Column, text: Column, source: Column, time: Column | None = None, url: Column | None = None, seq: Column | None = None, entities: bool = True) -> DataFrame:
    """id (null), the five fields, and seq, the place in the order of collection."""
    return cleaned(raw_fields(df, title, text, source, time, url, seq), entities)


def with_content(records: DataFrame) -> DataFrame:
    """Records that have a title or a text."""
    return kept(records, lambda r: (r["title"] != "") | (r["text"] != ""))


def record_fingerprint() -> Column:
    return fingerprint(F.col("title"), F.col("text"), F.col("source"), F.col("url"))


def deduplicate(records: DataFrame, order: str = "seq") -> DataFrame:
    """Rows with a title or text, the first by `order` of each fingerprint.

    Each task first keeps its own least row per fingerprint (the plan's partial group limit), so a
    record that a third of all rows repeat costs one row per task in the shuffle. Ties of the order
    are broken by a hash of the row."""
    alive = kept(records, lambda r: (clean_text(r["title"], False) != "") | (clean_text(r["text"], False) != ""))
    row = F.struct(*records.columns).alias("_row")
    keyed = alive.select(row, record_fingerprint().alias("_fp"), F.col(order).alias("_order"), F.xxhash64(*records.columns).alias("_tie"))
    first = F.row_number().over(Window.partitionBy("_fp").orderBy("_order", "_tie"))
    return keyed.withColumn("_n", first).where("_n = 1").select("_row.*")


def assign_ids(records: DataFrame, order: str = "seq", start: int = START_ID, parts: int | None = None) -> DataFrame:
    """Consecutive ids in order, without one task that sees all rows: rows are ranged by the order,
    each range is numbered by itself, and begins where the counts of those before it end.

    The ranges are drawn from a sample, so rows and counts must come from one exchange: the ranged
    rows are written once with the number of their range, and both are read from there. Ties of the
    order go by a hash of the row. Null orders come first; an empty table stays empty."""
    spark = records.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    others = [c for c in records.columns if c != "id"]
    keyed = records.select(F.struct(*others).alias("_row"), F.col(order).alias("_order"), F.xxhash64(*others).alias("_tie"))
    ranged = keyed.repartitionByRange(n, "_order", "_tie").sortWithinPartitions("_order", "_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(ranged.select("_row", F.shiftrightunsigned("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_within")))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range, however many records there are
    ahead = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    number = (F.col("_ahead") + F.col("_within") + start).cast("long").alias("id")
    return placed.join(F.broadcast(ahead), "_range").select("_row.*", number)


def merge(history: DataFrame, batch: DataFrame, start: int = START_ID, reset: bool = False) -> DataFrame:
    """The cumulative snapshot: history before batch, first wins, all renumbered; with reset the batch alone."""
    ordered = [batch.select(*FIELDS[1:], F.struct(F.lit(1).alias("era"), F.col("id").alias("at")).alias("seq"))]
    if not reset:
        ordered.insert(0, history.select(*FIELDS[1:], F.struct(F.lit(0).alias("era"), F.col("id").alias("at")).alias("seq")))
    rows = ordered[0] if len(ordered) == 1 else ordered[0].unionByName(ordered[1])
    return assign_ids(deduplicate(rows), start=start).select(*FIELDS)


def append_new(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Only the batch's new records, numbered after the history: what merge() adds when history is dense and distinct."""
    seen = history.select(record_fingerprint().alias("_fp")).distinct()
    new = batch.select(F.struct(*batch.columns).alias("_row"), record_fingerprint().alias("_fp")).join(seen, "_fp", "left_anti").select("_row.*")
    last = history.agg(F.coalesce(F.max("id"), F.lit(START_ID - 1)).alias("m")).first()["m"]
    return assign_ids(deduplicate(new.withColumn("seq", F.col("id"))).select(*FIELDS[1:], "seq"), start=last + 1).select(*FIELDS)
