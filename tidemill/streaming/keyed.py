"""The cumulative merge as a stream with keyed state: what was seen is a state by fingerprint, not a table that is read again.

Each fingerprint's state is one flag in a RocksDB store, which keeps it on disk and in the checkpoint's change
logs. Python is called once for each group of fingerprints, and the flags are a map by fingerprint within the group: a call
for each fingerprint, with frames of its own, costs many times the work on its row. A micro-batch touches the
states of its own fingerprints only, however long the history is; of each new one the first record by seq goes on. These are numbered after the last id of the manifest and appended to a
store (sources/store.py) under the batch's number, so a batch that is run again after a failure, with the same
states, replaces itself or is skipped. Late records are as welcome as others: there is no watermark, since
history has no end after which a duplicate is new. Null texts count as ''; records without title and text
go. A store that already has records gives the first states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import clean_text
from ..operators.records import FIELDS, START_ID, record_fingerprint
from ..scratch import BATCHES, settings
from ..sources.store import Store, is_store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fingerprints that share so many first hexadecimal digits are one group, as long as a checkpoint lives: 4096 calls a micro-batch at most,
#: each of which holds a 4096th of the micro-batch's first records.
DIGITS = 3
ROW = T.StructType([*[T.StructField(f, T.StringType()) for f in FIELDS[1:]], T.StructField("seq", T.LongType())])


def _firsts(rows: pd.DataFrame) -> pd.DataFrame:
    """The least row of each fingerprint; only those that stand there more than once are sorted."""
    again = rows["fp"].duplicated(keep=False)
    if not again.any():
        return rows
    return pd.concat([rows[~again], rows[again].sort_values([*ROW.names[::-1]], kind="stable").drop_duplicates("fp")])


class _FirstSeen(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "fp string", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            best = _firsts(part if best is None else pd.concat([best, part]))
        if self.seen.exists():
            best = best[[not self.seen.containsKey((fp,)) for fp in best["fp"]]]
        for fp in best["fp"]:
            self.seen.updateValue((fp,), (True,))
        if len(best):
            yield best[ROW.names]

    def handleInitialState(self, key, state: pd.DataFrame, timerValues) -> None:
        for fp in state["fp"]:
            self.seen.updateValue((fp,), (True,))

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame) -> GroupedData:
    return rows.withColumn("digits", F.substring("fp", 1, DIGITS)).groupBy("digits")


def new_records(stream: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Of a stream of records (five fields and a whole-number seq): the first of each fingerprint that neither came before nor is in history (fp)."""
    rows = stream.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in FIELDS[1:]], "seq")
    rows = rows.where((clean_text(F.col("title"), False) != "") | (clean_text(F.col("text"), False) != ""))
    first = None if history is None else _grouped(history.select("fp"))
    return _grouped(rows.select("*", record_fingerprint().alias("fp"))).transformWithStateInPandas(_FirstSeen(), ROW, "append", "none", initialState=first)


def start(stream: DataFrame, path: str, checkpoint: str, first_id: int = START_ID):
    """Adds what is there to the store at path and stops; call again, with the same checkpoint, for more."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    history = Store(spark, path, first_id).keys().select(F.lower(F.hex("fp")).alias("fp")) if is_store(spark, path) else None

    def add(batch: DataFrame, n: int) -> None:
        Store(spark, path, first_id).append(batch, f"stream-{n}")

    with settings(spark, BATCHES):
        return new_records(stream, history).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
