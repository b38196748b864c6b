"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows stand in one fixed order: that of a 64-bit hash of doc_id, size and checksum of the text, ties by
these themselves. A row's number r in it, from 0 to N - 1, is permuted by a keyed Feistel network over
the least even number of bits that holds N; what falls on N or beyond is permuted again until it falls
below (cycle walking), which keeps it a permutation of the N numbers. Permuted number p lies in shard
p mod S at slot p div S. So shards differ by at most one row, slots have no gaps, and place and row are
computed from each other (`placed`, `row_at`) without a table. The law that holds is `rows`.

Numbers without one task that sees all rows: equal rows (in doc_id, size and checksum) are counted
before the shuffle, so a row that a third of the table repeats is one row with a count; the hash's first
bits cut the order into ranges of equal expected size; ranges are summed, the sums accumulated in blocks,
and a window inside each range goes on from there. Counts are unfolded at last, long ones block by block.

Reruns agree on any cluster and any split of the input into files. Null text: no bytes (size 16, checksum
0); null doc_id: a value of its own. Rows equal in doc_id, size and checksum are interchangeable. An empty
table gives an empty result; extra columns are ignored by `shard_plan` and kept by `write_shards`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import U64, ahead, materialise, mixed

SHARDS, SEED, ROUNDS = 40, "shard-1", 8
#: Bytes that each row counts besides its text.
ROW_BYTES = 16
#: Bits of the hash that name a row's range, and copies of one row that are numbered at a time.
RANGE_BITS, BLOCK = 12, 1 << 16
KEY = ["doc_id", "size", "text_crc32"]


class Permutation:
    """A keyed permutation of 0 .. n - 1 and its inverse, over arrays of whole numbers."""

    def __init__(self, n: int, seed: str = SEED, rounds: int = ROUNDS) -> None:
        self.n, self.half = n, U64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = U64((1 << int(self.half)) - 1)
        self.keys = [U64(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big")) for i in range(rounds)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        return mixed(x ^ key) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return left << self.half | right

    def _once_back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._round(left, key), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        """Steps until all fall below n; fewer than four steps are expected, since less than four times n are in the network's range."""
        x = np.asarray(x).astype(U64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError(f"numbers below {self.n} can be permuted")
        x = step(x)
        beyond = np.flatnonzero(x >= U64(self.n))
        while len(beyond):
            x[beyond] = step(x[beyond])
            beyond = beyond[x[beyond] >= U64(self.n)]
        return x.astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once_back)


def permuted(row: Column, n: int, seed: str = SEED) -> Column:
    """The permuted number of a row number, of n rows in all."""

    @F.pandas_udf(LongType())
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).of(rows.to_numpy()))

    return run(row)


def placed(row: int, n: int, shards: int = SHARDS, seed: str = SEED) -> tuple[int, int]:
    """Shard and slot of a row number, of n rows in all."""
    p = int(Permutation(n, seed).of(np.array([row]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: str = SEED) -> int:
    """The row number that a place holds."""
    return int(Permutation(n, seed).back(np.array([slot * shards + shard]))[0])


def identity() -> list[Column]:
    """doc_id, size and checksum of a document's row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")]


def numbered(rows: DataFrame, range_bits: int = RANGE_BITS) -> tuple[DataFrame, int]:
    """Each distinct row (KEY) with n, how often it occurs, and start, the number of the first of them; and the number of all rows."""
    groups = materialise(rows.groupBy(*KEY).agg(F.count("*").alias("n")))
    hashed = groups.select("*", F.xxhash64(*KEY).alias("hash")).select("*", F.shiftrightunsigned("hash", 64 - range_bits).alias("range"))
    first = ahead(hashed.groupBy("range").agg(F.sum("n").alias("n")), [], "range")
    inside = Window.partitionBy("range").orderBy("hash", *KEY).rowsBetween(Window.unboundedPreceding, 0)
    upto = hashed.withColumn("upto", F.sum("n").over(inside))
    out = upto.join(first, "range").select(*KEY, "n", (F.col("ahead") + F.col("upto") - F.col("n")).alias("start"))
    return materialise(out), groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def unfolded(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """KEY and row, one row for each number that a group covers; groups of more than `block` are dealt out block by block."""
    to = lambda a, n: F.explode(F.sequence(a, a + n - 1))
    few = groups.where(F.col("n") <= block).select(*KEY, to(F.col("start"), F.col("n")).alias("row"))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long")))
    many = groups.where(F.col("n") > block).select(*KEY, "n", "start", begin.alias("begin")).repartition("start", "begin")
    return few.unionByName(many.select(*KEY, to(F.col("start") + F.col("begin"), F.least(F.lit(block), F.col("n") - F.col("begin"))).alias("row")))


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, range_bits: int = RANGE_BITS) -> DataFrame:
    """Per row: doc_id, size (bytes of its text and 16), text_crc32, law ('rows'), shard, slot, grown_shard (null: no such law), row (its number)."""
    groups, n = numbered(docs.select(*identity()), range_bits)
    rows = unfolded(groups).select("*", permuted(F.col("row"), n, seed).alias("p"))
    return rows.select(
        *KEY, F.lit("rows").alias("law"), F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.call_function("div", F.col("p"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, rows_per_file: int = 100_000, salts: int = 64) -> None:
    """The whole rows as Parquet: path/shard=<k>/, columns slot and row (a struct of docs' columns), each file with consecutive slots in order.

    Rows equal in KEY take their group's numbers in turn; a large group is counted by salts, so that none meets in one task."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    rows = materialise(docs.select(F.struct(*docs.columns).alias("_row"), *identity(), salt.alias("_salt")))  # written, so that the salt stays
    groups, n = numbered(rows.select(*KEY))
    again = rows.groupBy(*KEY, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    begins = again.select(*KEY, "_salt", before.alias("_before")).alias("b").join(groups.alias("g"), _same("b", "g", KEY)).select(*[F.col(f"b.{c}").alias(c) for c in (*KEY, "_salt")], (F.col("start") + F.col("_before")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*KEY, "_salt").orderBy(F.xxhash64("_row"))) - 1
    ranked = rows.withColumn("_at", inside).alias("r").join(begins.alias("b"), _same("r", "b", [*KEY, "_salt"])).select("_row", (F.col("_first") + F.col("_at")).alias("_number"))
    placed_rows = ranked.select("_row", permuted(F.col("_number"), n, seed).alias("_p")).select(
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.call_function("div", F.col("_p"), F.lit(shards)).cast("long").alias("slot"), F.col("_row").alias("row")
    )
    dealt = placed_rows.repartition("shard", F.call_function("div", F.col("slot"), F.lit(rows_per_file))).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equal in these columns, nulls too."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard in their order, with the columns that were written."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot").select("row.*")
