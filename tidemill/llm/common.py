"""What several operators share: scratch tables, text chunks as byte arrays, rolling hashes.

Hashes are polynomials modulo 2**64 over random 64-bit codes of bytes or words,
read off prefix sums, so that any window's hash costs two lookups. They are
finished with an avalanche step. Where a decision rests on equality alone, two
independent hashes (128 bits) are used.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise, scratch_dir  # noqa: F401

U64 = np.uint64
CHUNK_BYTES = 1 << 19
"""Bytes of text that are hashed at a time; a longer text is a chunk by itself."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ahead(counts: DataFrame, keys: list[str], place: str, n: str = "n", per: int = 64) -> DataFrame:
    """keys, place (whole numbers), and `ahead`: the sum of n over the smaller places of the same keys.

    In two steps, places in blocks of `per` and blocks within keys, so that one key's counts do not meet in one task."""
    counts = counts.select(*keys, place, n, F.expr(f"{place} div {per}").alias("_block"))
    inside = Window.partitionBy(*keys, "_block").orderBy(place)
    blocks = counts.groupBy(*keys, "_block").agg(F.sum(n).alias("_sum"))
    before = blocks.select(*keys, "_block", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_sum")).alias("_before"))
    within = counts.withColumn("_within", F.sum(n).over(inside) - F.col(n)).alias("w")
    same = F.col("w._block") == F.col("b._block")
    for k in keys:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}"))
    return within.join(before.alias("b"), same).select(*[F.col(f"w.{k}").alias(k) for k in keys], F.col(f"w.{place}").alias(place), (F.col("_within") + F.col("_before")).alias("ahead"))


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def tidy(run: Callable) -> Callable:
    """run, which then gives freed memory back to the system, so that a worker that waits for its next task holds little."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return tidied


# ---------------------------------------------------------------- hashing

def _codes(seed: int, n: int) -> np.ndarray:
    """n random odd 64-bit codes, the same on every machine (splitmix64)."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche step of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Roller:
    """Hashes of windows over a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        base = int(_codes(seed + 77, 1)[0]) | 5
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def __reduce__(self):
        return roller, (self.seed,)  # in each process one per seed, with its tables of powers

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, self.base)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, self.inverse)]), dtype=U64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums; of(sums, a, b) then hashes codes[a:b]."""
        self._grow(len(codes) + 1)
        out = np.empty(len(codes) + 1, U64)
        out[0] = 0
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((sums[b] - sums[a]) * self.down[a] + U64(0x632BE59BD9B4E019))


@functools.cache
def roller(seed: int) -> Roller:
    return Roller(seed)


BYTE_CODES = (_codes(11, 256), _codes(12, 256))
BYTE_ROLLERS = (roller(21), roller(22))
WORD_ROLLERS = (roller(31), roller(32))

#: The white space of the word rule, and the lower-casing of A-Z, by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk:
    """Some whole texts as one byte array. rows: their numbers in the batch; at: where each begins, and the end."""

    def __init__(self, rows: range, data: np.ndarray, at: np.ndarray) -> None:
        self.rows, self.data, self.at = rows, data, at

    def words(self, lower: bool = False) -> "Words":
        return Words(self, lower)


class Words:
    """The words of a chunk: begin, end (in bytes), code (64 bits), and at: where each text's words begin, and the end."""

    def __init__(self, chunk: Chunk, lower: bool) -> None:
        data = LOWER[chunk.data] if lower else chunk.data
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[chunk.at] = True
        first = word.copy()
        first[1:] &= SPACE[data[:-1]] | edge[1:-1]
        last = word.copy()
        last[:-1] &= SPACE[data[1:]] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.begin, chunk.at)
        sums = BYTE_ROLLERS[0].sums(BYTE_CODES[0][data])
        self.code = BYTE_ROLLERS[0].of(sums, self.begin, self.end)
        self.sizes = np.diff(self.at)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text in the chunk."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts as byte arrays, in order; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield Chunk(range(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def windows(sizes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given sizes that begin at `at`: the begin of each window of k, and the number of its run."""
    n = np.maximum(sizes - k + 1, 0)
    run = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[: len(n)], n)
    return begin, run


def covered(begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [b, b+k) for sorted b, as begins and ends of maximal runs."""
    if not len(begin):
        return begin, begin
    cut = np.flatnonzero(np.diff(begin) > k)
    return begin[np.concatenate([[0], cut + 1])], begin[np.concatenate([cut, [len(begin) - 1]])] + k


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
