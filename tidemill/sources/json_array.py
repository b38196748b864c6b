"""A splittable reader of JSON arrays of objects, however long the file and whether or not it has line breaks.

The text source splits a file on any store at a separator of our choice, here the closing brace, which
ends every object. What a byte range means depends on what stands before it, so it is read twice:

1. each range tells whether it has an odd number of quotes (then a string is open behind it if none
   was before it) and how the depth changes over it, for either state in which it may begin. That is one
   row a range, 8 a GB with ranges of 128 MB; the driver adds them up to the state each range begins in;
2. with its state each range finds its objects at depth one. An object that goes over a range's end is
   put together from its pieces.

A file counts only as a whole: it must be an array, closed at its end, of objects that are JSON, with
one comma fewer than objects and nothing else between them. Otherwise it is broken and gives no rows.
An object must fit a task's memory, the file need not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import BATCHES, materialise, settings

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, begin (of the byte range), value, size (of the file): texts between closing braces, in the order of the file within each range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value", F.col("_metadata.file_size").alias("size"))


def _bytes(values: pa.Array) -> np.ndarray:
    """The fragments with a closing brace behind each. The last of a file that is an array has none in truth: the depth falls to -1 there."""
    joined = pc.binary_join(pa.array([[*values.cast(pa.large_binary()).to_pylist(), b""]], pa.large_list(pa.large_binary())), pa.scalar(b"}", pa.large_binary()))
    return np.frombuffer(joined[0].as_buffer(), np.uint8)


def _quotes(b: np.ndarray) -> np.ndarray:
    """Where quotes stand that no backslash escapes. A range never begins behind a backslash: no escape has a brace."""
    at = np.flatnonzero(b == 0x22)
    plain = np.flatnonzero(b != 0x5C)
    before = np.searchsorted(plain, at) - 1  # the last character before each quote that is no backslash
    run = at - 1 - np.where(before >= 0, plain[before], -1)
    return at[run % 2 == 0]


class _Part:
    """Some consecutive fragments of a range, if they begin in this state."""

    def __init__(self, values: pa.Array, quotes: int, depth: int) -> None:
        self.b = _bytes(values)
        at = _quotes(self.b)
        mark = np.zeros(len(self.b), np.int8)
        mark[at] = 1
        self.quotes = quotes + len(at)
        self.outside = (np.cumsum(mark) + quotes) % 2 == 0
        self.step = np.where((self.b == 0x7B) | (self.b == 0x5B), 1, 0) - np.where((self.b == 0x7D) | (self.b == 0x5D), 1, 0)
        self.depth = depth + np.cumsum(np.where(self.outside, self.step, 0))

    def change(self, outside: bool) -> int:
        return int(self.step[self.outside == outside].sum())

    def objects(self) -> tuple[np.ndarray, np.ndarray]:
        """Where objects at depth one begin and end."""
        begin = np.flatnonzero((self.b == 0x7B) & self.outside & (self.depth == 2))
        return begin, np.flatnonzero((self.b == 0x7D) & self.outside & (self.depth == 1))

    def between(self) -> np.ndarray:
        """COUNTS of what stands outside of objects."""
        b, first = self.b, self.outside & (self.depth == 1)
        none, comma = self.outside & (self.depth == 0) & ~BLANK[b], first & (b == 0x2C)
        opened, closed = first & (b == 0x5B) & (self.step == 1), none & (b == 0x5D)
        other = (first & ~BLANK[b] & ~comma & ~opened & ~(b == 0x7D)) | (none & ~closed)
        behind = self.outside & (self.depth < 0) & ~BLANK[b]
        return np.array([x.sum() for x in (other, opened, closed, behind, comma, self.objects()[0] >= 0)], np.int64)


#: Characters that have no place there, openings and closings of the array, what stands behind it (the last, added brace), commas, objects.
COUNTS = ("other", "opened", "closed", "behind", "commas", "objects")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, int]]:
    """The parts of batches that belong to one range each, and the file's size."""
    for batch in batches:
        if not len(batch):
            continue
        begin, file = batch.column(1).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(begin) != 0) | (np.diff(file) != 0)) + 1).tolist(), len(begin)]
        for a, b in zip(cut[:-1], cut[1:]):
            yield (batch.column(0)[a].as_py(), int(begin[a])), batch.column(2).slice(a, b - a), batch.column(3)[a].as_py()


_SUMMARY = "file string, begin long, quotes long, outside long, inside long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: the unescaped quotes, and the change of depth if it begins outside or inside of a string."""
    found: dict[tuple[str, int], list[int]] = {}
    for key, values, _ in _ranges(batches):
        sums = found.setdefault(key, [0, 0, 0])
        part = _Part(values, sums[0], 0)
        sums[0], sums[1], sums[2] = part.quotes, sums[1] + part.change(True), sums[2] + part.change(False)
    rows = [[*k, *v] for k, v in found.items()]
    columns = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(5)]
    yield pa.RecordBatch.from_arrays(columns, names=["file", "begin", "quotes", "outside", "inside"])


def _states(rows: list) -> dict[tuple[str, int], tuple[int, int]]:
    """Of each range: quotes before it (modulo 2), and the depth it begins at."""
    out, at, quotes, depth = {}, None, 0, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["begin"])):
        if r["file"] != at:
            at, quotes, depth = r["file"], 0, 0
        out[r["file"], r["begin"]] = quotes, depth
        quotes, depth = (quotes + r["quotes"]) % 2, depth + (r["inside"] if quotes else r["outside"])
    return out


WHOLE, TAIL, MIDDLE, HEAD, END = range(5)
_PIECES = "file string, begin long, at long, kind int, value binary, counts array<long>"
_PIECES_ARROW = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("value", pa.binary()), ("counts", pa.list_(pa.int64()))])


def _pieces(states: dict[tuple[str, int], tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range its whole objects, the ends of objects that go over its borders, and at last what stands between (END)."""
        key, quotes, depth, at, held, began, counts, length = None, 0, 0, 0, [], False, None, 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([f[i] for f in found], t.type) for i, t in enumerate(_PIECES_ARROW)]
            return pa.RecordBatch.from_arrays(columns, schema=_PIECES_ARROW)

        def over() -> pa.RecordBatch:
            last = [(*key, at, TAIL if began else MIDDLE, b"".join(held), None)] if held else []
            return rows([*last, (*key, at, END, None, [*counts.tolist(), quotes % 2, length])])

        for now, values, size in _ranges(batches):
            if now != key:
                if key is not None:
                    yield over()
                key, (quotes, depth) = now, states[now]
                at, began, counts, held = 0, False, np.zeros(len(COUNTS), np.int64), [b""] if depth >= 2 else []
                length = -size if now[1] == 0 else 0  # of what was read, less the file's
            part = _Part(values, quotes, depth)
            begin, end = part.objects()
            found = []
            if held:  # an object is open
                stop = int(end[0]) + 1 if len(end) else len(part.b)
                held.append(part.b[:stop].tobytes())
                if len(end):
                    found.append((*key, at, WHOLE if began else HEAD, b"".join(held), None))
                    held, end, at = [], end[1:], at + 1
            for a, b in zip(begin.tolist(), end.tolist()):
                found.append((*key, at, WHOLE, part.b[a : b + 1].tobytes(), None))
                at += 1
            if len(begin) > len(end):
                held, began = [part.b[int(begin[-1]) :].tobytes()], True
            counts += part.between()
            length += len(part.b)
            quotes, depth = part.quotes, int(part.depth[-1])
            if found:
                yield rows(found)
        if key is not None:
            yield over()

    return run


def array_objects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The objects of the arrays at path (a file or a folder of them): file, begin, at (their order), value (JSON);
    and the files: file, whole (whether it is an array of objects to its end)."""
    fragments = _fragments(spark, path)
    with settings(spark, BATCHES):
        states = _states(fragments.mapInArrow(_summaries, _SUMMARY).collect())
    found = materialise(fragments.mapInArrow(_pieces(states), _PIECES))
    order = Window.partitionBy("file").orderBy("begin", "at").rowsBetween(Window.unboundedPreceding, 0)  # at most two pieces of each range
    opened = F.last(F.when(F.col("kind") == TAIL, F.struct("begin", "at")), ignorenulls=True).over(order)
    crossing = found.where(F.col("kind").isin(TAIL, MIDDLE, HEAD)).withColumn("object", opened)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("begin", F.hex("value").alias("hex")))), lambda p: p["hex"])
    joined = crossing.groupBy("file", "object").agg(F.unhex(F.array_join(pieces, "")).alias("value"))
    objects = found.where(F.col("kind") == WHOLE).select("file", "begin", "at", "value").unionByName(joined.select("file", "object.begin", "object.at", "value"))
    objects = objects.select("file", "begin", "at", F.col("value").cast("string").alias("value"))
    ends = found.where(F.col("kind") == END)
    sums = {c: F.sum(F.col("counts")[i]) for i, c in enumerate(COUNTS)}
    closed = (sums["other"] == 0) & (sums["opened"] == 1) & (sums["closed"] == 1) & (sums["behind"] == 1) & (sums["commas"] == F.greatest(sums["objects"] - 1, F.lit(0)))
    ended = (F.max_by(F.col("counts")[len(COUNTS)], "begin") == 0) & (F.sum(F.col("counts")[len(COUNTS) + 1]) == 1)  # no string is open, and one brace was added
    files = ends.groupBy("file").agg((closed & ended).alias("closed"))
    bad = objects.where(~F.is_valid_utf8("value") | F.try_parse_json("value").isNull()).select("file").distinct().withColumn("bad", F.lit(True))
    return objects, files.join(bad, "file", "left").select("file", (F.col("closed") & F.col("bad").isNull()).alias("whole"))
