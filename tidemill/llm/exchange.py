"""Arrays that travel between tasks by bucket.

A task packs the rows it has found into one byte string per bucket (a few hundred
rows instead of millions), and the reducing task takes one bucket at a time. Rows
are numpy records; a bucket's records are concatenated in arrival order. They travel
byte by byte of the record, all first bytes first, so that what they share packs well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

LEAST_BUCKETS = 512


def bucket_count(df: DataFrame) -> int:
    """Twice the shuffle partitions, so that a bucket's share falls as a cluster is given more of them."""
    return max(LEAST_BUCKETS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


SCHEMA = "bucket int, kind int, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(records: np.ndarray) -> bytes:
    plain = np.ascontiguousarray(records).view(np.uint8).reshape(len(records), records.dtype.itemsize).T.tobytes()
    return len(records).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True)


def unpacked(data, dtype: np.dtype) -> np.ndarray:
    """What packed() was given; data: bytes or an Arrow buffer."""
    n = int.from_bytes(bytes(data[:8]), "little")
    plain = _ZSTD.decompress(data[8:], n * dtype.itemsize, asbytes=True)
    return np.frombuffer(plain, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)


def dealt(records: np.ndarray, key: np.ndarray, buckets: int, kind: int) -> pa.RecordBatch:
    """One row per bucket that has records; key: 64-bit hashes by which they are dealt."""
    to = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.array([0])
    data = [packed(records[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(to[cut[:-1]] if len(to) else [], pa.int32()), pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=_ARROW
    )


def reduced(sent: DataFrame, dtypes: dict[int, np.dtype], reduce: Callable[[dict[int, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """reduce() of each bucket's records by kind."""
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches):
        at, held = None, {k: [] for k in dtypes}

        def flush():
            got = {k: np.concatenate([np.zeros(0, dtypes[k]), *[unpacked(x, dtypes[k]) for x in v]]) for k, v in held.items()}
            for v in held.values():
                v.clear()
            yield from reduce(got)

        for batch in batches:
            for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != at and at is not None:
                    yield from flush()
                at = bucket
                held[kind].append(data.as_buffer())
        if at is not None:
            yield from flush()

    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), schema)


def by_group(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(group value, the columns' parts) for each value of group."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.array([0])
    columns = [c[order] for c in columns]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield (int(group[a]), *[c[a:b] for c in columns])
