"""Shards against a plain permutation: counts, slots, reruns, copies, and the written files."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import sharding

DOCS = "doc_id long, text string, row long, shard string, n long"


def rows_of(n):
    texts = [None, "", "é中😀", "\x00", "long " * 200_000] + [f"text {i % 50}" for i in range(n)]
    rows = [(i // 2 if i % 7 else None, t, i, "x", i) for i, t in enumerate(texts)]
    return rows + [(5, "hot", 0, "", 0)] * (n // 2)


def digest(r):
    b = (r[1] or "").encode()
    return r[0], len(b) + 16, zlib.crc32(b)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    p = sharding.Permutation(n)
    x = np.arange(n)
    y = p.of(x)
    assert sorted(y.tolist()) == x.tolist() and p.back(y).tolist() == x.tolist()
    assert n < 100 or (np.mean(np.abs(y - x)) > n / 5 and p.of(x).tolist() != sharding.Permutation(n, "other").of(x).tolist())
    assert all(sharding.row_at(*sharding.placed(r, n, 3), n, 3) == r for r in range(min(n, 20)))
    with pytest.raises(ValueError):
        p.of(np.array([n]))


def test_plan_is_even_gapless_and_computable(spark):
    rows = rows_of(400)
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_plan(docs.repartition(5), shards=7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(map(digest, rows))
    assert sorted(r["row"] for r in got) == list(range(len(rows)))
    each = Counter(r["shard"] for r in got)
    assert len(each) == 7 and max(each.values()) - min(each.values()) <= 1
    for k in each:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(each[k]))
    assert all(sharding.placed(r["row"], len(rows), 7) == (r["shard"], r["slot"]) for r in got)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    again = sharding.shard_plan(docs.repartition(2).orderBy("text"), shards=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    hot = [r["shard"] for r in got if r["size"] == 19 and r["doc_id"] == 5]
    assert len(hot) == 200 and max(Counter(hot).values()) < 60


def test_large_groups_unfold_in_blocks(spark):
    groups = spark.createDataFrame([(1, 20, 3, 25, 0), (2, 20, 3, 1, 25), (None, 20, 3, 10, 26)], "doc_id long, size long, text_crc32 long, n long, start long")
    got = sharding.unfolded(groups, block=10).collect()
    assert sorted(r["row"] for r in got) == list(range(36)) and {r["row"] for r in got if r["doc_id"] == 1} == set(range(25))


def test_empty_and_single(spark):
    docs = spark.createDataFrame(rows_of(1), DOCS)
    assert sharding.shard_plan(docs.limit(0)).count() == 0
    one = sharding.shard_plan(docs.where("text = ''")).collect()
    assert [(r["slot"], r["row"], r["size"]) for r in one] == [(0, 0, 16)]


def test_written_shards_hold_whole_rows_in_order(spark, tmp_path):
    rows = rows_of(60)
    docs = spark.createDataFrame(rows, DOCS)
    sharding.write_shards(docs.repartition(4), str(tmp_path / "a"), shards=3, rows_per_file=10)
    parts = [sharding.read_shard(spark, str(tmp_path / "a"), k).collect() for k in range(3)]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for p in parts for r in p), key=key) == sorted(rows, key=key)
    plan = {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard_plan(docs, shards=3).collect()}
    assert all(digest(r) == plan[k, i] for k, p in enumerate(parts) for i, r in enumerate(p))
