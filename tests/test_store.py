"""The snapshot that grows: equal to the plain merge, old files untouched, keys not shuffled, runs that die."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators.records import FIELDS, merge
from tidemill.sources import files
from tidemill.sources.store import Store, is_store, restart

ROW = "id long, title string, text string, time string, source string, url string"


def batch(spark, titles):
    return spark.createDataFrame([(i, t, "x" if t is not None else None, "", "s", "u") for i, t in enumerate(titles)], ROW)


def ordered(df):
    return df.withColumn("seq", F.col("id"))


def rows(df):
    return [(r["id"], r["title"]) for r in df.orderBy("id").collect()]


def contents(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith((".parquet", ".json"))}


def test_merges_equal_the_plain_merge_and_rewrite_nothing(spark, tmp_path):
    store, plain = Store(spark, str(tmp_path / "s"), buckets=6), None
    old = {}
    for titles in (["a", "b", "a", ""], ["b", "c", None], [], ["c", "d", "a", "d"]):
        b = batch(spark, titles)
        plain = merge(plain if plain is not None else spark.createDataFrame([], ROW), b).cache()
        store.merge(ordered(b))
        assert rows(store.records()) == rows(plain) and store.manifest()["records"] == plain.count()
        now = contents(tmp_path / "s")
        assert all(now[k] == v for k, v in old.items())
        old = now
    assert rows(files.read_snapshot(spark, str(tmp_path / "s"))) == rows(plain)
    assert Store(spark, str(tmp_path / "s")).buckets == 6 and store.manifest()["last_id"] == 10000 + plain.count()


def test_keys_are_read_by_bucket_and_not_shuffled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.merge(ordered(batch(spark, [f"t{i}" for i in range(200)])))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store._new(ordered(batch(spark, ["t1", "new"])))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = plan[plan.index("LeftAnti") :]
    scan = keys[keys.rindex("FileScan") :]
    assert "SelectedBucketsCount: 8 out of 8" in scan and "title" not in scan
    side = keys[keys.rindex("Sort") if "Sort" in keys[keys.rindex("Exchange") :] else 0 :]
    assert "Exchange" not in side


def test_what_a_dead_run_left_does_not_count(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.merge(ordered(batch(spark, ["a"])))

    def dies(found):
        raise OSError("killed")

    monkeypatch.setattr(store, "_commit", dies)
    with pytest.raises(OSError):
        store.merge(ordered(batch(spark, ["lost", "b"])))
    assert rows(store.records()) == [(10001, "a")]
    again = Store(spark, str(tmp_path / "s"))
    again.merge(ordered(batch(spark, ["b", "lost"])))
    assert rows(again.records()) == [(10001, "a"), (10002, "b"), (10003, "lost")]
    late = Store(spark, str(tmp_path / "s"))
    monkeypatch.setattr(late, "manifest", lambda: {"version": 1, "records": 1, "last_id": 10001, "buckets": 4})
    with pytest.raises(RuntimeError):
        late._commit({"version": 2, "records": 9, "last_id": 9, "buckets": 4})


def test_restart_replaces_a_table_or_a_store(spark, tmp_path):
    path = str(tmp_path / "s")
    files.replace(batch(spark, ["old"]), path)
    assert not is_store(spark, path)
    restart(spark, path, ordered(batch(spark, ["x", "y"])), start=5)
    assert is_store(spark, path) and rows(files.read_snapshot(spark, path)) == [(5, "x"), (6, "y")] and list(FIELDS) == files.read_snapshot(spark, path).columns
    restart(spark, path, ordered(batch(spark, [])), start=5)
    assert rows(files.read_snapshot(spark, path)) == []
