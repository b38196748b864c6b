"""The stream with keyed state: equal to the batch merge, over replays, late and repeated records."""

from pyspark.sql import functions as F

from tidemill.operators.records import merge
from tidemill.sources.store import Store
from tidemill.streaming import keyed

ROW = "title string, text string, time string, source string, url string, seq long"


def put(spark, src, titles, first):
    rows = [(t, "x" if t is not None else None, "", "s", "u", first + i) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(src))


def run(spark, src, out, checkpoint):
    q = keyed.start(spark.readStream.schema(ROW).parquet(str(src)), str(out), str(checkpoint))
    assert q.awaitTermination(180)
    return q


def rows(df):
    return [(r["id"], r["title"]) for r in df.orderBy("id").collect()]


def test_stream_equals_the_merge_and_state_grows_by_new_keys(spark, tmp_path):
    src, out, ckpt, plain, states = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt", None, []
    for i, titles in enumerate((["b", "a", "b", None], ["a", "c"], ["c", "late", "d", "d"])):
        put(spark, src, titles, 10 * i)
        progress = run(spark, src, out, ckpt).lastProgress
        states.append(sum(s["numRowsTotal"] for s in progress["stateOperators"]))
        batch = spark.createDataFrame([(j, t, "x" if t is not None else None, "", "s", "u") for j, t in enumerate(titles)], "id long, title string, text string, time string, source string, url string")
        plain = merge(plain if plain is not None else batch.limit(0), batch).cache()
        assert rows(Store(spark, str(out)).records()) == rows(plain)
    assert states == [2, 3, 5]
    run(spark, src, out, ckpt)  # nothing new
    assert Store(spark, str(out)).manifest()["records"] == 5


def test_a_batch_that_is_run_again_is_added_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    batch = spark.createDataFrame([("a", "x", "", "s", "u", 1), ("b", "x", "", "s", "u", 2)], ROW)
    assert store.append(batch, "stream-0") == 2 and store.append(batch, "stream-0") == 0
    assert rows(store.records()) == [(10001, "a"), (10002, "b")]


def test_a_store_gives_the_first_states(spark, tmp_path):
    store = Store(spark, str(tmp_path / "out"), buckets=4)
    store.merge(spark.createDataFrame([("a", "x", "", "s", "u", 1)], ROW))
    put(spark, tmp_path / "in", ["a", "n"], 5)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ckpt")
    assert rows(store.records()) == [(10001, "a"), (10002, "n")]
    assert store.keys().select(F.count_distinct("fp")).first()[0] == 2


def test_fingerprints_of_a_group_share_a_call_and_keep_states_of_their_own():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.kept = {}

        def getMapState(self, name, key, value):
            return self

        def exists(self):
            return bool(self.kept)

        def containsKey(self, key):
            return key in self.kept

        def updateValue(self, key, value):
            self.kept[key] = value

    seen, state = keyed._FirstSeen(), Handle()
    seen.init(state)
    seen.handleInitialState(("a",), pd.DataFrame({"fp": ["a0"]}), None)
    frame = lambda *rows: pd.DataFrame([{**dict.fromkeys(keyed.ROW.names, "x"), "seq": s, "title": t, "fp": fp} for fp, s, t in rows])
    parts = [frame(("a1", 3, "late"), ("a2", 5, "b"), ("a0", 1, "old")), frame(("a1", 2, "late"), ("a1", 1, "first"), ("a2", 5, "a"))]
    out = pd.concat(seen.handleInputRows(("a",), iter(parts), None))
    assert sorted(zip(out["title"], out["seq"])) == [("a", 5), ("first", 1)]
    assert set(state.kept) == {("a0",), ("a1",), ("a2",)}
    assert not list(seen.handleInputRows(("a",), iter(parts), None))


def test_a_stream_of_few_groups_equals_the_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "DIGITS", 1)
    for i in range(2):
        put(spark, tmp_path / "in", [f"t{(j * 7) % 120}" for j in range(100 * i, 100 * i + 150)], 1000 * i)
        progress = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ckpt").lastProgress
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) == 120
    found = Store(spark, str(tmp_path / "out")).records().orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in found] == [(10001 + j, f"t{(j * 7) % 120}") for j in range(120)]
