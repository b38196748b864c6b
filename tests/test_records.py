"""Deduplication, numbering, merging, control rules, files, replay and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import audit, control
from tidemill.operators import records as R
from tidemill.sources import files, payloads, replay
from tidemill.streaming import snapshot

ROWS = [(3, "t", "x", "", "s", "u"), (1, "t", "x", "", "s", "u"), (2, "", " ", "", "s", "u"), (4, None, "only text", None, "s", None), (5, "t", "x", "later", "s", "u")]
SCHEMA = "seq long, title string, text string, time string, source string, url string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_wins_and_empty_rows_go(spark):
    got = R.deduplicate(frame(spark))
    assert sorted(r["seq"] for r in got.collect()) == [1, 4]
    assert sorted(r["seq"] for r in R.deduplicate(got).collect()) == [1, 4]


def test_ids_are_dense_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq"), F.lit("x").alias("title")).repartition(7)
    got = {r["seq"]: r["id"] for r in R.assign_ids(df).collect()}
    assert got == {i: 10001 + i for i in range(1000)}


@pytest.mark.parametrize("parts", [8, 200])
def test_ids_of_many_wide_rows_are_dense_when_written(spark, tmp_path, parts):
    n = 500_000
    wide = F.repeat(F.md5(F.col("id").cast("string")), 3).alias("title")
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("seq"), wide).repartition(13)
    R.assign_ids(df, parts=parts).write.parquet(str(tmp_path / "ids"))
    got = spark.read.parquet(str(tmp_path / "ids"))
    assert got.count() == n and got.where(F.col("id") != F.col("seq") + 10001).count() == 0


def test_history_survives_a_crash_between_two_renames(spark, tmp_path):
    path = str(tmp_path / "table")
    files.replace(spark.createDataFrame([(1, "a", "", "", "", "")], R.RECORD), path)
    (tmp_path / "table").rename(tmp_path / "table.previous")
    assert files.read_snapshot(spark, path).count() == 1
    files.replace(files.read_snapshot(spark, path).unionByName(spark.createDataFrame([(2, "b", "", "", "", "")], R.RECORD)), path)
    assert files.read_snapshot(spark, path).count() == 2 and not (tmp_path / "table.previous").exists()


def test_repeated_rows_count_once(spark):
    rows = [(1, "t", "x", "", "s", "u")] * 50 + [(1, "t", "x", "other time", "s", "u")] * 50
    assert R.deduplicate(frame(spark, rows).repartition(5)).count() == 1


def test_ids_of_ties_and_of_nothing(spark):
    got = R.assign_ids(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "seq long, title string"))
    assert sorted(r["id"] for r in got.collect()) == [10001, 10002, 10003]
    assert R.assign_ids(frame(spark, [])).count() == 0


def test_merge_keeps_history_first(spark):
    full = "id long, title string, text string, time string, source string, url string"
    old = spark.createDataFrame([(10001, "a", "a", "old", "s", ""), (10002, "b", "b", "", "s", "")], full)
    new = spark.createDataFrame([(10001, "a", "a", "new", "s", ""), (10002, "c", "c", "", "s", "")], full)
    got = {r["id"]: (r["title"], r["time"]) for r in R.merge(old, new).collect()}
    assert got == {10001: ("a", "old"), 10002: ("b", ""), 10003: ("c", "")}
    assert {r["id"]: r["title"] for r in R.merge(old, new, reset=True).collect()} == {10001: "a", 10002: "c"}
    assert [(r["id"], r["title"]) for r in R.append_new(old, new).collect()] == [(10003, "c")]


def test_page_stop_keeps_the_short_page(spark):
    pages = spark.createDataFrame([("a", 1, True, True), ("a", 2, True, False), ("a", 3, True, True), ("b", 1, False, False), ("b", 2, True, True)], "t string, p int, ok boolean, full boolean")
    assert sorted((r["t"], r["p"]) for r in control.page_stop(pages, ["t"], "p", "ok", "full").collect()) == [("a", 1), ("a", 2)]


def test_fallback_counts_tasks_without_rows(spark):
    own = spark.createDataFrame([("a", i) for i in range(5)], "t string, x int")
    search = spark.createDataFrame([("a", 9), ("b", 9)], "t string, x int")
    got = control.with_fallback(own, search, spark.createDataFrame([("a",), ("b",)], "t string"), ["t"])
    assert sorted(r["t"] for r in got.collect()) == ["a"] * 5 + ["b"]


def test_families_break_ties_by_first_place(spark):
    df = spark.createDataFrame([(1, "b-x"), (2, "a"), (3, "a"), (4, "b"), (5, "")], "id long, source string")
    assert [(r["family"], r["n"]) for r in audit.source_families(df).collect()] == [("b", 2), ("a", 2), (audit.UNKNOWN, 1)]


def test_history_guards(spark, tmp_path):
    for name, body, n in (("a", '[{"id": 1, "title": null, "text": "x", "time": "", "source": "s", "url": ""}]', 1), ("b", "{}", 0), ("c", '[{"id"', 0), ("d", "", 0), ("e", "[]", 0)):
        (tmp_path / name).write_text(body, encoding="utf-8")
        assert files.read_history(spark, str(tmp_path / name)).count() == n
    assert files.read_history(spark, str(tmp_path / "a")).first()["title"] == ""
    assert files.read_history(spark, str(tmp_path / "none")).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = [(10001, 'q"uo,te', "中文\nline", "", "s-x", ""), (10002, " lead", "", "2024", "s", "u")]
    df = spark.createDataFrame(rows, R.RECORD)
    json_path, jsonl_path, csv_path = files.export(df, str(tmp_path / "raw"))
    assert [tuple(r) for r in files.read_history(spark, str(json_path)).orderBy("id").collect()] == rows
    assert [json.loads(x)["id"] for x in jsonl_path.read_text(encoding="utf-8").splitlines()] == [10001, 10002]
    assert csv_path.read_bytes().startswith(b"\xef\xbb\xbfid,title") and b"\r\n" in csv_path.read_bytes()
    files.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv")).orderBy("id").collect()] == rows
    files.replace(df, str(tmp_path / "table"))
    files.replace(spark.read.parquet(str(tmp_path / "table")).where("id > 10001"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_replay_isolates_failures(spark, tmp_path):
    folder = tmp_path / "kw" / "news"
    folder.mkdir(parents=True)
    (folder / "0-1.json").write_text('{"articles": [{"title": "T", "url": "https://h/p"}]}', encoding="utf-8")
    (folder / "0-2.json").write_bytes(b"\xff\xfe\xff")
    (folder / "0-3.json").write_text('{"articles": null}', encoding="utf-8")
    replay.register(spark)
    got = spark.read.format("replay").option("path", str(tmp_path)).load()
    assert got.where("error IS NOT NULL").count() == 1
    found = payloads.extract(payloads.items(got.where("error IS NULL"), "news"), "news", F.struct("page", "item_ix")).collect()
    assert [(r["title"], r["text"], r["source"]) for r in found] == [("T", "T", "h")]


def test_stream_equals_merge(spark, tmp_path):
    src = tmp_path / "in"
    first = [(i, f"t{i}", "x", "", "s", "") for i in range(5)]
    second = [(i, f"t{i}", "x", "", "s", "") for i in range(3, 8)]
    for rows in (first, second):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(src))
        q = snapshot.start(spark.readStream.schema(SCHEMA).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        assert q.awaitTermination(120)
    got = {r["id"]: r["title"] for r in snapshot.snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {10001 + i: f"t{i}" for i in range(8)}


def test_entry_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hits_of_pages_go_through_python_in_bounded_batches(spark, tmp_path, monkeypatch):
    from tidemill.plans import catalog

    seen, whole = [], catalog.materialise
    monkeypatch.setattr(catalog, "materialise", lambda df: seen.append(df) or whole(df))
    docs = [(1, "Über &lt; <b>x</b>", "s", "de"), (2, None, "s", "en"), (3, "long " * 100, "s", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = [catalog.queries()[q](spark, str(tmp_path)).count() for q in ("q25_html_hits", "q25b_baidu_hits")]
    assert len(seen) == 2 and counts[0] > 0 and counts[1] > 0
