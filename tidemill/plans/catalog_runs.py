"""Registered queries over whole runs: paging over failures and gaps, thresholds, and what a run leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit
from ..scratch import materialise, scratch_dir
from ..sources import fetch, files, requests
from ..sources import payloads as P
from ..sources.store import Store
from ..streaming import keyed
from . import collect as C
from . import fixtures as X
from . import spec as S
from .catalog import _ALL, _B, _EITHER, _MERGED, _T, _Z50, _clean, _numbered, query


@query("q48_paging", f"""
WITH p AS (SELECT doc_id, doc_id // 5 AS task, doc_id % 5 + 1 AS page, ['newsapi', 'currents', 'mediacloud'][doc_id // 5 % 3 + 1] AS platform, (7 * doc_id + doc_id // 5) % 23 AS state, text, source FROM documents),
asked AS (SELECT * FROM p WHERE page <= CASE platform WHEN 'mediacloud' THEN 3 ELSE 5 END AND (SELECT count(*) FROM p q WHERE q.task = p.task AND q.page < p.page AND q.state >= 7) = page - 1),
whole AS (SELECT * FROM asked WHERE state >= 6 AND task NOT IN (SELECT task FROM asked WHERE state = 5)),
hits AS (SELECT *, unnest(range(1, 1 + CASE WHEN state = 6 THEN 1 + doc_id % 3 WHEN platform = 'newsapi' THEN 100 WHEN platform = 'currents' THEN 20 ELSE 3 END)) AS i FROM whole)
SELECT platform, CAST(task AS BIGINT) AS task, CAST(page AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS item, {_clean("left(text, 50) || ' #' || i")} AS title, {_clean("CASE WHEN i = 1 THEN text ELSE 'hit ' || i END")} AS text,
  CASE platform WHEN 'newsapi' THEN 'NewsAPI-' WHEN 'currents' THEN 'Currents-' ELSE 'MediaCloud-' END || source AS source, 'https://p.example/' || doc_id || '/' || i AS url FROM hits""")
def q48(spark, d):
    """Pages of three services, some of them failed, missing, broken, refused, empty, null or short."""
    answers, tasks = X.paged_answers(spark, d)
    got = materialise(C.platform_records(answers, tasks, S.CollectSpec(pages=5, platforms=X.PAGED)))
    platform = F.element_at(F.array(*map(F.lit, X.PAGED)), F.col("seq.platform_ix") + 1)
    return got.select(platform.alias("platform"), F.col("seq.keyword_ix").alias("task"), "seq.page", F.col("seq.item_ix").alias("item"), "title", "text", "source", "url")


@query("q49_thresholds", f"""
WITH g AS (SELECT *, doc_id // 18 AS task, doc_id % 18 AS pos, doc_id // 18 % 4 AS which, doc_id // 18 // 4 % 9 AS own_n FROM documents),
own AS (SELECT *, CASE which WHEN 0 THEN {_Z50} WHEN 1 THEN {_T} ELSE {_clean(f'left({_B}, 50)')} END AS title, CASE WHEN which = 0 AND text = '' THEN {_Z50} ELSE {_B} END AS body, CASE which WHEN 0 THEN '知乎' WHEN 1 THEN source ELSE '微博-' || source END AS label
  FROM g WHERE which < 3 AND pos < own_n AND (which = 0 OR text <> '') AND (which <> 2 OR {_B} <> '')),
engine AS (SELECT * FROM g WHERE which < 3 AND pos >= own_n AND {_T} <> '' AND (SELECT count(*) FROM own WHERE own.task = g.task) < 5),
site AS (SELECT *, CASE WHEN pos < own_n + 5 THEN 0 WHEN pos < own_n + 8 THEN 1 ELSE 2 END AS step FROM g WHERE which = 3 AND ({_T} <> '' OR {_B} <> ''))
SELECT task, 0 AS step, title, body AS text, label AS source FROM own
UNION ALL SELECT task, 1 + pos % 2, {_T}, {_EITHER}, ['知乎', '今日头条', '微博'][which + 1] || '-搜索索引' FROM engine
UNION ALL SELECT task, step, {_T}, {_EITHER}, '人民网-' || ['Google站内索引', 'Google媒体索引', 'Bing媒体索引'][step + 1] FROM site
  WHERE (SELECT count(*) FROM site s WHERE s.task = site.task AND s.step < site.step) < 10""")
def q49(spark, d):
    """Tasks with more and fewer than five rows of their own, and sites with more and fewer than ten entries."""
    answers, tasks = X.grouped_answers(spark, d)
    got = materialise(C.platform_records(answers, tasks, S.CollectSpec(platforms=X.GROUPED)))
    return got.select(F.col("seq.keyword_ix").alias("task"), F.col("seq.step").alias("step"), "title", "text", "source")


@query("q50_json_array", _ALL)
def q50(spark, d):
    """Records as one JSON array in a single file, written in parts side by side and read by byte ranges."""
    prefix = f"{scratch_dir(spark)}/raw"
    files.export(_numbered(spark, d), prefix, ("json",))
    return files.read_history(spark, f"{prefix}.json")


@query("q51_audit", """
SELECT form, split_part(coalesce(nullif(source, ''), '未知'), '-', 1) AS family, count(*) AS n, (SELECT count(*) FROM documents) AS records, true AS complete
FROM documents, (VALUES ('json'), ('jsonl'), ('table')) f(form) GROUP BY ALL""")
def q51(spark, d):
    """The audit of the same records as a JSON array, as JSON lines and as the snapshot's table: all families."""
    prefix = f"{scratch_dir(spark)}/raw"
    files.replace(_numbered(spark, d), f"{prefix}_snapshot")
    files.export(files.read_snapshot(spark, f"{prefix}_snapshot"), prefix, ("json", "jsonl"))  # as a run does: the records are made once
    out = []
    for form, path in (("json", f"{prefix}.json"), ("jsonl", f"{prefix}.jsonl"), ("table", f"{prefix}_snapshot")):
        found = audit.report(spark, path, top=1 << 30)
        out.append(found["families"].select(F.lit(form).alias("form"), "family", "n", F.lit(found["records"]).alias("records"), F.lit(found["complete"]).alias("complete")))
    return reduce(DataFrame.unionByName, out)


@query("q52_store_merge", _MERGED)
def q52(spark, d):
    """History and batch one after the other into a snapshot that grows; the second merge reads the first one's keys only."""
    store = Store(spark, scratch_dir(spark))
    for part in X.history_and_batch(spark, d):
        store.merge(part.withColumn("seq", F.col("id")))
    return store.records()


@query("q53_keyed_stream", _MERGED)
def q53(spark, d):
    """History and batch as a stream in two runs; what was seen is a state by fingerprint."""
    path = scratch_dir(spark)
    for part in X.history_and_batch(spark, d):
        part.withColumn("seq", F.col("id")).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("id long, title string, text string, time string, source string, url string, seq long").parquet(f"{path}/in")
        keyed.start(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return Store(spark, f"{path}/out").records()


@query("q54_charset_detection", """
SELECT ['utf-8', 'utf-16-le', 'utf-16-be', 'cp1252', 'mac_roman', 'cp850', 'gb18030', 'iso8859_15'][doc_id % 8 + 1] AS codec, count(text) AS documents, true AS at_least_95_percent FROM documents GROUP BY ALL""")
def q54(spark, d):
    """Bodies in eight codecs without a charset: whether at least 95 of 100 of each come back as they were."""
    found = X.encoded(spark, d).select("codec", "text", fetch.repaired_text(F.col("body"), F.lit(None).cast("string")).alias("back"))
    right = F.count(F.when(F.col("text") == F.col("back"), 1))
    return found.groupBy("codec").agg(F.count("text").alias("documents"), (right * 100 >= F.count("text") * 95).alias("at_least_95_percent"))


@query("q55_feed_forms", f"""
WITH e AS (SELECT doc_id, text, unnest(['before', 'own', 'behind']) AS which FROM documents),
f AS (SELECT doc_id, which, CASE which WHEN 'before' THEN 'Before' WHEN 'behind' THEN CASE WHEN doc_id % 7 = 4 THEN 'Behi' ELSE 'Behind' END
        WHEN 'own' THEN CASE WHEN doc_id % 7 = 1 THEN {_clean("left(text, 50) || ' & < 5 '")} ELSE {_T} END END AS title,
      CASE which WHEN 'before' THEN 'b' WHEN 'behind' THEN CASE WHEN doc_id % 7 = 4 THEN '' ELSE 'c' END ELSE {_B} END AS body FROM e)
SELECT doc_id, title, CASE WHEN body = '' THEN title ELSE body END AS text, CASE WHEN doc_id % 7 = 4 AND which = 'behind' THEN '' ELSE '2024-01-02 03:04:05' END AS time,
  CASE WHEN doc_id % 7 = 4 AND which = 'behind' THEN '' ELSE 'https://f.example/' || which || '/' || doc_id END AS url FROM f WHERE title <> '' OR body <> ''""")
def q55(spark, d):
    """Feeds in three forms, some of them damaged: the entries before, at and behind the damage."""
    return P.rss_records(P.rss_items(X.feed_forms(spark, d)), F.lit("s"), False, F.col("doc_id")).select(F.col("seq").alias("doc_id"), "title", "text", "time", "url")


def _no_pause(seconds: float) -> None:
    pass


@query("q56_request_stream", """
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt, [200, 403, 500, 429, 404][event_id % 5 + 1] AS status FROM events)
SELECT user_id, min(CASE WHEN status = 200 THEN attempt END) AS used, CASE WHEN min(CASE WHEN status = 200 THEN attempt END) IS NULL THEN 'failed' ELSE 'answered' END AS state FROM a WHERE attempt <= 2 GROUP BY user_id""")
def q56(spark, d):
    """A request for each user of events, as a stream that is stopped and started again; the transport gives the events' statuses."""
    path = scratch_dir(spark)
    how = {"connect": X.event_transport, "sleep": _no_pause, "rate": 1e6, "burst": 64, "every": "0 seconds"}
    with requests.kept(X.event_requests(spark, d)) as plan:
        requests.fetch_plan(spark, plan, f"{path}/answers", f"{path}/checkpoint", longest=1, **how)
        requests.fetch_plan(spark, plan, f"{path}/answers", f"{path}/checkpoint", **how)
    state = F.when(F.col("error").isNull(), "answered").otherwise("failed")
    return requests.stored(spark, f"{path}/answers").select(F.col("keyword").cast("long").alias("user_id"), F.col("payload").cast("long").alias("used"), state.alias("state"))
