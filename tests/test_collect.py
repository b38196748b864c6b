"""The collection run, the edge to the network, and the media directory."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill import __main__ as command
from tidemill.operators import audit, control, directory
from tidemill.plans import collect, spec
from tidemill.sources import fetch, files

AT = datetime.datetime(2026, 7, 1, 10, 30)


def answer(keyword, platform, step, page, payload):
    return (keyword, platform, step, page, payload if payload is None or isinstance(payload, str) else json.dumps(payload), None)


def news(*titles):
    return {"articles": [{"title": t, "url": f"https://h/{t}", "domain": "h", "seendate": "20240102030405"} for t in titles]}


def records(spark, rows, details=None, **settings):
    wanted = spec.CollectSpec(**{"keywords": ("k", "m"), "platforms": tuple(dict.fromkeys(r[1] for r in rows)), **settings})
    return collect.platform_records(spark.createDataFrame(rows, collect.ANSWERS), spec.tasks(spark, wanted), wanted, details).orderBy("seq").collect()


def test_news_takes_as_many_hits_as_its_pages_ask_for(spark):
    rows = [answer("k", "news", 0, 1, news(*map(str, range(120)))), answer("k", "news", 0, 2, news("late"))]
    assert len(records(spark, rows, pages=1)) == 30 and len(records(spark, rows, pages=9)) == 100


def test_articles_go_before_titles(spark):
    page = "<p>An article of more than fifteen characters &amp; more.</p><p>short</p>"
    details = spark.createDataFrame([("https://h/a", page), ("https://h/a", page), ("https://h/b", "<p>x</p>")], "url string, html string")
    got = records(spark, [answer("k", "news", 0, 1, news("a", "b", "c"))], details, fetch_news_detail=True)
    assert [r["text"] for r in got] == ["An article of more than fifteen characters & more.", "b", "c"]
    assert [r["text"] for r in records(spark, [answer("k", "news", 0, 1, news("a"))], details)] == ["a"]


def test_an_explicit_null_fails_the_task_and_no_other(spark):
    rows = [answer("k", "news", 0, 1, news("a")), answer("m", "news", 0, 1, '{"articles": null}'), answer("k", "bilibili", 0, 1, {"data": {"result": [{"title": "x"}]}}), answer("k", "bilibili", 0, 2, '{"data": null}'), answer("m", "bilibili", 0, 1, "{}")]
    assert [r["title"] for r in records(spark, rows)] == ["a"]


def test_pages_stop_behind_a_short_or_failed_one(spark):
    def page(n, status="ok"):
        return {"status": status, "news": [{"title": f"t{i}", "description": "d"} for i in range(n)]}

    rows = [answer("k", "currents", 0, 1, page(20)), answer("k", "currents", 0, 2, page(3)), answer("k", "currents", 0, 3, page(20)), answer("m", "currents", 0, 1, page(5, "error"))]
    assert len(records(spark, rows)) == 23
    long = [answer("k", "currents", 0, p, page(20)) for p in range(1, 9)]
    assert len(records(spark, long, pages=9)) == 100


def test_the_archive_follows_its_token(spark):
    rows = [answer("k", "mediacloud", 0, p, {"stories": [{"name": f"s{p}", "media": {"name": "M"}}], "pagination_token": t}) for p, t in ((1, "x"), (2, None), (3, "y"))]
    got = records(spark, rows)
    assert [(r["title"], r["text"], r["source"]) for r in got] == [("s1", "s1", "MediaCloud-M"), ("s2", "s2", "MediaCloud-M")]


def test_engines_run_only_for_few_own_rows_and_may_fail(spark):
    own = {"data": [{"title": f"t{i}", "abstract": "a"} for i in range(5)]}
    hit = "<li class='b_algo'><h2><a href='https://toutiao.com/1'>Found</a></h2><p>text</p></li>"
    duck = "<div class='result'><a class='result__a' href='https://www.toutiao.com/2'>Also</a></div>"
    rows = [answer("k", "toutiao", 0, 1, own), answer("k", "toutiao", 1, 1, hit), answer("m", "toutiao", 0, 1, {"data": own["data"][:4]}), answer("m", "toutiao", 1, 1, hit), answer("m", "toutiao", 2, 1, duck), answer("m", "toutiao", 3, 1, None), answer("k", "xiaohongshu", 1, 1, hit.replace("toutiao", "xiaohongshu"))]
    got = [(r["seq"]["keyword_ix"], r["title"], r["source"]) for r in records(spark, rows)]
    assert len(got) == 5 + 1 + 4 + 2 and (1, "Found", "今日头条-搜索索引") in got and (1, "Also", "今日头条-搜索索引") in got and (0, "Found", "小红书-搜索索引") in got


def test_feeds_and_media_sites(spark):
    def feed(n, tag="x"):
        return "<rss><channel>" + "".join(f"<item><title>{tag}{i}</title><link>u{i}</link></item>" for i in range(n)) + "</channel></rss>"

    got = records(spark, [answer("k", "rssnews", 0, 1, feed(1)), answer("k", "rssnews", 1, 1, feed(1)), answer("k", "rssnews", 2, 1, feed(1))])
    assert [r["source"] for r in got] == ["BingNewsRSS", "GoogleNewsRSS"]
    sites = [answer("k", "sitenews", 0, 1, feed(6)), answer("k", "sitenews", 1, 1, feed(4)), answer("k", "sitenews", 2, 1, feed(9)), answer("k", "sitenews", 5, 1, feed(2)), answer("k", "sitenews", 18, 1, feed(2))]
    got = [r["source"] for r in records(spark, sites, pages=1)]
    assert got == ["人民网-Google站内索引"] * 6 + ["人民网-Google媒体索引"] * 4 + ["央视网-Bing媒体索引"] * 2
    assert len(records(spark, sites, pages=2)) == 14


def test_run_from_files_to_snapshot(spark, tmp_path):
    store = tmp_path / "answers"
    for keyword, name, body in (("k", "0-1.json", json.dumps(news("a", "b"), ensure_ascii=False).encode()), ("校园", "0-1.json", json.dumps(news("标题"), ensure_ascii=False).encode("gb18030"))):
        (store / keyword / "news").mkdir(parents=True)
        (store / keyword / "news" / name).write_bytes(body)
    wanted = spec.parse(["--keywords", "k", "校园", "--platforms", "news", "--output-prefix", "raw"])
    assert wanted == spec.CollectSpec(("k", "校园"), 3, ("news",), False, 10001, "raw", False)
    out = str(tmp_path / "out")
    got = collect.run(spark, wanted, collect.read_answers(spark, str(store)), out, AT).first()
    assert tuple(got) == (3, 3)
    again = spark.createDataFrame([answer("k", "news", 0, 1, news("b", "c"))], collect.ANSWERS)
    assert tuple(collect.run(spark, wanted, again, out, AT + datetime.timedelta(days=1)).first()) == (2, 4)
    total = files.read_snapshot(spark, f"{out}/raw_snapshot").orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in total] == [(10001, "a"), (10002, "b"), (10003, "标题"), (10004, "c")]
    for name in ("raw_20260701_103000.json", "raw.json", "raw_snapshot", "raw_batches"):
        found = audit.report(spark, f"{out}/{name}")
        n = {"raw_20260701_103000.json": 3, "raw_batches": 5}.get(name, 4)
        assert (found["records"], found["complete"]) == (n, True) and sum(r["n"] for r in found["families"].collect()) == n
        assert name == "raw_batches" or [r["id"] for r in found["head"].collect()] == [10001, 10002, 10003]
    assert json.loads((tmp_path / "out" / "raw.json").read_text()) == [r.asDict() for r in total]
    assert (tmp_path / "out" / "raw.json").read_text() == json.dumps([r.asDict() for r in total], ensure_ascii=False, indent=2)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.endswith((".parts", ".new", ".crc"))]
    for name in ("raw_20260701_103000.json", "raw_20260701_103000.jsonl", "raw_20260701_103000.csv", "raw.json", "raw.csv"):
        assert (tmp_path / "out" / name).exists()
    assert [r["title"] for r in files.read_history(spark, f"{out}/raw.json").orderBy("id").collect()] == ["a", "b", "标题", "c"]
    found = audit.report(spark, f"{out}/raw_20260701_103000.jsonl")
    assert found["records"] == 3 and found["complete"] and found["head"].count() == 3
    reset = spec.CollectSpec(("k",), 3, ("news",), output_prefix="raw", reset=True)
    assert tuple(collect.run(spark, reset, again, out, AT + datetime.timedelta(days=2)).first()) == (2, 2)


def test_audit_of_nothing_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        audit.report(spark, str(tmp_path / "none.jsonl"))
    assert command.main(["audit"]) == 2
    (tmp_path / "broken.json").write_text('[{"id": 1}')
    (tmp_path / "text.json").write_text("hello")
    for name in ("broken.json", "text.json"):
        with pytest.raises(ValueError):
            audit.report(spark, str(tmp_path / name))
    (tmp_path / "few.json").write_text('[{"id": 1, "source": "b-x"}, {"source": null}, {"id": 3, "source": "b-y", "title": "", "text": "", "time": "", "url": ""}]')
    found = audit.report(spark, str(tmp_path / "few.json"))
    assert (found["records"], found["complete"]) == (3, False) and [(r["family"], r["n"]) for r in found["families"].collect()] == [("b", 2), ("未知", 1)]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "answers/k/news").mkdir(parents=True)
    (tmp_path / "answers/_articles").mkdir()
    (tmp_path / "answers/k/news/0-1.json").write_text(json.dumps(news("a", "b")))
    (tmp_path / "answers/_articles/a.jsonl").write_text(json.dumps({"url": "https://h/a", "html": "<p>An article that is long enough.</p>"}) + "\n")
    out = str(tmp_path / "out")
    assert command.main(["collect", str(tmp_path / "answers"), out, "--keywords", "k", "--platforms", "news", "--fetch-news-detail", "--output-prefix", "x"]) == 0
    assert [r["text"] for r in json.loads((tmp_path / "out/x.json").read_text())] == ["An article that is long enough.", "b"]
    assert command.main(["audit", f"{out}/x.json"]) == 0 and command.main(["audit", f"{out}/x_snapshot"]) == 0 and command.main(["audit", f"{out}/none"]) == 1
    (tmp_path / "words.txt").write_text('# one\n"a.cn",\n"b.cn",\n"a.cn",\n')
    (tmp_path / "found.jsonl").write_text("\n".join(json.dumps({"word": "a.cn", "item_ix": i, "item": {"id": 7 - i, "name": "n"}}) for i in range(3)))
    capsys.readouterr()
    assert command.main(["directory", str(tmp_path / "words.txt"), str(tmp_path / "found.jsonl")]) == 0
    assert capsys.readouterr().out.strip().endswith("7,6,5")


def test_exports_of_nothing_and_of_awkward_texts(spark, tmp_path):
    rows = [(2, 'q"uote', "line\nbreak\t\x01\\", "", "中😀", None), (1, "", "comma, \r\n", "t", "s", "u"), (None, None, None, None, None, None)]
    fields = "id long, title string, text string, time string, source string, url string"
    files.export(spark.createDataFrame(rows, fields).repartition(3), str(tmp_path / "a"))
    want = [dict(zip(files.FIELDS, r)) for r in sorted(rows, key=lambda r: r[0] or 0)]
    assert json.loads((tmp_path / "a.json").read_text()) == want and [json.loads(x) for x in (tmp_path / "a.jsonl").read_text().split("\n")[:-1]] == want
    import csv

    with (tmp_path / "a.csv").open(encoding="utf-8-sig", newline="") as f:
        assert [list(r.values()) for r in csv.DictReader(f)] == [["" if v is None else str(v) for v in r.values()] for r in want]
    files.export(spark.createDataFrame([], fields), str(tmp_path / "a"))
    assert (tmp_path / "a.json").read_text() == "[]" and (tmp_path / "a.jsonl").read_text() == "" and len((tmp_path / "a.csv").read_text(encoding="utf-8-sig").splitlines()) == 1


def test_failures_by_task(spark):
    rows = [("k", "news", 0, 1, None, "TimeoutError"), ("k", "news", 0, 2, None, "OSError"), ("m", "news", 0, 1, "{}", None)]
    assert [tuple(r) for r in collect.failures(spark.createDataFrame(rows, collect.ANSWERS)).collect()] == [("k", "news", 2, "OSError")]


def test_options_windows_and_ids():
    assert spec.options(spec.CollectSpec(pages=2, fetch_news_detail=True), "news") == {"pages": 1, "fetch_detail": True, "hits": 60}
    assert spec.options(spec.CollectSpec(pages=9), "newsapi") == {"pages": 5} and spec.options(spec.CollectSpec(pages=9), "weibo") == {"pages": 9}
    assert spec.date_window("newsapi", datetime.date(2026, 3, 1)) == (datetime.date(2026, 1, 31), datetime.date(2026, 3, 1))
    assert spec.directory_ids() == ([34412234], []) and spec.directory_ids("1, x,2") == ([1, 2], []) and spec.directory_ids("1", " 7,8") == ([], [7, 8])
    assert spec.credential("weibo", {"WEIBO_COOKIE": " c "}) == "c" and spec.credential("news", {}) == ""


def test_requests_are_tried_again_and_never_raise():
    slept, calls = [], []

    def get(*answers):
        it = iter(answers)

        def one(url, headers, timeout):
            calls.append((headers, timeout))
            x = next(it)
            if isinstance(x, Exception):
                raise x
            return fetch.Answer(x, b"ok")

        return one

    limiter = fetch.Limiter(slept.append, random.Random(1))
    headers = fetch.request_headers({"Accept-Language": "de"}, "c")
    assert headers["Cookie"] == "c" and headers["Accept-Language"] == "de" and "Cookie" not in fetch.request_headers()
    assert fetch.safe_get(get(500, 429, 204), "u", limiter, headers).status == 204
    assert len(slept) == 4 and 1.8 <= slept[0] <= 4.5 and 3.6 <= slept[1] <= 9 and 6 <= slept[2] <= 9 and 5.4 <= slept[3] <= 13.5
    assert fetch.safe_get(get(TimeoutError(), 403), "u", limiter, {}, retries=1, timeout=10) is None and calls[-1][1] == 10
    made = []
    assert fetch.session(f := lambda: made.append(1) or object()) is fetch.session(f) and made == [1]


def test_charsets(spark):
    cases = [("é中", "utf-8", None), ("é中", "utf-8", "ISO-8859-1"), ("中文标题", "gb18030", None), ("中文", "gb18030", "gb2312"), ("中", "utf-16-le", "utf-16-le"), ("x", "utf-8", "no-such"), ("", "utf-8", None)]
    rows = [(i, bytearray(t.encode(e)), c) for i, (t, e, c) in enumerate(cases)] + [(99, None, None)]
    got = spark.createDataFrame(rows, "i int, b binary, c string").select("i", fetch.repaired_text(F.col("b"), F.col("c")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for t, _, _ in cases] + [None]


def test_retries_as_a_plan(spark):
    rows = [("a", 0, 500), ("a", 1, 200), ("a", 2, 200), ("b", 0, 403), ("b", 1, 403), ("b", 2, 403), ("b", 3, 200)]
    got = control.retried(spark.createDataFrame(rows, "t string, n int, s int"), ["t"], "n", "s").orderBy("t").collect()
    assert [tuple(r) for r in got] == [("a", 1, 2), ("b", None, 3)]


def test_directory(spark):
    lines = ['# ====', "# 央媒", "# ====", '"a.cn",', '"b.cn",', "", "# 门户", '"a.cn",', '"c.cn",']
    words = directory.parse_words(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    assert [(r["category"], r["word"]) for r in words.orderBy("ord").collect()] == [("央媒", "a.cn"), ("央媒", "b.cn"), ("门户", "a.cn"), ("门户", "c.cn")]
    once = directory.distinct_words(words)
    assert {(r["word"], r["category"], r["times"]) for r in once.collect()} == {("a.cn", "央媒", 2), ("b.cn", "央媒", 1), ("c.cn", "门户", 1)}
    item = "struct<id:long,name:string,label:string,url:string,homepage:string,domain:string,pub_country:string,primary_language:string>"
    found = spark.createDataFrame([("a.cn", i, (7 - i % 7, None, "L", "", "h", "d", "CN", "zh")) for i in range(12)] + [("c.cn", 0, (0, "n", "L", "u", "h", "d", "CN", "zh")), ("c.cn", 1, (3, "n", "L", "u", "h", "d", "CN", "zh"))], f"word string, item_ix int, item {item}")
    results = directory.search_results(once, found)
    assert results.count() == 12 and directory.id_setting(results).first()["ids"] == "7,6,5,4,3,2,1"
    assert tuple(directory.show_items(results, 1).orderBy("ord").first())[3:7] == (7, "L", "L", "h")
    assert directory.collection_words(spark).count() == 5


def _paged(platform, n, status="ok", token="t"):
    key = {"newsapi": "articles", "currents": "news", "mediacloud": "stories"}[platform]
    hits = n if n is None else [{"title": f"t{i}", "description": "d", "media_name": "M"} for i in range(n)]
    return {"status": status, "pagination_token": token, key: hits}


@pytest.mark.parametrize("platform, full", [("newsapi", 100), ("currents", 20), ("mediacloud", 3)])
def test_nothing_behind_a_page_that_failed_is_missing_or_broken(spark, platform, full):
    page = lambda n, **more: _paged(platform, n, **more)
    last = page(2, token=None)
    cases = {
        "all": ([page(full), page(full), last], 2 * full + 2), "failed first": ([None, page(full), page(full)], 0), "failed second": ([page(full), None, page(full)], full),
        "broken": ([page(full), '{"status": "ok", ', page(full)], full), "missing first": (["missing", page(full)], 0), "missing second": ([page(full), "missing", page(full)], full),
        "empty": ([page(full), page(0), page(full)], full), "short": ([last, page(full)], 2), "null": ([page(full), page(None)], 0), "null behind the stop": ([last, page(None)], 2),
        "no object": ([page(full), "[1]"], 0), "text for hits": ([page(full), page(full) | dict.fromkeys(("articles", "news", "stories"), "x")], 0), "a hit that is no object": ([page(full) | dict.fromkeys(("articles", "news", "stories"), [3])], 0),
    }
    if platform != "mediacloud":
        cases["refused"] = ([page(full), page(full, status="error"), page(full)], full)
        cases["refused with null"] = ([page(full), page(None, status="error")], full)
    rows = [answer(name, platform, 0, i, p) for name, (pages, _) in cases.items() for i, p in enumerate(pages, 1) if p != "missing"]
    wanted = spec.CollectSpec(tuple(cases), 3, (platform,))
    got = collect.platform_records(spark.createDataFrame(rows, collect.ANSWERS), spec.tasks(spark, wanted), wanted).groupBy("seq.keyword_ix").count().collect()
    counts = {tuple(cases)[r[0]]: r[1] for r in got}
    assert {k: counts.get(k, 0) for k in cases} == {k: n for k, (_, n) in cases.items()}


def test_hits_that_make_a_connector_raise(spark):
    rows = [
        answer("k", "mediacloud", 0, 1, {"stories": [{"title": "a", "media": None}]}), answer("m", "mediacloud", 0, 1, {"stories": [{"title": "b", "media_name": "M", "media": None}, {"title": "c"}]}),
        answer("k", "toutiao", 0, 1, {"data": [{"title": "a", "abstract": "x", "display": None}]}), answer("m", "toutiao", 0, 1, {"data": [{"title": "a", "display": None}, {"title": "b"}]}),
        answer("k", "bilibili", 0, 1, {"data": {"result": None}}), answer("k", "bilibili", 0, 2, {"data": {"result": [{"title": "d"}]}}), answer("m", "bilibili", 0, 1, {"data": {"result": ["x"]}}),
        answer("k", "zhihu", 0, 1, {"data": None}), answer("m", "zhihu", 0, 1, {"data": [{"object": None}, {"object": {"title": "z"}}]}),
    ]
    got = sorted((r["seq"]["keyword_ix"], r["title"]) for r in records(spark, rows))
    assert got == [(0, "a"), (0, "d"), (1, "b"), (1, "c"), (1, "z"), (1, "知乎内容")]


def test_page_stop_with_gaps_and_twins(spark):
    rows = [("a", 1, True, True), ("a", 3, True, True), ("b", 2, True, True), ("c", 1, True, True), ("c", 1, True, True), ("c", 2, True, False), ("c", 3, True, True), ("d", 1, None, None), ("d", 2, True, True)]
    got = control.page_stop(spark.createDataFrame(rows, "t string, p int, ok boolean, full boolean"), ["t"], "p", "ok", "full").collect()
    assert sorted((r["t"], r["p"]) for r in got) == [("a", 1), ("c", 1), ("c", 1), ("c", 2)]


def test_options_as_columns_equal_options(spark):
    rows = [(n, p) for n in range(1, 12) for p in spec.PLATFORMS]
    got = spark.createDataFrame(rows, "n long, p string").select("n", "p", *[c.alias(k) for k, c in spec.option_columns(F.col("n"), F.col("p")).items()]).collect()
    for r in got:
        want = spec.options(spec.CollectSpec(pages=r["n"]), r["p"])
        assert (r["asked"], r["hits"], r["sites"]) == (want["pages"], want.get("hits"), want.get("sites"))
    first = spark.createDataFrame([("bing", 3), ("baidu", 1), ("other", 2)], "s string, p int").select(spec.page_offset(F.col("s"), F.col("p")).alias("x")).collect()
    assert [r["x"] for r in first] == [21, 0, None]


def test_lines_that_are_no_objects_are_shown(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "title": "t"}\n\n[1]\n{"id": 2\nnull\n{"id": 3}\n')
    assert sorted(r["line"] for r in files.broken_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["[1]", "null", '{"id": 2']
    assert {1, 3} <= {r["id"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()}


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_an_audit_reads_all_parts_at_once(spark, tmp_path):
    found = []
    for n in (1, 12):
        rows = spark.range(12).selectExpr("id", "'t' AS title", "'x' AS text", "'' AS time", "'s-1' AS source", "'u' AS url")
        rows.repartition(n, "id").write.json(str(tmp_path / f"lines{n}"))
        found.append(_jobs(spark, f"audit-{n}", lambda n=n: audit.report(spark, str(tmp_path / f"lines{n}"))))
    assert [(f["records"], f["complete"]) for f, _ in found] == [(12, True)] * 2
    assert found[0][1] == found[1][1]


def test_the_audited_records_are_made_once(spark, tmp_path, monkeypatch):
    from tidemill.plans import catalog
    from tidemill.sources import files

    plans, export = [], files.export
    monkeypatch.setattr(files, "export", lambda records, *more: plans.append(records._jdf.queryExecution().executedPlan().toString()) or export(records, *more))
    docs = [(i, f"a &lt; {i}", "s-1", "de") for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["q51_audit"](spark, str(tmp_path)).collect()
    assert sorted((r["form"], r["family"], r["n"], r["records"], r["complete"]) for r in found) == [(f, "s", 5, 5, True) for f in ("json", "jsonl", "table")]
    assert plans and not any("Python" in p for p in plans)


def test_connectors_hand_small_batches_to_python(spark, monkeypatch):
    from tidemill import scratch
    from tidemill.plans import collect as plan

    key, seen, whole = next(iter(scratch.BATCHES)), [], scratch.settings
    monkeypatch.setattr(scratch, "settings", lambda s, values: seen.append(values[key]) or whole(s, values))
    rows = spark.createDataFrame([("t", "x", "", "s", "u", 1)], "title string, text string, time string, source string, url string, seq long")
    monkeypatch.setattr(plan, "platform_records", lambda *a: rows)
    assert [(r["id"], r["title"]) for r in plan.collect(None, None, plan.S.CollectSpec()).collect()] == [(10001, "t")]
    assert seen[0] == "1m"
