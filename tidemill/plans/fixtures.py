"""Test tables as the inputs that the connectors expect: deterministic, nothing is written."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import make_record
from ..sources.fetch import Answer
from ..sources.requests import Request
from .spec import ENGINES, FALLBACK_DOMAINS, PLATFORMS


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents, with doc_id as their order and id."""
    d = documents(spark, sf_dir)
    return make_record(d, F.substring("text", 1, 50), F.col("text"), F.col("source"), seq=F.col("doc_id"))


def history_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping parts: seven in ten buckets of doc_id are history, six are new, three are both."""
    r = records(spark, sf_dir).withColumn("id", F.col("seq"))
    return r.where("seq % 10 < 7").drop("seq"), r.where("seq % 10 >= 4").drop("seq")


def json_payloads(spark: SparkSession, sf_dir: str, connector: str) -> DataFrame:
    """One answer per document with one hit; every fifth lacks the first key, every fifth has it empty."""
    d = documents(spark, sf_dir).withColumn("t", F.substring("text", 1, 50))
    k = F.pmod("doc_id", F.lit(5))

    def thin(c):
        return F.when(k == 1, F.lit("")).when(k == 2, F.lit(None)).otherwise(c)

    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string"))
    t, x, s, none = F.col("t"), F.col("text"), F.col("source"), F.lit(None).cast("string")
    made = {
        "news": F.struct(F.array(F.struct(t.alias("title"), url.alias("url"), s.alias("domain"), thin(s).alias("sourceCommonName"), F.lit("20240102030405").alias("seendate"))).alias("articles")),
        "newsapi": F.struct(F.lit("ok").alias("status"), F.array(F.struct(F.struct(thin(s).alias("name")).alias("source"), t.alias("title"), thin(t).alias("description"), x.alias("content"), F.lit("2024-01-02T03:04:05Z").alias("publishedAt"), url.alias("url"))).alias("articles")),
        "currents": F.struct(F.lit("ok").alias("status"), F.array(F.struct(t.alias("title"), x.alias("description"), thin(s).alias("author"), F.lit("2024-01-02 03:04:05 +0000").alias("published"), url.alias("url"))).alias("news")),
        "mediacloud": F.struct(F.array(F.struct(thin(t).alias("title"), t.alias("name"), thin(url).alias("url"), url.alias("guid"), none.alias("publish_date"), F.lit("2024-01-02").alias("date"), thin(s).alias("media_name"), F.struct(s.alias("name")).alias("media"), thin(x).alias("description"), x.alias("content"))).alias("stories")),
        "bilibili": F.struct(F.struct(F.array(F.struct(t.alias("title"), thin(x).alias("description"), thin(s).alias("author"), F.concat(F.lit("//b.example/"), F.col("doc_id").cast("string")).alias("arcurl"), (F.lit(1704164645) + F.col("doc_id")).alias("pubdate"))).alias("result")).alias("data")),
        "zhihu": F.struct(F.array(F.struct(F.struct(F.lit("article").alias("type"), t.alias("title"), x.alias("excerpt"), F.concat(F.lit("https://z.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit(1704164645).alias("created_time")).alias("object"))).alias("data")),
        "toutiao": F.struct(F.array(F.struct(thin(t).alias("title"), x.alias("abstract"), thin(s).alias("source"), s.alias("media_name"), F.concat(F.lit("/a"), F.col("doc_id").cast("string")).alias("article_url"), F.lit("1704164645").alias("display_time"), F.struct(t.alias("title"), x.alias("summary")).alias("display"))).alias("data")),
    }
    return d.select("doc_id", F.to_json(made[connector]).alias("payload"))


def zhihu_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed object per turn of conversations."""
    c = load(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("answer", "article", "question", "other"))), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    n = F.col("conv_id").cast("string")
    url = F.when(kind == "answer", F.concat(F.lit("https://api.zhihu.com/api/v4/answers/"), n, F.lit("/"))).when(kind == "article", F.concat(F.lit("https://api.zhihu.com/api/v4/articles/"), n)).otherwise(F.concat(F.lit("https://z.example/"), n))
    head = F.substring("text", 1, 30)
    o = F.struct(kind.alias("type"), n.alias("id"), head.alias("title"), F.when(kind == "question", head).alias("name"), F.col("text").alias("excerpt"), url.alias("url"), (F.lit(1704164645) + F.col("turn")).alias("created_time"), F.struct(n.alias("id"), head.alias("name")).alias("question"))
    return c.select("conv_id", "turn", F.to_json(F.struct(F.array(F.struct(o.alias("object"))).alias("data"))).alias("payload"))


SITES = ("weibo.com", "other.example", "s.weibo.com")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def result_pages(spark: SparkSession, sf_dir: str, engine: str, host=None) -> DataFrame:
    """One result page with one hit per document, in the engine's markup; the host goes by doc_id % 3 where none is given."""
    d = documents(spark, sf_dir)
    host = F.element_at(F.array(*map(F.lit, SITES)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")) if host is None else host
    url = F.concat(F.lit("https://"), host, F.lit("/"), F.col("doc_id").cast("string"))
    t, x = _escaped(F.substring("text", 1, 50)), _escaped(F.col("text"))
    form = {
        "bing": ("<ol><li class='b_algo'><h2><a href='%s'>%s</a></h2><p>%s</p></li></ol>", (url, t, x)),
        "duckduckgo": ("<div class='result x'><a class='result__a' href='%s'>%s</a><a class='result__snippet'>%s</a></div>", (url, t, x)),
        "baidu": ("<div class='c-container'><h3><a href='%s'>%s</a></h3><span>%s</span></div>", (url, t, x)),
        "weibo": ("<div class='card-wrap' action-type='feed_list_item'><a class='name'>%s</a><div class='from'><a href='%s'>2024-01-02 03:04</a></div><p class='txt' node-type='feed_list_content'>%s</p></div>", (F.col("source"), F.concat(F.lit("//"), host, F.lit("/"), F.col("doc_id").cast("string")), x)),
    }[engine]
    return d.select("doc_id", F.format_string(form[0], *form[1]).alias("page"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    t, x = _escaped(F.substring("text", 1, 50)), _escaped(F.col("text"))
    xml = F.format_string("<rss><channel><item><title>%s</title><description>%s</description><link>https://%s.example/%s</link><pubDate>2024-01-02 03:04:05</pubDate></item></channel></rss>", t, x, F.col("source"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.col("source").alias("feed_source"), xml.alias("feed"))


def time_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's time in one of eight shapes."""
    ts = F.col("ts").cast("timestamp")
    whole = F.unix_timestamp(ts)
    shapes = [
        whole.cast("string"), F.concat(whole.cast("string"), F.lit("123")), F.date_format(ts, "yyyyMMddHHmmss"), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd"), F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0800")), F.concat(F.lit(" junk "), F.col("event_type"), F.lit(" ")),
    ]
    k = F.pmod("event_id", F.lit(8))
    raw = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        raw = F.when(k == i, s).otherwise(raw)
    return load(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as they are, without scheme, without host, and empty."""
    rest = F.regexp_replace("url", "^https?://", "")
    k = F.pmod("page_id", F.lit(4))
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("//"), rest)).when(k == 2, F.concat(F.lit("/"), F.regexp_replace(rest, "^[^/]*/", ""))).otherwise(F.lit(""))
    return load(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers of all platforms, and the tasks: each document is the one answer to a keyword of its own, on the platform of
    doc_id % 11. Where that has a site search, the document is the hit of one engine too."""
    names, n = list(PLATFORMS), len(PLATFORMS)
    platform_ix, turn = F.pmod("doc_id", F.lit(n)).cast("int"), F.expr(f"doc_id div {n}")

    def of(made: DataFrame, platform: str, step=F.lit(0), payload: str = "payload") -> DataFrame:
        return made.where(platform_ix == names.index(platform)).select(
            F.col("doc_id").cast("string").alias("keyword"), F.lit(platform).alias("platform"), step.cast("int").alias("step"), F.lit(1).alias("page"), F.col(payload).alias("payload"), F.lit(None).cast("string").alias("error")
        )

    parts = [of(json_payloads(spark, sf_dir, c), c) for c in ("news", "newsapi", "currents", "mediacloud", "bilibili", "zhihu", "toutiao")]
    parts += [of(feeds(spark, sf_dir), "rssnews", turn % 2, "feed"), of(feeds(spark, sf_dir), "sitenews", turn % 3, "feed"), of(result_pages(spark, sf_dir, "weibo"), "weibo", payload="page")]
    for platform, domains in FALLBACK_DOMAINS.items():
        for i, engine in enumerate(ENGINES):
            parts.append(of(result_pages(spark, sf_dir, engine, F.lit(domains[0])).where(turn % 3 == i), platform, F.lit(i + 1), "page"))
    tasks = documents(spark, sf_dir).select(F.col("doc_id").alias("keyword_ix"), F.col("doc_id").cast("string").alias("keyword"), platform_ix.alias("platform_ix"), F.element_at(F.array(*map(F.lit, names)), platform_ix + 1).alias("platform"))
    return reduce(DataFrame.unionByName, parts), tasks


def directory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words (hosts of pages, listed as often as they occur) and what a search of each finds: its pages."""
    p = load(spark, sf_dir, "pages").withColumn("word", F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    n = F.col("page_id").cast("string")
    name = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("n"), n))
    item = F.struct(F.col("page_id").alias("id"), name.alias("name"), F.concat(F.lit("l"), n).alias("label"), F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("")).otherwise(F.col("url")).alias("url"), F.col("url").alias("homepage"), F.col("word").alias("domain"), F.lit("CN").alias("pub_country"), F.lit("zh").alias("primary_language"))
    found = p.select("word", (F.row_number().over(Window.partitionBy("word").orderBy("page_id")) - 1).alias("item_ix"), item.alias("item"))
    return p.select(F.col("page_id").alias("ord"), F.lit("").alias("category"), "word"), found


#: States of a page in paged_answers(), by (7 * doc_id + task) modulo 23; those from 7 on are full.
FAILED, MISSING, BROKEN, REFUSED, EMPTY, NULL, SHORT, STATES, PAGES_OF_TASK = 0, 1, 2, 3, 4, 5, 6, 23, 5
PAGED = ("newsapi", "currents", "mediacloud")


def paged_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers of the services that are paged, and the tasks: five documents are the pages of a task, whose number goes by platforms in turn.

    A page has as many hits as the service gives; the first has the document's whole text. Some pages failed, are missing, are no JSON,
    are refused, are empty, have null for their hits, or are short."""
    d = documents(spark, sf_dir).withColumn("task", F.expr(f"doc_id div {PAGES_OF_TASK}")).withColumn("state", F.pmod(7 * F.col("doc_id") + F.col("task"), F.lit(STATES)))
    platform_ix = F.pmod("task", F.lit(len(PAGED))).cast("int")
    platform = F.element_at(F.array(*map(F.lit, PAGED)), platform_ix + 1)
    t, s, state = F.substring("text", 1, 50), F.col("source"), F.col("state")
    size = F.element_at(F.array(F.lit(100), F.lit(20), F.lit(3)), platform_ix + 1)
    n = F.when(state == EMPTY, 0).when(state == SHORT, 1 + F.pmod("doc_id", F.lit(3))).otherwise(size).cast("int")

    def hit(i):
        number = i.cast("string")
        title, body = F.concat(t, F.lit(" #"), number), F.when(i == 1, F.col("text")).otherwise(F.concat(F.lit("hit "), number))
        url = F.concat(F.lit("https://p.example/"), F.col("doc_id").cast("string"), F.lit("/"), number)
        return F.struct(title.alias("title"), body.alias("description"), url.alias("url"), s.alias("author"), s.alias("media_name"), F.struct(s.alias("name")).alias("source"))

    hits = F.to_json(F.slice(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), hit), F.lit(1), n))
    hits = F.when(state == NULL, "null").otherwise(hits)
    name = F.element_at(F.array(F.lit("articles"), F.lit("news"), F.lit("stories")), platform_ix + 1)
    status, token = F.when(state == REFUSED, "error").otherwise("ok"), F.when(state == SHORT, "").otherwise("next")
    whole = F.format_string('{"status": "%s", "pagination_token": "%s", "%s": %s}', status, token, name, hits)
    none = (state == FAILED) | ((state == REFUSED) & (platform == "mediacloud"))
    payload = F.when(none, F.lit(None).cast("string")).when(state == BROKEN, F.substring(whole, 1, 30)).otherwise(whole)
    made = d.where(state != MISSING).select(
        F.col("task").cast("string").alias("keyword"), platform.alias("platform"), F.lit(0).alias("step"), (F.pmod("doc_id", F.lit(PAGES_OF_TASK)) + 1).cast("int").alias("page"), payload.alias("payload"), F.when(none, "TimeoutError").alias("error")
    )
    tasks = d.select(F.col("task").alias("keyword_ix"), F.col("task").cast("string").alias("keyword"), platform_ix.alias("platform_ix"), platform.alias("platform")).distinct()
    return made, tasks


GROUPED, IN_GROUP = ("zhihu", "toutiao", "weibo", "sitenews"), 18


def grouped_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers and tasks on both sides of the thresholds: 18 documents are a task, its platform one of four in turn.

    The first 0 to 8 of them are a platform's own hits, the rest those of the first two engines in turn; of a media site's
    three searches the first finds 5 to 13, the second the next three, the last the rest."""
    task, at = F.expr(f"doc_id div {IN_GROUP}"), F.pmod("doc_id", F.lit(IN_GROUP))
    which, some = F.pmod(task, F.lit(len(GROUPED))).cast("int"), F.pmod(F.expr(f"doc_id div {IN_GROUP * len(GROUPED)}"), F.lit(9))
    own = at < some

    def pages(made: DataFrame, platform: str, keep, step, piece, frame: tuple[str, str], between: str = "") -> DataFrame:
        rows = made.where((which == GROUPED.index(platform)) & keep).select(task.alias("task"), step.cast("int").alias("step"), F.struct(at.alias("at"), piece.alias("piece")).alias("p"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), between)
        return rows.groupBy("task", "step").agg(F.concat(F.lit(frame[0]), joined, F.lit(frame[1])).alias("payload")).select(
            F.col("task").cast("string").alias("keyword"), F.lit(platform).alias("platform"), "step", F.lit(1).alias("page"), "payload", F.lit(None).cast("string").alias("error")
        )

    one = F.lit(0)
    parts = [pages(json_payloads(spark, sf_dir, p), p, own, one, F.get_json_object("payload", "$.data[0]"), ('{"data": [', "]}"), ",") for p in ("zhihu", "toutiao")]
    parts.append(pages(result_pages(spark, sf_dir, "weibo"), "weibo", own, one, F.col("page"), ("", "")))
    for platform in GROUPED[:3]:
        for i, engine in enumerate(ENGINES[:2]):
            found = result_pages(spark, sf_dir, engine, F.lit(FALLBACK_DOMAINS[platform][0]))
            parts.append(pages(found, platform, ~own & (F.pmod(at, F.lit(2)) == i), F.lit(i + 1), F.col("page"), ("", "")))
    entry = F.regexp_extract("feed", "(?s)<channel>(.*)</channel>", 1)
    search = F.when(at < some + 5, 0).when(at < some + 8, 1).otherwise(2)
    parts.append(pages(feeds(spark, sf_dir), "sitenews", F.lit(True), search, entry, ("<rss><channel>", "</channel></rss>")))
    names = F.element_at(F.array(*map(F.lit, GROUPED)), which + 1)
    tasks = documents(spark, sf_dir).select(task.alias("keyword_ix"), task.cast("string").alias("keyword"), which.alias("platform_ix"), names.alias("platform"))
    return reduce(DataFrame.unionByName, parts), tasks.distinct()


CODECS = ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "mac_roman", "cp850", "gb18030", "iso8859_15")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, codec, body: each document in one of eight codecs in turn, in UTF-8 where the codec lacks a character of it."""

    @F.pandas_udf("binary")
    def encode(text: pd.Series, codec: pd.Series) -> pd.Series:
        def one(t, c):
            try:
                return t.encode(c)
            except UnicodeEncodeError:
                return t.encode("utf-8")

        return pd.Series([None if t is None else one(t, c) for t, c in zip(text, codec)])

    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.pmod("doc_id", F.lit(len(CODECS))) + 1).cast("int"))
    d = documents(spark, sf_dir).select("doc_id", "text", codec.alias("codec"))
    return d.select("*", encode("text", "codec").alias("body"))


def feed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document, in RSS 2, RSS 1 and Atom in turn, each with an entry before and one behind the document's own.

    Of every seven, one has a bare ampersand and a bracket, one a field that is not closed, one an entry that is not closed, and one breaks off."""
    d = documents(spark, sf_dir)
    form, harm, n = F.pmod("doc_id", F.lit(3)), F.pmod("doc_id", F.lit(7)), F.col("doc_id").cast("string")
    t, x = _escaped(F.substring("text", 1, 50)), _escaped(F.col("text"))
    bare = F.when(harm == 1, " & < 5 ").otherwise("")
    open_, close = F.element_at(F.array(F.lit("<item>"), F.lit('<item rdf:about="x">'), F.lit("<entry>")), (form + 1).cast("int")), F.when(form == 2, "</entry>").otherwise("</item>")

    def entry(which: str, title, text):
        where = F.concat(F.lit(f"https://f.example/{which}/"), n)
        link = F.when(form == 2, F.concat(F.lit("<link rel='self' href='no'/><link href='"), where, F.lit("'/>"))).otherwise(F.concat(F.lit("<link>"), where, F.lit("</link>")))
        name = F.when(form == 2, "summary").otherwise("description")
        own = which == "own"
        head = F.concat(F.lit("<title>"), title, bare if own else F.lit(""), F.when((harm == 2) & F.lit(own), "").otherwise("</title>"))
        date = F.when(form == 0, "<pubDate>2024-01-02 03:04:05</pubDate>").when(form == 1, "<dc:date>2024-01-02 03:04:05</dc:date>").otherwise("<updated>2024-01-02 03:04:05</updated>")
        end = F.when((harm == 3) & F.lit(own), "").otherwise(close)
        return F.concat(open_, head, link, F.lit("<"), name, F.lit(">"), text, F.lit("</"), name, F.lit(">"), date, end)

    before, own, behind = entry("before", F.lit("Before"), F.lit("b")), entry("own", t, x), entry("behind", F.lit("Behind"), F.lit("c"))
    frame = [F.element_at(F.array(*map(F.lit, v)), (form + 1).cast("int")) for v in (("<?xml version='1.0'?><rss><channel><title>Feed</title>", "<rdf:RDF><channel><title>Feed</title></channel>", "<feed><title>Feed</title>"), ("</channel></rss>", "</rdf:RDF>", "</feed>"))]
    whole = F.concat(frame[0], before, own, behind, frame[1])
    return d.select("doc_id", F.when(harm == 4, F.concat(frame[0], before, own, open_, F.lit("<title>Behi"))).otherwise(whole).alias("feed"))


def event_requests(spark: SparkSession, sf_dir: str) -> Iterator[Request]:
    """One request per user of events: the statuses of its attempts, in order, stand in the url. Three attempts are all that is made."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, (200, 403, 500, 429, 404))), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("status"))
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("n <= 3")
    statuses = F.transform(F.array_sort(F.collect_list(F.struct("n", "status"))), lambda x: x["status"].cast("string"))
    rows = first.groupBy("user_id").agg(F.array_join(statuses, ",").alias("statuses")).orderBy("user_id").toLocalIterator()
    names = list(PLATFORMS)
    return (Request(str(r["user_id"]), names[i % len(names)], 0, 1, f"test:{r['statuses']}/{r['user_id']}") for i, r in enumerate(rows))


def event_transport():
    """Answers a request of event_requests() with its next status, and with the number of the attempt as its text; 500 when there is none left."""
    made: dict[str, int] = {}

    def get(url: str, headers: dict[str, str], timeout: int) -> Answer:
        statuses, n = url.removeprefix("test:").partition("/")[0].split(","), made.get(url, 0)
        status = int(statuses[n]) if n < len(statuses) else 500
        made[url] = 0 if status == 200 or n == 2 else n + 1
        return Answer(status, str(n).encode())

    return get
