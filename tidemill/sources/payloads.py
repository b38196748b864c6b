"""Stored search answers to records: one plan per connector.

A JSON connector is a schema and a projection. Payloads are parsed with from_json and
exploded with their place, so the order of items survives. Null or misshapen containers
give no rows; with strict=True a payload that lacks its container raises instead.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_url, clean_text, domain_hit, first_truthy, joined_url, label_hit, light_strip, netloc
from ..operators.records import make_record, raw_fields, with_content
from .feeds import entries

#: The shapes of the services' answers.
SCHEMAS = {
    "news": "articles array<struct<title string, url string, domain string, sourceCommonName string, seendate string>>",
    "newsapi": "status string, articles array<struct<source struct<name string>, title string, description string, content string, publishedAt string, url string>>",
    "currents": "status string, news array<struct<title string, description string, author string, published string, url string>>",
    "mediacloud": "stories array<struct<title string, name string, url string, canonical_url string, guid string, publish_date string, published_date string, date string, collect_date string, media_name string, source_name string, media struct<name string>, description string, text string, content string>>",
    "bilibili": "data struct<result array<struct<title string, description string, author string, arcurl string, pubdate bigint>>>",
    "zhihu": "data array<struct<object struct<type string, id string, title string, name string, excerpt string, content string, url string, created_time bigint, updated_time bigint, question struct<id string, name string, title string, url string>>>>",
    "toutiao": "data array<struct<title string, abstract string, description string, source string, media_name string, article_url string, share_url string, display_url string, url string, display_time string, publish_time string, display struct<title string, summary string>>>",
}
ITEMS = {"news": "articles", "newsapi": "articles", "currents": "news", "mediacloud": "stories", "bilibili": "data.result", "zhihu": "data", "toutiao": "data"}


def items(payloads: DataFrame, connector: str, payload: str = "payload", strict: bool = False) -> DataFrame:
    """payloads with item_ix and item: one row per hit."""
    parsed = payloads.withColumn("_p", F.from_json(payload, SCHEMAS[connector]))
    hits = F.col(f"_p.{ITEMS[connector]}")
    if strict:
        hits = F.when(hits.isNull(), F.raise_error(F.lit(f"{connector}: no items"))).otherwise(hits)
    keep = [c for c in payloads.columns if c != payload]
    return parsed.select(*keep, F.posexplode(hits).alias("item_ix", "item"))


def _prefixed(prefix: str, name: Column, alone: str | None = None) -> Column:
    label = F.concat(F.lit(prefix + "-"), name)
    return label if alone is None else F.when(name == "", F.lit(alone)).otherwise(label)


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit(0)).cast("string")


def extract(hits: DataFrame, connector: str, seq: Column | None = None, entities: bool = True, detail: Column | None = None, make=make_record) -> DataFrame:
    """Records (make: make_record, or raw_fields for later) of a connector's items. detail: the text of a news hit's article, which goes before its title."""
    i = lambda name: F.col(f"item.{name}")
    title, text, time, where = first_truthy(i("title")) if connector != "zhihu" else None, None, None, None
    if connector == "news":
        source = first_truthy(i("sourceCommonName"), i("domain"), netloc(i("url")), default="新闻网站")
        text, time, where = title if detail is None else first_truthy(detail, title), i("seendate"), i("url")
    elif connector == "newsapi":
        source = _prefixed("NewsAPI", first_truthy(i("source.name"), default="NewsAPI"))
        text = F.trim(F.concat(first_truthy(i("description")), F.lit(" "), first_truthy(i("content"))))
        time, where = i("publishedAt"), i("url")
    elif connector == "currents":
        source, text, time, where = _prefixed("Currents", first_truthy(i("author"), default="Currents")), first_truthy(i("description")), i("published"), i("url")
    elif connector == "mediacloud":
        title = first_truthy(i("title"), i("name"))
        source = _prefixed("MediaCloud", first_truthy(i("media_name"), i("source_name"), i("media.name"), default="MediaCloud"))
        text = first_truthy(i("description"), i("text"), i("content"), title)
        time = first_truthy(i("publish_date"), i("published_date"), i("date"), i("collect_date"))
        where = first_truthy(i("url"), i("canonical_url"), i("guid"))
    elif connector == "bilibili":
        title, author = clean_text(title, entities), clean_text(i("author"), entities)
        source, text = _prefixed("B站", author, "B站"), first_truthy(clean_text(i("description"), entities), title)
        time, where = i("pubdate").cast("string"), absolute_url(i("arcurl"))
    elif connector == "zhihu":
        o = lambda name: F.col(f"item.object.{name}")
        kind = F.coalesce(o("type"), F.lit(""))
        asked = first_truthy(o("question.name"), o("question.title"), default="知乎回答")
        title = (
            F.when(kind == "answer", asked).when(kind == "article", first_truthy(o("title"), default="知乎文章"))
            .when(kind == "question", first_truthy(o("name"), o("title"), default="知乎问题"))
            .otherwise(first_truthy(o("title"), o("name"), o("excerpt"), default="知乎内容"))
        )
        text = F.when(kind == "question", first_truthy(o("excerpt"), title)).otherwise(first_truthy(o("excerpt"), o("content"), title))
        last = lambda u: F.element_at(F.split(F.regexp_replace(u, "/+$", ""), "/"), -1)
        plain, asked_url = first_truthy(o("url")), first_truthy(o("url"), o("question.url"))
        where = (
            F.when((kind == "answer") & F.contains(asked_url, F.lit("/api/v4/answers/")) & (first_truthy(o("question.id")) != ""),
                   F.concat(F.lit("https://www.zhihu.com/question/"), o("question.id"), F.lit("/answer/"), last(asked_url)))
            .when(kind == "answer", asked_url)
            .when((kind == "article") & F.contains(plain, F.lit("/api/v4/articles/")), F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), last(plain)))
            .when((kind == "question") & (first_truthy(o("id")) != ""), F.concat(F.lit("https://www.zhihu.com/question/"), o("id")))
            .otherwise(plain)
        )
        source, time = F.lit("知乎"), first_truthy(_number(o("created_time")), _number(o("updated_time")))
        title, text = clean_text(title, entities), clean_text(text, entities)
    elif connector == "toutiao":
        title = clean_text(first_truthy(i("title"), i("display.title")), entities)
        body = clean_text(first_truthy(i("abstract"), i("description"), i("display.summary")), entities)
        source = first_truthy(i("source"), i("media_name"), default="今日头条")
        time = first_truthy(i("display_time"), i("publish_time"))
        where = absolute_url(first_truthy(i("article_url"), i("share_url"), i("display_url"), i("url")), "https://www.toutiao.com")
        title, text = first_truthy(title, F.substring(body, 1, 50)), first_truthy(body, title)
    else:
        raise ValueError(f"unknown connector: {connector}")
    out = make(hits, title, text, source, time, where, seq, entities)
    return with_content(out) if connector in ("zhihu", "toutiao") else out


# ------------------------------------------------------------------- HTML

HIT = "array<struct<title string, url string, snippet string, time string, name string>>"


def html_items(pages: DataFrame, engine: str, page: str = "page") -> DataFrame:
    """pages with item_ix and item (HIT's struct); markup is read in Arrow batches."""
    from .markup import hits

    def read(c: pd.Series) -> pd.Series:
        return c.map(lambda p: hits(p or "", engine))

    read = F.pandas_udf(read, HIT)
    keep = [c for c in pages.columns if c != page]
    return pages.select(*keep, F.posexplode(read(F.col(page))).alias("item_ix", "item"))


def search_records(hits: DataFrame, engine: str, platform: str, domains: list[str], seq: Column | None = None, make=make_record) -> DataFrame:
    """Records of a search engine's hits that have a title and a wanted domain; the third engine also takes a domain's label in the text."""
    title, where = clean_text(F.col("item.title")), F.coalesce(F.col("item.url"), F.lit(""))
    snippet = first_truthy(clean_text(F.col("item.snippet")), title)
    wanted = domain_hit(where, domains)
    if engine == "baidu":
        wanted = wanted | label_hit(F.concat(title, snippet), domains)
        snippet = first_truthy(F.substring(snippet, 1, 300), title)
    kept = hits.where((title != "") & wanted)
    return make(kept, title, snippet, F.lit(f"{platform}-搜索索引"), F.lit(""), where, seq)


def weibo_records(hits: DataFrame, seq: Column | None = None, make=make_record) -> DataFrame:
    text, name = clean_text(F.col("item.snippet")), clean_text(F.col("item.name"))
    kept = hits.where(text != "")
    return make(kept, F.substring(text, 1, 50), text, F.when(name == "", "微博").otherwise(F.concat(F.lit("微博-"), name)), clean_text(F.col("item.time")), joined_url(F.col("item.url"), "https://weibo.com"), seq)


# -------------------------------------------------------------------- RSS

ENTRY = "array<struct<title string, summary string, link string, published string, updated string>>"


def rss_items(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """feeds with item_ix and item: one row per entry of an RSS 1, RSS 2 or Atom document; a damaged one gives those around the damage."""


    def read(c: pd.Series) -> pd.Series:
        return c.map(entries)

    keep = [c for c in feeds.columns if c != feed]
    return feeds.select(*keep, F.posexplode(F.pandas_udf(read, ENTRY)(F.col(feed))).alias("item_ix", "item"))


def rss_records(hits: DataFrame, source: Column, light: bool = False, seq: Column | None = None, entities: bool = True, make=make_record) -> DataFrame:
    """Records of feed entries; `light` strips markup first, as the site search does."""
    i = lambda name: F.col(f"item.{name}")
    title = first_truthy(i("title"))
    text = first_truthy(i("summary"), title)
    if light:
        title, text = light_strip(title), light_strip(text)
    own = F.struct(title.alias("title"), text.alias("text"))
    some = hits.withColumn("_own", F.explode(F.filter(F.array(own), lambda x: (x["title"] != "") | (x["text"] != ""))))
    return make(some, F.col("_own.title"), F.col("_own.text"), source, first_truthy(i("published"), i("updated")), first_truthy(i("link")), seq, entities)
