"""What to collect: keywords, platforms, pages; and the fixed tables behind it."""

from __future__ import annotations

import argparse
import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quote, site_query
from ..operators.records import START_ID

#: Platforms in order, and their display names.
PLATFORMS = {
    "news": "新闻", "newsapi": "NewsAPI新闻", "currents": "Currents新闻", "mediacloud": "MediaCloud新闻", "rssnews": "RSS新闻聚合", "sitenews": "指定媒体新闻",
    "weibo": "微博", "bilibili": "B站", "zhihu": "知乎", "toutiao": "今日头条", "xiaohongshu": "小红书",
}
KEYWORDS = ("校园舆情", "网络舆情")
#: Target media and their domains, in order of importance; how many are searched at strength 1, 2, 3.
MEDIA = (
    ("人民网", "people.com.cn"), ("央视网", "cctv.com"), ("央视新闻", "news.cctv.com"), ("中国新闻网", "chinanews.com.cn"), ("澎湃新闻", "thepaper.cn"), ("腾讯新闻", "qq.com"),
    ("新浪新闻", "sina.com.cn"), ("网易新闻", "163.com"), ("环球网", "huanqiu.com"), ("中国青年网", "youth.cn"), ("光明网", "gmw.cn"), ("中国网", "china.com.cn"),
)
TIERS = (6, 10, 12)
#: Domains searched when a platform's own results are few.
FALLBACK_DOMAINS = {
    "weibo": ("weibo.com", "m.weibo.cn", "s.weibo.com"), "zhihu": ("zhihu.com", "zhuanlan.zhihu.com"),
    "toutiao": ("toutiao.com", "www.toutiao.com"), "xiaohongshu": ("xiaohongshu.com", "www.xiaohongshu.com"),
}
#: First offset and step of each paged service, and the most pages asked for.
OFFSETS = {"bing": (1, 10), "duckduckgo": (0, 30), "baidu": (0, 10), "zhihu": (0, 20), "toutiao": (0, 20)}
PAGE_CAPS = {"news": 1, "newsapi": 5, "currents": 5, "mediacloud": 3, "rssnews": 1, "sitenews": 1}
#: Hits of a full page; hits asked of the service that has one page, for each page of the plan and at most.
FULL_PAGE = {"newsapi": 100, "currents": 20}
NEWS_PER_PAGE, NEWS_MOST = 30, 100
#: Days that a search looks back; the collection searched where none is set.
DAYS_BACK = {"newsapi": 29, "mediacloud": 365}
COLLECTIONS = (34412234,)
#: Engines of the site search, in order; feeds of the aggregated news; the searches for one media site.
ENGINES = ("bing", "duckduckgo", "baidu")
FEEDS = ("BingNewsRSS", "GoogleNewsRSS")
SITE_SEARCHES = ("Google站内索引", "Google媒体索引", "Bing媒体索引")
#: Names of environment variables that hold credentials.
CREDENTIALS = {
    "weibo": "WEIBO_COOKIE", "zhihu": "ZHIHU_COOKIE", "toutiao": "TOUTIAO_COOKIE", "xiaohongshu": "XHS_COOKIE",
    "newsapi": "NEWSAPI_KEY", "currents": "CURRENTS_API_KEY", "mediacloud": "MEDIACLOUD_API_KEY",
}


@dataclass(frozen=True)
class CollectSpec:
    keywords: tuple[str, ...] = KEYWORDS
    pages: int = 3
    platforms: tuple[str, ...] = tuple(PLATFORMS)
    fetch_news_detail: bool = False
    start_id: int = START_ID
    output_prefix: str = "raw_data"
    reset: bool = False

    def __post_init__(self) -> None:
        unknown = [p for p in self.platforms if p not in PLATFORMS]
        if unknown:
            raise ValueError(f"unknown platforms: {unknown}")


def parse(argv: list[str] | None = None) -> CollectSpec:
    """A specification from command line words."""
    d, p = CollectSpec(), argparse.ArgumentParser(prog="tidemill collect")
    p.add_argument("--keywords", nargs="+", default=list(d.keywords))
    p.add_argument("--pages", type=int, default=d.pages)
    p.add_argument("--platforms", nargs="+", default=list(d.platforms), choices=list(PLATFORMS))
    p.add_argument("--fetch-news-detail", action="store_true")
    p.add_argument("--start-id", type=int, default=d.start_id)
    p.add_argument("--output-prefix", default=d.output_prefix)
    p.add_argument("--reset", action="store_true")
    a = p.parse_args(argv)
    return CollectSpec(tuple(a.keywords), a.pages, tuple(a.platforms), a.fetch_news_detail, a.start_id, a.output_prefix, a.reset)


def options(spec: CollectSpec, platform: str) -> dict[str, object]:
    """What a connector is called with: all get their pages, one also whether to read articles."""
    own: dict[str, object] = {"pages": min(spec.pages, PAGE_CAPS.get(platform, spec.pages))}
    if platform == "news":
        own |= {"fetch_detail": spec.fetch_news_detail, "hits": min(spec.pages * NEWS_PER_PAGE, NEWS_MOST)}
    if platform == "sitenews":
        own["sites"] = TIERS[min(max(spec.pages, 1), len(TIERS)) - 1]
    return own


def date_window(platform: str, as_of: datetime.date, days: int | None = None) -> tuple[datetime.date, datetime.date]:
    """First and last day that a search covers, as seen on the day given."""
    return as_of - datetime.timedelta(days=DAYS_BACK[platform] if days is None else days), as_of


def directory_ids(collections: str = "", sources: str = "") -> tuple[list[int], list[int]]:
    """Ids of collections and sources to search, from comma-separated settings: sources, where set, go before collections."""

    def ids(text: str) -> list[int]:
        return [int(x) for part in text.split(",") if (x := part.strip()) and x.lstrip("+-").isdigit()]

    wanted = ids(sources)
    return ([] if wanted else ids(collections) or list(COLLECTIONS)), wanted


def credential(platform: str, env: dict[str, str]) -> str:
    """'' where the platform has none or the variable is unset."""
    return env.get(CREDENTIALS.get(platform, ""), "").strip()


def option_columns(pages: Column, platform: Column) -> dict[str, Column]:
    """options() as columns, for many plans at once: asked (pages), hits and sites (null where a platform has none)."""
    caps = F.create_map(*[F.lit(x) for pair in PAGE_CAPS.items() for x in pair])
    return {
        "asked": F.least(pages, F.coalesce(caps[platform].cast("long"), pages)),
        "hits": F.when(platform == "news", F.least(pages * NEWS_PER_PAGE, F.lit(NEWS_MOST).cast("long"))),
        "sites": F.when(platform == "sitenews", tier(pages).cast("long")),
    }


def tier(strength: Column) -> Column:
    """How many media sites are searched at this strength."""
    return F.element_at(F.array(*map(F.lit, TIERS)), F.least(F.greatest(strength, F.lit(1)), F.lit(len(TIERS))).cast("int"))


def page_offset(service: Column, page: Column) -> Column:
    """Where a page of a service begins; null for a service that is not paged."""
    base, step = (F.create_map(*[F.lit(x) for k, v in OFFSETS.items() for x in (k, v[i])]) for i in (0, 1))
    return base[service] + (page - 1) * step[service]


def tasks(spark: SparkSession, spec: CollectSpec, words: DataFrame | None = None) -> DataFrame:
    """keyword_ix, keyword, platform_ix, platform, label, in order of collection. words: keyword_ix, keyword, instead of the spec's own."""
    words = spark.createDataFrame(list(enumerate(spec.keywords)), "keyword_ix int, keyword string") if words is None else words
    names = F.array(*[F.struct(F.lit(i).alias("platform_ix"), F.lit(p).alias("platform"), F.lit(PLATFORMS.get(p, p)).alias("label")) for i, p in enumerate(spec.platforms)])
    return words.withColumn("p", F.explode(names)).select("keyword_ix", "keyword", "p.*")


def offsets(spark: SparkSession, pages: int) -> DataFrame:
    """service, page, first: where each page of each service begins."""
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in OFFSETS.items()], "service string, base int, step int")
    return rows.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages)))).select("service", "page", (F.col("base") + (F.col("page") - 1) * F.col("step")).alias("first"))


def media(spark: SparkSession, strength: int) -> DataFrame:
    n = TIERS[min(max(strength, 1), len(TIERS)) - 1]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(MEDIA) if i < n], "ord int, media string, domain string")


def google_news_rss(query):
    return F.concat(F.lit("https://news.google.com/rss/search?q="), quote(query), F.lit("&hl=zh-CN&gl=CN&ceid=CN:zh-Hans"))


def bing_news_rss(query):
    return F.concat(F.lit("https://www.bing.com/news/search?q="), quote(query), F.lit("&format=rss&cc=cn"))


def search_query(keyword: Column, platform: Column) -> Column:
    """What the search engines are asked for a platform's sites; null for a platform without a fallback."""
    domains = F.create_map(*[x for k, v in FALLBACK_DOMAINS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return site_query(keyword, domains[platform])


def search_queries(spark: SparkSession, spec: CollectSpec) -> DataFrame:
    """keyword, platform, query: what the search engines are asked for each fallback platform."""
    found = tasks(spark, spec).where(F.col("platform").isin(*FALLBACK_DOMAINS))
    return found.select("keyword", "platform", search_query(F.col("keyword"), F.col("platform")).alias("query"))
