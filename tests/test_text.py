"""Vectors for cleaning, time shapes, URL forms and fallbacks."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as T

TIMES = [
    (None, ""), ("", ""), ("  ", ""), ("1704164645", "2024-01-02 03:04:05"), ("1704164645123", "2024-01-02 03:04:05"), ("20240102030405", "2024-01-02 03:04:05"), ("20241302030405", "20241302030405"),
    ("2026-07-01T10:30:00Z", "2026-07-01T10:30:00Z"), ("2026-7-1T10:30:00Z", "2026-07-01 10:30:00"), ("2026-07-01T10:30:00", "2026-07-01T10:30:00"), ("2026-07-01 10:30:00 +0000", "2026-07-01 10:30:00"),
    ("2026-07-01 10:30:00.123456", "2026-07-01 10:30:00"), ("2026-7-1", "2026-07-01 00:00:00"), ("2026-07-01  1:2:3", "2026-07-01 01:02:03"), ("2026-07-01 10:30", "2026-07-01 10:30"),
    ("2026-02-30", "2026-02-30"), ("2024-02-29", "2024-02-29 00:00:00"), ("2026-07-01 24:00:00", "2026-07-01 24:00:00"), (" junk ", "junk"), ("2026/07/01", "2026/07/01"),
]
CLEAN = [
    (None, ""), ("&lt;b&gt;x", "x"), ("校园<em>舆情</em>", "校园 舆情"), ("a < b > c", "a c"), ("<>", "<>"), ("&amp;lt;", "&lt;"), ("&ampfoo", "&foo"), ("&#128;", "€"),
    ("a  b\x1cc", "a b c"), ("x<a\nb>y", "x y"), (" \t\n", ""),
]


def run(spark, cases, f):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_times(spark):
    assert run(spark, TIMES, T.normalize_time) == [c[1] for c in TIMES]


def test_epochs_are_shown_in_a_zone(spark):
    assert run(spark, [("1704164645",), ("2024-01-02 03:04:05",)], lambda c: T.normalize_time(c, "Asia/Shanghai")) == ["2024-01-02 11:04:05", "2024-01-02 03:04:05"]


def test_lenient_time(spark):
    cases = [("2026-07-01T10:30:00Z",), ("20260701T103000Z",), ("Wed, 01 Jul 2026 10:30:00 +0000",), ("Wed, 01 Jul 2026 10:30:00 GMT",), ("no",)]
    got = run(spark, cases, lambda c: T.lenient_time(c).cast("string"))
    assert got == ["2026-07-01 10:30:00"] * 4 + [None]


def test_clean(spark):
    assert run(spark, CLEAN, T.clean_text) == [c[1] for c in CLEAN]


def test_light_strip(spark):
    cases = [("a<b>c", "a c"), ("a<b\nc>d", "a<b c>d"), ("<>x", "x"), ("&lt;", "&lt;")]
    assert run(spark, cases, T.light_strip) == [c[1] for c in cases]


@pytest.mark.parametrize(("url", "host"), [("https://User@A.Com:80/x", "User@A.Com:80"), ("//h/p", "h"), ("/p", ""), (None, ""), ("x", "")])
def test_netloc(spark, url, host):
    assert run(spark, [(url,)], T.netloc) == [host]


def test_domains_are_substrings(spark):
    cases = [("https://notweibo.com/", True), ("https://x.y/?u=weibo.com", True), ("https://x.y/", False), (None, False)]
    for domains in ([" Weibo.com ", ""], F.array(F.lit(" Weibo.com "), F.lit(""))):
        assert run(spark, cases, lambda c, d=domains: T.domain_hit(c, d)) == [c[1] for c in cases]


def test_urls(spark):
    cases = [("//a/b", "https://a/b"), ("/a/../b", "https://weibo.com/b"), ("https://c/../d", "https://c/../d"), (None, "")]
    assert run(spark, cases, lambda c: T.joined_url(c, "https://weibo.com")) == [c[1] for c in cases]


def test_first_truthy(spark):
    got = spark.range(1).select(T.first_truthy(F.lit(""), F.lit(None), F.lit("x"), default="d").alias("a"), T.first_truthy(F.lit(""), default="d").alias("b")).first()
    assert tuple(got) == ("x", "d")


def test_int_list_and_quote(spark):
    assert run(spark, [(" 1,x,,2 ",), (None,)], T.int_list) == [[1, 2], []]
    assert run(spark, [("a b/c~*",)], T.quote) == ["a%20b/c~%2A"]


def test_paragraphs(spark):
    page = "<script>var t='</p>'</script><nav><p>menu menu menu menu</p></nav><p>one <b>bold<br><p class=x>two</p> loose <p>three"
    assert [x.strip() for x in run(spark, [(page,)], T.paragraphs)[0]] == ["one  bold", "two", "three"]


def test_closed_references(spark):
    cases = [("a&amp<style>b &amp; &copy;", "a&amp b & ©"), ("&ampfoo; &#65; &#x42; &#67 &lt;b&gt;x", "&ampfoo; A B &#67 x"), (None, "")]
    assert run(spark, cases, lambda c: T.clean_text(c, closed=True)) == [c[1] for c in cases]


def test_cleaned_pages_equal_their_sql(spark, tmp_path):
    import duckdb

    from tidemill.plans import catalog

    pages = [(1, "https://a/", "<h1>and&amp</h1><style>p{}</style> &copy; &amp; b"), (2, "https://b/", "x &am <p>&middot;&quot;</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sql = catalog.oracle_sql()["q02_clean_html"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.queries()["q02_clean_html"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duckdb.sql(sql).fetchall())
