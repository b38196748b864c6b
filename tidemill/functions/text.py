"""Column functions: cleaning, time shapes, fingerprints, truthy fallbacks and URL forms.

All but character references are built-in expressions; those take an Arrow UDF whose
argument is null for texts without '&', so that other rows cost nothing.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Java's Unicode class misses four of the separators that count as white space here.
SPACE = r"(?U)[\s\x1c-\x1f]"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _unescaped_reference(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" else html5.get(found[0][1:], found[0])


@F.pandas_udf(StringType())
def _unescaped_closed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _CLOSED.sub(_unescaped_reference, t), na_action="ignore")


def kept(df: DataFrame, keep) -> DataFrame:
    """Rows for which keep(row) holds; keep takes a struct of the columns.

    A plain filter on computed columns is pushed below them, and they are computed a second time for it, Python
    functions included. Here the row is made first and then kept or left out."""
    row = F.struct(*df.columns)
    return df.select(F.explode(F.filter(F.array(row), keep)).alias("_row")).select("_row.*")


def unescape(c: Column, closed: bool = False) -> Column:
    """Character references as characters; with closed only those that end in a semicolon."""
    return F.coalesce((_unescaped_closed if closed else _unescaped)(F.when(F.contains(c, F.lit("&")), c)), c)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def clean_text(c: Column, entities: bool = True, closed: bool = False) -> Column:
    """One pass: character references (with closed only those that end in a semicolon), then tags to spaces, then white space. Null gives ''."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return squeeze(F.regexp_replace(unescape(c, closed) if entities else c, "<[^>]+>", " "))


def light_strip(c: Column) -> Column:
    """Tags that do not span lines, and white space; references stay."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^\n]*?>", " "))


def first_truthy(*columns: Column, default: str = "") -> Column:
    """The first value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(default))


def _zoned(instant: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, tz), "yyyy-MM-dd HH:mm:ss")


def epoch_seconds(n: Column, tz: str = "UTC") -> Column:
    """Epoch seconds as text; out of the years 1 to 9999, the number itself."""
    whole = n.cast("long")
    return F.when(whole.between(-62135596800, 253402300799), _zoned(F.timestamp_seconds(whole), tz)).otherwise(n.cast("string"))


#: Shapes and parsers of the texts that are read in their first 19 characters.
_FORMS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}Z$", "yyyy-M-d'T'H:m:s'Z'"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "yyyy-M-d H:m:s"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
)


def normalize_time(c: Column, tz: str = "UTC") -> Column:
    """Text to 'yyyy-MM-dd HH:mm:ss' where its shape is known, else the text without outer white space.

    Epochs of 10 digits (seconds) and 13 (milliseconds) are shown in `tz`; the rest has no zone.
    Only the first 19 characters of dashed forms are read, so an offset or fraction is dropped
    and a full ISO form that ends in Z stays as it is."""
    raw = F.coalesce(c.cast("string"), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(raw, f"^{SPACE}+", ""), f"{SPACE}+$", "")
    head = F.regexp_replace(F.substring(s, 1, 19), f"{SPACE}+", " ")
    out = F.when(s == "", F.lit(""))
    out = out.when(s.rlike("^[0-9]{10}$"), epoch_seconds(F.expr("1") * 0 + s.try_cast("long"), tz))
    out = out.when(s.rlike("^[0-9]{13}$"), _zoned(F.timestamp_seconds(F.floor(s.try_cast("long") / 1000)), tz))
    out = out.when(s.rlike("^[0-9]{14}$"), F.coalesce(_parsed(s, "yyyyMMddHHmmss"), s))
    for shape, form in _FORMS:
        out = out.when(head.rlike(shape), F.coalesce(_parsed(head, form), s))
    return out.otherwise(s)


def _parsed(c: Column, form: str) -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit(form)), "yyyy-MM-dd HH:mm:ss")


def lenient_time(c: Column, tz: str = "UTC") -> Column:
    """A timestamp from more shapes (ISO with Z, compact ISO, RFC 822); null when none fits."""
    plain = F.try_to_timestamp(normalize_time(c, tz), F.lit("yyyy-MM-dd HH:mm:ss"))
    s = F.trim(c.cast("string"))
    more = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyyMMdd'T'HHmmssX", "yyyy-MM-dd'T'HH:mm:ss")]
    rfc = F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    rfc = F.coalesce(rfc, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3}, *", ""), "GMT$|UTC$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(plain, *more, rfc)


def fingerprint(title: Column, text: Column, source: Column, url: Column) -> Column:
    """md5 of the first 80 characters of the title, the first 120 of the text, source and url; nulls count as ''."""
    parts = [F.coalesce(c, F.lit("")) for c in (F.substring(title, 1, 80), F.substring(text, 1, 120), source, url)]
    return F.md5(F.concat_ws("|", *parts))


def netloc(url: Column) -> Column:
    """Host part with case and port, '' without '//'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def _some(domains: Column | list[str], low: Column, whole: bool) -> Column:
    """Whether a domain, or its first label, occurs. A list of names becomes plain conditions, which may stand beside Python UDFs."""
    if isinstance(domains, list):
        names = [d.strip().lower() if whole else d.split(".")[0] for d in domains]
        out = F.lit(False)
        for n in names:
            out = out | F.contains(low, F.lit(n)) if n or not whole else out
        return out
    if whole:
        return F.exists(domains, lambda d: (F.trim(d) != "") & F.contains(low, F.lower(F.trim(d))))
    return F.exists(domains, lambda d: F.contains(low, F.split_part(d, F.lit("."), F.lit(1))))


def domain_hit(url: Column, domains: Column | list[str]) -> Column:
    """A domain occurs in the url, in any case; blank domains never do."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return (low != "") & _some(domains, low, True)


def label_hit(text: Column, domains: Column | list[str]) -> Column:
    """The first label of a domain occurs in the text, in any case of the text."""
    return _some(domains, F.lower(text), False)


def absolute_url(url: Column, site: str = "") -> Column:
    """'//host' gets https; '/path' gets the site, if there is one; null gives ''."""
    url = F.coalesce(url, F.lit(""))
    out = F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
    if site:
        out = out.when(url.startswith("/"), F.concat(F.lit(site), url))
    return out.otherwise(url)


@F.pandas_udf(StringType())
def _without_dots(url: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    return url.map(lambda u: urljoin(u, u[u.index("/", 8) :]), na_action="ignore")


def joined_url(url: Column, site: str) -> Column:
    """As absolute_url, with dot segments of '/path' resolved."""
    whole = absolute_url(url, site)
    dots = F.coalesce(url, F.lit("")).rlike(r"^/(?!/)(?:.*/)?\.\.?(?:/|$)")
    return F.coalesce(_without_dots(F.when(dots, whole)), whole)


def quote(c: Column) -> Column:
    """Percent-encoding with '/' safe and '%20' for a space."""
    c = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.replace(F.replace(c, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def site_query(keyword: Column, domains: Column) -> Column:
    """'(site:a OR site:b) keyword'."""
    return F.concat(F.lit("("), F.array_join(F.transform(domains, lambda d: F.concat(F.lit("site:"), d)), " OR "), F.lit(") "), keyword)


def int_list(c: Column, default: tuple[int, ...] = ()) -> Column:
    """Whole numbers of a comma-separated text; blanks and others are left out. With none, the default."""
    found = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("bigint"))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(x).cast("bigint") for x in default])) if default else found


#: Elements removed before paragraphs are read, and the paragraph rule.
REMOVED = ("script", "style", "noscript", "header", "footer", "nav", "aside")
LEAST_PARAGRAPH, MOST_ARTICLE = 15, 1500


def paragraphs(page: Column) -> Column:
    """Cleaned paragraphs of at least LEAST_PARAGRAPH characters; one ends at the next, at its end tag, or with the page."""
    page = F.coalesce(page, F.lit(""))
    for tag in REMOVED:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "")
    page = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(page, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=<p[\s>]|</p\s*>|\z)"), 1)
    # markup goes first, so that a reference cannot become a tag
    return F.transform(found, lambda p: F.regexp_replace(p, "<[^>]+>", " "))


@F.pandas_udf(ArrayType(StringType()))
def _unescaped_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [html.unescape(t) if "&" in t else t for t in x], na_action="ignore")


def clean_paragraphs(page: Column) -> Column:
    """The page's paragraphs, cleaned, those of at least LEAST_PARAGRAPH characters, as an array in page order."""
    # all arrays pass the UDF: to leave some out, the paragraphs would be searched for twice
    return F.filter(F.transform(_unescaped_each(paragraphs(page)), lambda p: clean_text(p, False)), lambda p: F.length(p) >= LEAST_PARAGRAPH)


def article_text(page: Column) -> Column:
    """The first MOST_ARTICLE characters of the page's paragraphs; '' where there are none."""
    return F.substring(F.trim(F.array_join(clean_paragraphs(page), " ")), 1, MOST_ARTICLE)
