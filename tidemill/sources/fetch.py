"""The edge to the network: one request with its retries, pauses, headers and charset. Transport, clock and chance are
parameters, so nothing here needs a network; answers are stored, and all else reads the store."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.control import LEAST_DELAY, LIMITED, LONGEST_WAIT, MOST_DELAY
from .charset import detected

#: Seconds allowed for a request, by what is asked for; attempts after the first.
TIMEOUTS = {"default": 15, "article": 10, "newsapi": 20, "currents": 20, "site_rss": 15}
RETRIES = {"default": 2, "search": 1, "article": 1}
#: Headers of every request.
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Accept-Language": "zh-CN,zh;q=0.9,en;q=0.8",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,application/json;q=0.8,*/*;q=0.7",
    "Connection": "keep-alive",
}


@dataclass
class Answer:
    status: int
    body: bytes
    charset: str | None = None

    def text(self) -> str:
        return repaired(self.body, self.charset)


def request_headers(extra: dict[str, str] | None = None, cookie: str = "") -> dict[str, str]:
    """The defaults, then the call's own, then the cookie; the later wins."""
    return HEADERS | (extra or {}) | ({"Cookie": cookie} if cookie else {})


def header_map(default: Column, extra: Column, cookie: Column) -> Column:
    """request_headers() as a map expression: default, extra: maps (null: none); cookie: text ('' or null: none)."""
    none = F.expr("CAST(map() AS MAP<STRING, STRING>)")
    extra = F.coalesce(extra, none)
    last = F.when(F.coalesce(cookie, F.lit("")) != "", F.create_map(F.lit("Cookie"), cookie)).otherwise(none)
    first = F.map_filter(F.coalesce(default, none), lambda k, _: ~F.map_contains_key(extra, k) & ~F.map_contains_key(last, k))
    return F.map_concat(first, F.map_filter(extra, lambda k, _: ~F.map_contains_key(last, k)), last)


@functools.cache
def session(factory: Callable[[], Any]) -> Any:
    """One per Python worker and factory, so that its connections are used again."""
    return factory()


#: Platforms whose requests carry a cookie.
COOKIES = ("weibo", "zhihu", "toutiao", "xiaohongshu")


class Limiter:
    """Pauses a random time between two bounds, times a factor."""

    def __init__(self, sleep: Callable[[float], None] = time.sleep, chance: random.Random | None = None) -> None:
        self.sleep, self.chance = sleep, chance or random.Random()

    def pause(self, factor: float = 1.0) -> float:
        t = self.chance.uniform(LEAST_DELAY, MOST_DELAY) * factor
        self.sleep(t)
        return t

    def wait(self, attempt: int) -> float:
        """After a limited answer to attempt 0, 1, ..."""
        t = min(LONGEST_WAIT, 3 * (attempt + 1) + 3 * self.chance.random())
        self.sleep(t)
        return t


def safe_get(get: Callable[..., Answer], url: str, limiter: Limiter, headers: dict[str, str], retries: int = RETRIES["default"], timeout: int = TIMEOUTS["default"]) -> Answer | None:
    """The first answer of class 2xx in retries + 1 attempts, or None; no attempt's failure is raised."""
    for attempt in range(retries + 1):
        limiter.pause(1 + attempt)
        try:
            answer = get(url, headers=headers, timeout=timeout)
        except OSError:
            continue
        if answer.status in LIMITED:
            limiter.wait(attempt)
        elif 200 <= answer.status < 300:
            return answer
    return None


def repaired(body: bytes, charset: str | None) -> str:
    """Decoded by its charset; where that is missing, unknown, wrong or only the protocol's default, by the likeliest (charset.py)."""
    named = (charset or "").strip().lower()
    if named and named != "iso-8859-1":
        try:
            return body.decode(named)
        except (LookupError, UnicodeDecodeError):
            pass
    return detected(body)[1]


@F.pandas_udf(StringType())
def _repaired(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else repaired(b, c) for b, c in zip(body, charset)])


def repaired_text(body: Column, charset: Column) -> Column:
    """repaired() of a binary column. UTF-8 without a charset of its own, zero bytes and a mark stays in the JVM; null stays null."""
    text = body.cast("string")
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00")) & ~F.startswith(text, F.lit("\ufeff")) & F.lower(F.coalesce(charset, F.lit(""))).isin("", "iso-8859-1", "utf-8", "utf8")
    return F.coalesce(F.when(plain, body.cast("string")), _repaired(F.when(~plain, body), charset))
