"""Entries of RSS 1, RSS 2 and Atom feeds, damaged ones included: a small helper for the feed connector's Arrow function.

A feed is read as tokens, not as a tree, so damage costs what it touches and nothing behind it: an ampersand or
bracket that is no reference or tag is text, a field that is not closed ends where the next field or entry
begins, an entry that is not closed ends where the next one begins or the feed ends."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>|<(?P<close>/?)(?P<name>[A-Za-z_][\w.:-]*)(?P<attributes>(?:[^<>"']|"[^"<]*"|'[^'<]*')*?)(?P<alone>/?)>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")

#: Elements of an entry, by what they are taken for; with a prefix where feeds use one.
FIELDS = {
    "title": "title", "atom:title": "title", "description": "summary", "summary": "summary", "atom:summary": "summary", "content": "content", "atom:content": "content", "content:encoded": "content",
    "link": "link", "atom:link": "link", "guid": "guid", "pubdate": "published", "published": "published", "atom:published": "published", "issued": "published",
    "updated": "updated", "atom:updated": "updated", "modified": "updated", "dc:date": "updated",
}
ENTRIES = ("item", "rss:item", "entry", "atom:entry")
#: Parts of an entry that tell of something else and have fields of the same names.
ELSEWHERE = ("source", "atom:source", "author", "atom:author", "contributor", "image", "media:group")


class _Entry:
    def __init__(self) -> None:
        self.found: dict[str, str] = {}
        self.field: str | None = None
        self.tag, self.text, self.inside = "", [], ""

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        self.close()
        self.field, self.tag, self.text = FIELDS[tag], tag, []
        if self.field == "guid" and attributes.get("ispermalink", "true").lower() == "false":
            self.field = "id"

    def close(self) -> None:
        """The first element of a kind counts."""
        if self.field is not None:
            text = "".join(self.text).strip()
            if text:
                self.found.setdefault(self.field, text)
        self.field, self.text = None, []

    def fields(self) -> dict[str, str | None]:
        f = self.found
        return {"title": f.get("title"), "summary": f.get("summary") or f.get("content"), "link": f.get("link") or f.get("guid"), "published": f.get("published"), "updated": f.get("updated")}


def entries(feed: str | None) -> list[dict[str, str | None]]:
    """title, summary, link, published, updated of each entry, in order; null where an entry has none."""
    out: list[dict[str, str | None]] = []
    entry: _Entry | None = None
    feed, at = feed or "", 0

    def over() -> None:
        nonlocal entry
        if entry is not None:
            entry.close()
            out.append(entry.fields())
        entry = None

    for token in TOKEN.finditer(feed):
        if entry is not None and entry.field is not None and token.start() > at:
            entry.text.append(html.unescape(feed[at : token.start()]))
        at = token.end()
        raw, name = token["raw"], token["name"]
        if name is None:
            if raw is not None and entry is not None and entry.field is not None:
                entry.text.append(raw)
            continue
        tag = name.lower()
        if tag in ENTRIES:
            over()
            if not token["close"]:
                entry = _Entry()
                if token["alone"]:
                    over()
            continue
        if entry is None:
            continue
        if entry.inside:
            if token["close"] and tag == entry.inside:
                entry.inside = ""
            continue
        if token["close"]:
            if entry.field is not None and tag == entry.tag:
                entry.close()
            elif entry.field is not None:
                entry.text.append(token[0])
            continue
        attributes = {k.lower(): html.unescape(a or b) for k, a, b in ATTRIBUTE.findall(token["attributes"])}
        if tag in FIELDS and entry.field != "content":  # content may be markup that has such elements of its own
            if FIELDS[tag] == "link" and "href" in attributes:
                entry.close()
                if attributes.get("rel", "alternate") == "alternate":
                    entry.found.setdefault("link", attributes["href"].strip())
                continue
            entry.open(tag, attributes)
            if token["alone"]:
                entry.close()
        elif tag in ELSEWHERE and entry.field is None:
            entry.inside = "" if token["alone"] else tag
        elif entry.field is not None:
            entry.text.append(token[0])
    if entry is not None and entry.field is not None:
        entry.text.append(html.unescape(feed[at:]))
    over()
    return out
