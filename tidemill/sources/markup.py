"""Hits in search result pages, by element and class, on the standard library's parser."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Element:
    tag: str
    attrs: dict
    children: list = field(default_factory=list)

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self):
        """All elements below, in page order."""
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)
        return " ".join(parts)

    def first(self, tag: str | None = None, cls: str | None = None, **attrs) -> "Element | None":
        return next((e for e in self.walk() if e.matches(tag, cls, attrs)), None)

    def matches(self, tag: str | None, cls: str | None, attrs: dict) -> bool:
        return (tag is None or self.tag == tag) and (cls is None or cls in self.classes()) and all(self.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items())

    def inside(self, outer: str, inner: str) -> "Element | None":
        """The first `inner` below an `outer`."""
        return next((y for x in self.walk() if x.tag == outer if (y := x.first(inner)) is not None), None)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.open[-1].tag == tag:
            self.open.pop()
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(page: str) -> Element:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def _hit(link: Element, snippet: str) -> dict:
    return {"title": link.text(), "url": link.attrs.get("href", ""), "snippet": snippet, "time": "", "name": ""}


def hits(page: str, engine: str) -> list[dict]:
    out = []
    for e in tree(page).walk():
        cls = e.classes()
        if engine == "bing" and e.tag == "li" and "b_algo" in cls:
            if link := e.inside("h2", "a"):
                out.append(_hit(link, p.text() if (p := e.first("p")) else ""))
        elif engine == "duckduckgo" and "result" in cls:
            if link := e.first("a", "result__a") or e.first("a"):
                out.append(_hit(link, s.text() if (s := e.first(None, "result__snippet")) else ""))
        elif engine == "baidu" and e.tag == "div" and cls & {"result", "c-container"}:
            if link := e.inside("h3", "a") or e.first("a"):
                out.append(_hit(link, e.text()))
        elif engine == "weibo" and e.tag == "div" and "card-wrap" in cls and e.attrs.get("action-type") == "feed_list_item":
            body = e.first("p", "txt", node_type="feed_list_content_full") or e.first("p", "txt", node_type="feed_list_content") or e.first("p", "txt")
            where = next((y for x in e.walk() if x.tag == "div" and "from" in x.classes() if (y := x.first("a")) is not None), None)
            name = e.first("a", "name")
            out.append({"title": "", "url": where.attrs.get("href", "") if where else "", "snippet": body.text() if body else "", "time": where.text() if where else "", "name": name.text() if name else ""})
    return out
