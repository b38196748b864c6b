"""A small HTML tokenizer and block tree.

Elements that start blocks are nodes; inline elements are part of the run of text they
stand in. Each run of inline text is a leaf, named '#text'. The tree is closed as browsers
do in the cases that matter for text: a block start ends an open paragraph, a list item,
table cell or row or option ends its open sibling, and an end tag closes whatever is open
inside the element it names. Unclosed elements end with the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is never text of the page.
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "button", "head", "title"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"ul", "ol", "menu", "dl", "table", "div", "section", "article", "main", "body", "html"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    text: str = ""
    linked: int = 0


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; node 0 is the root."""
    nodes = [Node("#root", -1)]
    open_: list[tuple[str, int]] = [("#root", 0)]
    run: list[str] = []
    links, linked, at = 0, 0, 0

    def end_run() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            nodes.append(Node("#text", open_[-1][1], text=text, linked=min(linked, len(text))))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        run.append(text)
        if links:
            linked += len(text.strip())

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] == tag:
                        end_run()
                        del open_[i:]
                        break
            continue
        if tag in SKIPPED and not m.group(3).rstrip().endswith("/"):
            if tag not in RAW and tag != "head":
                depth = 1
                for e in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
                    depth += -1 if e.group(1) else 1
                    if not depth:
                        break
                at = e.end() if not depth else n
            else:
                e = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if e:
                    at = e.end()
                elif tag == "head":
                    e = re.compile(r"<body\b", re.I).search(page, at)
                    at = e.start() if e else at
                else:
                    at = n
            run.append(" ")
            continue
        if tag == "a":
            links += 1
        elif tag == "br" or tag in ("img", "wbr", "input"):
            run.append(" " if tag != "wbr" else "")
        if tag in BLOCK:
            end_run()
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == "p":
                    del open_[i:]
                    break
                if open_[i][0] in FENCES:
                    break
            if tag in SIBLINGS:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] in SIBLINGS[tag]:
                        del open_[i:]
                        break
                    if open_[i][0] in FENCES:
                        break
            if tag == "hr":
                continue
            names = " ".join(x for a in ATTRIBUTE.finditer(m.group(3)) for x in a.groups()[1:] if x).lower() if m.group(3) else ""
            nodes.append(Node(tag, open_[-1][1], names))
            open_.append((tag, len(nodes) - 1))
    end_run()
    return nodes
