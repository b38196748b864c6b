"""Main text of web pages by a tree-structured graphical model.

Every node of a page's block tree (dom.py) has a hidden state: it holds main text, or it does
not. A node's own evidence (tag, words in class, id and role, amount of text, share of linked
text, sentence ends) gives a log-odds; parent and child states are tied by potentials. Messages
go from the leaves to the root and back (sum-product), which is exact on a tree, and a run of
text is kept when its marginal for main text is above one half.

Both are learnt from labelled pages: node log-odds by logistic regression, potentials from counts
of parent and child states, as pointwise mutual information. The labelled pages are made by
rule below (fixed number and seed), because the corpus has none: an article of headings,
paragraphs, lists, quotes and tables in one of several wrappers, among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments.

The text of a page is its kept runs in page order, one per line, with character references
decoded and white space inside a run made one space. Null, empty or text-free html gives the
empty string. Pages are independent: repeated rows give repeated results, an empty table none.
Only page_id, url and html are read.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Node, parse

TRAINING_PAGES, SEED = 600, 5

#: Words in class, id and role that speak for or against main text.
AGAINST = (
    "nav menu sidebar side aside footer foot header masthead comment comments respond reply replies discussion disqus ad ads advert adverts advertisement sponsor sponsored promo promotion banner "
    "cookie cookies consent notice alert popup modal overlay share social related recommended more subscribe subscription newsletter signup login search breadcrumb breadcrumbs pagination pager "
    "widget toolbar copyright legal skip tags tag-list meta byline navigation complementary contentinfo form dialog"
).split()
FOR = "article content post entry story main body text prose".split()
TAGS = ("#root #text html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption nav header footer aside form address details menu").split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_SPLIT = re.compile("[^a-z]+")
N_TAG = len(TAGS) + 1
SIZES = (0, 3, 8, 20, 60)
FEATURES = 2 * N_TAG + 3 + 2 * (len(SIZES) + 1) + 2 * 5 + 3


def evidence(nodes: list[Node]) -> list[list[int]]:
    """The features of each node, as numbers below FEATURES."""
    n = len(nodes)
    chars, linked, words = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.text:
            chars[i], linked[i], words[i] = len(x.text), x.linked, x.text.count(" ") + 1
        if x.parent >= 0:
            chars[x.parent] += chars[i]
            linked[x.parent] += linked[i]
            words[x.parent] += words[i]
    out = []
    for i, x in enumerate(nodes):
        leaf = x.tag == "#text"
        f = [_TAG.get(x.tag, N_TAG - 1)]
        if x.parent >= 0:
            f.append(N_TAG + _TAG.get(nodes[x.parent].tag, N_TAG - 1))
        at = 2 * N_TAG
        if x.names:
            said = set(_SPLIT.split(x.names))
            if said & _AGAINST:
                f.append(at)
            elif said & _FOR:
                f.append(at + 1)
            else:
                f.append(at + 2)
        at += 3
        size = sum(words[i] > s for s in SIZES)
        f.append(at + leaf * (len(SIZES) + 1) + size)
        at += 2 * (len(SIZES) + 1)
        share = linked[i] / chars[i] if chars[i] else 0.0
        f.append(at + leaf * 5 + (0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.5 else 3 if share < 0.9 else 4))
        at += 10
        if leaf:
            f.append(at + (0 if x.text[-1] in ".!?…:;\"”»" else 1))
            if "©" in x.text:
                f.append(at + 2)
        out.append(f)
    return out


_AGAINST, _FOR = set(AGAINST), set(FOR)


class TreeModel:
    """weights: log-odds per feature; pair[leaf][parent state][child state]: log potentials."""

    def __init__(self, weights: list[float], pair: list[list[list[float]]]) -> None:
        self.weights, self.pair = weights, pair

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of main text for each node, by messages to the root and back."""
        n, w = len(nodes), self.weights
        own0, own1 = [0.0] * n, [sum(w[k] for k in f) for f in evidence(nodes)]
        up0, up1, sent0, sent1 = own0[:], own1[:], [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            p = self.pair[nodes[i].tag == "#text"]
            sent0[i] = _add(p[0][0] + up0[i], p[0][1] + up1[i])
            sent1[i] = _add(p[1][0] + up0[i], p[1][1] + up1[i])
            up0[nodes[i].parent] += sent0[i]
            up1[nodes[i].parent] += sent1[i]
        all0, all1 = up0[:], up1[:]
        for i in range(1, n):
            q, p = nodes[i].parent, self.pair[nodes[i].tag == "#text"]
            rest0, rest1 = all0[q] - sent0[i], all1[q] - sent1[i]
            all0[i] += _add(rest0 + p[0][0], rest1 + p[1][0])
            all1[i] += _add(rest0 + p[0][1], rest1 + p[1][1])
        return [1 / (1 + math.exp(min(700.0, max(-700.0, a - b)))) for a, b in zip(all0, all1)]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        if len(nodes) == 1:
            return ""
        m = self.marginals(nodes)
        return "\n".join(x.text for x, p in zip(nodes, m) if x.text and p > 0.5)

    @classmethod
    def fit(cls, labelled: list[tuple[list[Node], list[int]]], rounds: int = 400) -> "TreeModel":
        rows, y, pair = [], [], np.ones((2, 2, 2))
        for nodes, labels in labelled:
            rows += evidence(nodes)
            y += labels
            for i in range(1, len(nodes)):
                pair[int(nodes[i].tag == "#text"), labels[nodes[i].parent], labels[i]] += 1
        x = np.zeros((len(rows), FEATURES))
        for i, f in enumerate(rows):
            x[i, f] = 1
        y, w = np.array(y, float), np.zeros(FEATURES)
        step = np.full(FEATURES, 1e-6)
        for _ in range(rounds):  # logistic regression with a small ridge
            g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-4 * w
            step += g * g
            w -= 0.5 * g / np.sqrt(step)
        joint = pair / pair.sum((1, 2), keepdims=True)
        pmi = np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))
        return cls(w.tolist(), pmi.tolist())


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


# ------------------------------------------------------------ labelled pages

KEPT, LEFT = "\ue000", "\ue001"
"""Stand at the head of each run of a made page; they are its label and are taken off before features are read."""


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        return " ".join("".join(self.r.choice("ba de ri lo tun sen mar et oul is ka po ner".split()) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        return self.words(4, 18).capitalize() + self.r.choice(".....?!")

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(a, b).capitalize()}</a>'

    def links(self, mark: str) -> str:
        return "<ul>" + "".join(f"<li>{mark}{self.link()}</li>" for _ in range(self.r.randint(2, 9))) + "</ul>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{KEPT}{self.words(3, 12).capitalize()}</h1>")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                text = self.prose(1, 7) if r.random() < 0.8 else self.words(1, 8)
                if r.random() < 0.2:
                    text += f" {self.link()} {self.sentence()}"
                out.append(f"<p>{KEPT}{text}" + ("</p>" if r.random() < 0.8 else "<br>"))
            elif kind < 0.82:
                out.append(f"<h{r.randint(2, 4)}>{KEPT}{self.words(1, 7).capitalize()}</h2>".replace("</h2>", "</h2></h3></h4>"))
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{KEPT}{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{KEPT}{self.prose(1, 3)}</p></blockquote>")
            else:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{KEPT}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            if r.random() < 0.06:
                out.append(self.advert())
        return "".join(out)

    def advert(self) -> str:
        name = self.r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"])
        tag = self.r.choice(["div", "aside", "section"])
        return f'<{tag} class="{name}">{LEFT}{self.prose(1, 2) if self.r.random() < 0.7 else self.link(2, 5)}</{tag}>'

    def comments(self) -> str:
        r, name = self.r, self.r.choice(["comments", "comment-list", "replies", "discussion", "respond"])
        body = "".join(f'<div class="comment"><h4>{LEFT}{self.words(1, 2)}</h4><p>{LEFT}{self.prose(1, 5)}</p></div>' if r.random() < 0.6 else f"<li><p>{LEFT}{self.prose(1, 4)}</p></li>" for _ in range(r.randint(1, 6)))
        return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["id", "class"])}="{name}">' + (f"<h3>{LEFT}{self.words(1, 2)}</h3>" if r.random() < 0.7 else "") + body + f"</{t}>"

    def other(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.2:
            return f'<aside class="{r.choice(["sidebar", "related", "widget"])}"><h3>{LEFT}{self.words(1, 3)}</h3>{self.links(LEFT)}</aside>' if r.random() < 0.6 else f"<aside><p>{LEFT}{self.prose(1, 3)}</p></aside>"
        if kind < 0.35:
            return f'<div class="{r.choice(["cookie", "notice", "alert", "consent"])}"><p>{LEFT}{self.prose(1, 3)}</p></div>'
        if kind < 0.5:
            return f"<form><p>{LEFT}{self.words(1, 6)}</p><label>{LEFT}{self.words(1, 3)}</label><input></form>"
        if kind < 0.65:
            return f'<div class="{r.choice(["share", "social", "related", "tags", "newsletter", "breadcrumbs"])}">{self.links(LEFT) if r.random() < 0.6 else LEFT + self.sentence()}</div>'
        return self.advert()

    def page(self) -> str:
        r = self.r
        out = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]
        if r.random() < 0.5:
            out.append(f'<header{r.choice(["", " class=masthead"])}>' + (f"<h1>{LEFT}{self.words(1, 4)}</h1>" if r.random() < 0.4 else f"<div>{LEFT}{self.link()}</div>") + (f"<p>{LEFT}{self.sentence()}</p>" if r.random() < 0.3 else "") + "</header>")
        if r.random() < 0.85:
            out.append(f"<nav>{self.links(LEFT)}</nav>" if r.random() < 0.7 else f'<div class="{r.choice(["menu", "nav", "navigation"])}">{self.links(LEFT)}</div>')
        out += [self.other() for _ in range(r.randint(0, 2))]
        if r.random() < 0.96:
            a, b = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ("<div>", "</div>"), ('<section class="entry">', "</section>")])
            inside = self.article()
            if inside.startswith("<h1>") and r.random() < 0.12:  # the heading in a header of the article itself
                inside = "<header>" + inside.replace("</h1>", "</h1></header>", 1)
            if r.random() < 0.2:
                inside += self.comments() if r.random() < 0.5 else self.other()
            out.append(a + inside + b)
        out += [self.other() for _ in range(r.randint(0, 2))]
        if r.random() < 0.35:
            out.append(self.comments())
        if r.random() < 0.85:
            body = f"&copy; {self.words(1, 2)} &middot; {self.sentence()}" if r.random() < 0.5 else self.words(2, 8)
            out.append(f"<footer>{LEFT}{body}</footer>" if r.random() < 0.7 else f'<div class="footer"><p>{LEFT}{body}</p>{self.links(LEFT)}</div>')
        return "".join(out) + "</body></html>"


def labelled_page(page: str) -> tuple[list[Node], list[int]]:
    """Nodes without their marks, and their states: a run's own, an element's if it holds main text."""
    nodes = parse(page)
    labels = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.text:
            labels[i] = int(KEPT in x.text)
            x.text = x.text.replace(KEPT, "").replace(LEFT, "").strip() or "x"
            x.linked = min(x.linked, len(x.text))
        if x.parent >= 0 and labels[i]:
            labels[x.parent] = 1
    return nodes, labels


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    maker = _Maker(SEED)
    return TreeModel.fit([labelled_page(maker.page()) for _ in range(TRAINING_PAGES)])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    model = trained()
    weights, pair = model.weights, model.pair

    def run(batches):
        tree = TreeModel(weights, pair)
        for batch in batches:
            text = [tree.extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
