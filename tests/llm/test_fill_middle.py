"""Fill-in-middle examples against a plain version, and their round trip."""

import hashlib
import random

import pytest

from tidemill.llm import fill_middle

DOCS = "doc_id long, text string, lang string, n string, form string, marked string"


def plain(doc_id, text, fim=90, spm=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return len(t), "plain", None, None, t
    if h4 % 100 < spm:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def awkward():
    r = random.Random(1)
    pieces = ["\x1f", "\x10", "0", "1", "\x100", "\x101", "\x1f\x10", "\n", "\r\n", "$0", "\\", "é", "中", "😀", "é", "<", "P>", "<S", "\x00", " ", "a b"]
    texts = [None, "", "a", "\x1f", "\x10", "<P>", "x<S>y", "<M", "😀", "\x10\x1f" * 40]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += ["long 中😀\x1f " * 40_000, "same", "same"]
    return [(i, t, "en", "n", "f", "m") for i, t in enumerate(texts)] + [(7, "same id", None, "", "", ""), (7, "same id", None, "", "", ""), (None, "no id at all", None, None, None, None)]


def test_examples_equal_a_plain_version(spark):
    rows = awkward()
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *plain(r[0], r[1])) for r in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_the_text_comes_back(spark):
    rows = awkward()
    examples = fill_middle.fill_in_middle(spark.createDataFrame(rows, DOCS))
    got = fill_middle.digest(examples).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r["restored_sha256"] for r in got) == sorted(sha(r[1]) for r in rows)
    assert sorted(r["output_sha256"] for r in got) == sorted(sha(plain(r[0], r[1])[4]) for r in rows)


def test_parameters_and_an_empty_table(spark):
    rows = [(i, f"text number {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = fill_middle.fill_in_middle(docs, fim_percent=100, spm_percent=0).collect()
    assert {r["form"] for r in every} == {"psm"}
    assert {r["form"] for r in fill_middle.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}
    own = fill_middle.fill_in_middle(docs, seed="2:", markers=("[p]", "[s]", "[m]")).collect()
    assert any(r["output"].startswith("[p]") for r in own) and [r["prefix_chars"] for r in own] != [r["prefix_chars"] for r in every]
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, markers=("<a>", "<a>", "<b>"))
