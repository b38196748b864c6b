"""The source divergence audit against brute force, with awkward rows and small chunks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemill.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, value string, rank long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    docs = [(r[2] or "", r[3] or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in df:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=lambda t: t.encode())
        sources = sorted({s for k, s in counts if k == lang})
        whole = sum((counts[lang, s] for s in sources), Counter())

        def p(c):
            below = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // below for t in kept}

        shares, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (shares[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows_of(n=250):
    r = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "é", "É", "中文", "😀", "ﬃ", "x1y", "d'e", "_u_", "Straße", "ÀB", " ", "a", "b", "c"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60)]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None, ""]), r.choice(["s1", "s1", "s2", "s3", None, "é", "z😀"])
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
        rows.append((i, r.choice([text, text, text.replace(" ", "\n"), None, "", "12 34"]), lang, source, "t", "v", 1))
    rows += [(900, None, "xx", "only", "", "", 0), (901, "one two", "xx", "other", "", "", 0)]  # a language that keeps no term
    rows += [(902, None, "en", "mute", "", "", 0)]  # a group without terms
    rows += [(903, "equal tie " * 20, "tt", f"s{i % 2}", "", "", 0) for i in range(6)]  # repeated rows and ties
    return rows + [(904, "long Words " * 60_000, "en", "s1", "", "", 0), (905, "lone", "ll", "single", "", "", 0)]


@pytest.mark.parametrize("cells, gathered", [(1 << 20, 1 << 20), (40, 5)])
def test_equal_to_brute_force(spark, monkeypatch, cells, gathered):
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    rows = rows_of()
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(3), top=7, cells=cells).collect()
    assert sorted(map(tuple, got)) == brute(rows, top=7)


def test_an_empty_table_and_parameters(spark):
    docs = spark.createDataFrame(rows_of(40), DOCS)
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    got = divergence.source_divergence(docs, least_docs=1, top=3).collect()
    assert sorted(map(tuple, got)) == brute(rows_of(40), least=1, top=3)


def test_shares_are_exact_for_large_counts():
    r = random.Random(5)
    for _ in range(200):
        total = r.choice([0, 1, r.randint(1, 10**6), r.randint(10**12, 8 * 10**15)])
        kept, counts = r.randint(1, 10**9), [0, total, r.randint(0, total)]
        got = divergence.share(np.array(counts, np.int64), np.int64(total), kept)
        assert got.tolist() == [1 + 10**9 * (c + 1) // (total + kept) for c in counts]
    cell, n = np.array([0, 2, 2, 0]), np.array([2**55 + 1, 2**54 + 1, 3, 5])
    assert divergence._whole_bincount(cell, n, 3).tolist() == [2**55 + 6, 0, 2**54 + 4]
