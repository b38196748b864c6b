"""Long lists without links in them, as a full sketch gives them: only members that may link send their whole sets."""

import random

import numpy as np

from tidemill.llm import jaccard as J


def test_members_of_links_are_never_ruled_out(spark):
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.int64).view(np.uint64))
    sets = [base, np.sort(np.concatenate([base[:180], base[:15] + np.uint64(1)]))]
    sets += [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.int64).view(np.uint64)) for n in rng.integers(150, 300, 40)]
    at = np.cumsum([0, *map(len, sets)])
    maps = J.parities(np.concatenate(sets), at)
    group = spark.createDataFrame([(41, i, len(s), i) for i, s in enumerate(sets)], "main long, doc_id long, n long, c long")
    values = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(maps)], "doc_id long, p binary")
    found = {r["doc_id"] for r in J.near_members(group, values).collect()}
    assert {0, 1} <= found and len(found) < 6


def test_lists_without_links_send_no_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "SLOTS", 64)  # every shingle is as common as any other
    rng, sent, whole_sets = random.Random(2), [], J.whole_sets

    def counted(docs, reps, wanted, salt):
        sent.append(wanted.count())
        return whole_sets(docs, reps, wanted, salt)

    monkeypatch.setattr(J, "whole_sets", counted)
    phrases = [" ".join(f"p{i}x{j}" for j in range(5)) for i in range(20)]
    texts = [" ".join([*rng.sample(phrases, 8), *(f"w{i}x{j}" for j in range(30))]) for i in range(150)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_join(docs).collect()}
    assert got == {i: i % 150 for i in range(151)}
    assert sum(sent) < 30
