"""The pipeline's stages and page extraction on empty tables, null and repeated rows, and columns of clashing names."""

import pytest

import corpus_pipeline
from tidemill.llm import extraction, jaccard, mixing, packing, pii, rules
from tidemill.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = {"rules": rules.keep_documents, "near": jaccard.keep_one_of_each, "pii": pii.pseudonymise, "mix": mixing.mix_documents}
CLASHING = ("row", "_row", "kept", "component_id", "size", "taken", "key", "_n", "id", "hit")


def rows():
    good = [f"This is document number {n} about {w}, written with many different words so that each rule keeps it and no other is near." for n, w in enumerate(("rivers", "trains", "bread", "music", "winter", "islands"))]
    texts = [None, "", *good, good[0], good[0], good[1] + " Tail."]
    return [(i if i < 9 else 8, t, None if i % 4 == 0 else "en", [None, "s1", "s2"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("stage", STAGES)
def test_an_empty_table_stays_empty_with_its_columns(spark, stage):
    got = STAGES[stage](spark.createDataFrame([], DOCS))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")] and got.count() == 0


@pytest.mark.parametrize("stage", STAGES)
def test_columns_of_clashing_names_are_kept(spark, stage):
    docs = spark.createDataFrame(rows(), DOCS)
    for i, c in enumerate(CLASHING):
        docs = docs.selectExpr("*", f"{i} AS {c}")
    got, plain = STAGES[stage](docs), STAGES[stage](spark.createDataFrame(rows(), DOCS))
    assert got.columns == docs.columns
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    assert {tuple(r)[5:] for r in got.collect()} <= {tuple(range(len(CLASHING)))}


def test_packing_of_nothing_and_of_pages_without_text(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
    pages = "page_id long, url string, html string, text string, n_chars string"
    assert extraction.extract_pages(spark.createDataFrame([], pages)).count() == 0
    long = "<html><body><article>" + "<p>A sentence of the article that goes on for a while, with &amp; and words.</p>" * 8000 + "</article></body></html>"
    got = extraction.extract_pages(spark.createDataFrame([(1, "u", None, "t", "n"), (2, None, "", "t", "n"), (2, None, "", "t", "n"), (3, "v", long, None, None)], pages)).orderBy("page_id").collect()
    assert [(r["page_id"], r["n_chars"]) for r in got[:3]] == [(1, 0), (2, 0), (2, 0)] and got[3]["n_chars"] == len(got[3]["text"]) and got[3]["text"].count("\n") == 7999


def test_stages_one_after_the_other_keep_clean_documents(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
    left = [r["text"] for r in docs.collect()]
    assert len(left) == len(set(left)) == 6 and all("This is document number" in t for t in left)
