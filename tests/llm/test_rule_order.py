"""The cascade's order: counted on a sample, the same in every run, by rejections per work."""

from tidemill.llm import rules

DOCS = "doc_id long, text string"


def texts():
    plain = "These are plain words of a text that no rule has anything against at all"
    return [plain + f" {i}" for i in range(60)] + [plain + " " + " ".join(f"more{j}" for j in range(30))] * 30 + ["ab " * 5 + "#### " * 20] * 3 + [None, ""]


def test_the_order_is_the_same_in_every_run_and_for_every_split(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), DOCS)
    orders = {tuple(r.name for r in rules.rule_order(docs.repartition(n))) for n in (1, 2, 3, 5)}
    assert len(orders) == 1


def test_rejections_per_work_decide(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), DOCS)
    cheap = rules.Rule("cheap", lambda: rules.F.col("n_words") > 40)
    costly = rules.Rule("costly", cheap.reject, passes=3)
    useless = rules.Rule("useless", lambda: rules.F.lit(False), passes=1)
    assert [r.name for r in rules.rule_order(docs, (useless, costly, cheap))] == ["cheap", "costly", "useless"]


def test_one_repeated_doc_id_is_sampled_by_its_texts(spark):
    docs = spark.createDataFrame([(7, f"words of one text {i} " * 4) for i in range(400)], DOCS)
    share = (rules.SAMPLE_ROWS, 100)[1]
    picked = docs.where(rules.F.pmod(rules.F.xxhash64("doc_id", "text"), rules.F.lit(1 << 30)) < int(share / 400 * (1 << 30))).count()
    assert 50 < picked < 170 and len(rules.rule_order(docs, sample_rows=share)) == len(rules.RULES)
    assert len(rules.rule_order(docs.limit(0))) == len(rules.RULES)
