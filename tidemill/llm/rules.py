"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Base measures, of every whole text (null: empty), by the word rule `[^\\x20\\x09-\\x0D]+`:
words, code points in words, symbols, lines with a word that equal an earlier line,
and words inside five-word windows that the text holds twice or more.

The verdict is the conjunction of the rules below, none of which looks outside its
own document. On a sample by hash of the whole table (a bounded number of rows, those that
pass the base) one job counts each rule's rejections and its work, and rules are ordered by
rejections per work. Work is what a rule reads of each row: the characters of the text for
each of its passes over it, one unit for each measure that stands ready. It is counted, not
timed: the times of such jobs differ more from run to run than the rules do, and the order
is to be the same in every run on the same table. The cascade is a nested CASE, which Spark
evaluates lazily: a row leaves at the first rule that rejects it. The order changes the
cost, never the verdict.

Repeated rows are judged alike; an empty table gives an empty result; other columns,
whatever their names, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
"""About so many documents, by hash, measure the rules; no verdict depends on them."""
SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by five-word windows found twice or more. Windows are compared by 64-bit hashes
    of their words; only texts with a repeat sort them."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(pairs, lambda p: F.transform(
            F.filter(
                F.transform(p, lambda x, j: F.struct(
                    x["i"].alias("i"),
                    (F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
                )),
                lambda x: x["twice"]),
            lambda x: x["i"]))
        return let(F.sort_array(repeated), lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x))

    def of(coded: Column) -> Column:
        hashes = F.transform(F.slice(coded, F.lit(1), F.size(coded) - 4), lambda _, i: F.xxhash64(*[F.get(coded, i + k) for k in range(5)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return F.when(F.size(words) < 5, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of)).cast("long")


#: The symbols of the base measure.
SYMBOLS = "[#*$%&|<>]"


def base_measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and _n_lines, _caps, _bangs for the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return (
        docs.withColumn("_m", let(word_array(text), measures))
        .withColumn("_l", let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""), lines))
        .withColumn("n_words", F.col("_m.n_words"))
        .withColumn("word_chars", F.col("_m.word_chars"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", F.col("_l.dup"))
        .withColumn("n_repeat_words", F.col("_m.n_repeat_words"))
        .withColumn("_n_lines", F.col("_l.n"))
    )


@dataclass(frozen=True)
class Rule:
    """reject: when true, the document goes. passes: over the text; measures: that it compares."""

    name: str
    reject: Callable[[], Column]
    passes: int = 0
    measures: int = 2

    def work(self) -> Column:
        """What the rule reads of a row."""
        return F.length(_text()).cast("long") * self.passes + self.measures


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


#: The verdict's rules beyond the base. Thresholds are in whole percents, so that they are exact.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 100 > F.col("n_words") * 20),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 100 > F.col("_n_lines") * 50),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 15)),
    Rule("exclamations", lambda: F.regexp_count(_text(), F.lit("!")) * 100 > F.col("n_words") * 30, passes=1, measures=1),
    # characters of words that are no letters
    Rule("letters", lambda: F.regexp_count(_text(), F.lit(r"[^A-Za-z\u00C0-\uFFFF\x20\x09-\x0D]")) * 100 > F.col("word_chars") * 50, passes=1, measures=1),
)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per work, counted on about sample_rows rows of docs (doc_id, text), those of them that pass the base.

    Rules without a rejection in the sample count as half a one; equals go by name."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    # conditions stand within the sums: a filter on the measures would be joined to that of the sample, and they would be taken of all rows
    passed = ~base_failed()
    sums = [F.struct(F.count(F.when(passed & r.reject(), 1)).alias("rejected"), F.sum(F.when(passed, r.work())).alias("work")).alias(r.name) for r in rules]
    got = base_measures(sample).agg(*sums).first()
    gain = {r.name: (got[r.name]["rejected"] + 0.5) / max(got[r.name]["work"] or 0, 1) for r in rules}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def judge(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """docs with the base measures, base_failed and kept."""
    order = rule_order(docs) if order is None else order
    kept = F.lit(True)
    for rule in reversed(order):
        kept = F.when(rule.reject(), F.lit(False)).otherwise(kept)
    return base_measures(docs).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(kept))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, kept."""
    return judge(docs.select("doc_id", "text")).select(*COLUMNS)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return judge(named, rule_order(docs)).where("kept").select("_row.*")


RULES_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
u AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
g AS (SELECT r, i, word || chr(31) || lead(word, 1) OVER o || chr(31) || lead(word, 2) OVER o || chr(31) || lead(word, 3) OVER o || chr(31) || lead(word, 4) OVER o AS five
      FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM g WHERE five IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + d) AS n FROM k, (SELECT unnest(range(5)) AS d) WHERE times > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
q AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT t.doc_id, t.text, len(w.words) AS n_words, length(array_to_string(w.words, '')) AS word_chars,
    length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(q.dup, 0) AS n_dup_lines, coalesce(q.n_lines, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM t JOIN w USING (r) LEFT JOIN q USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed
    AND NOT n_symbols * 100 > n_words * 20
    AND NOT n_dup_lines * 100 > n_lines * 50
    AND NOT (word_chars < n_words * 2 OR word_chars > n_words * 15)
    AND NOT (length(text) - length(replace(text, '!', ''))) * 100 > n_words * 30
    AND NOT length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{FFFF}]+', '', 'g')) * 100 < word_chars * 50 AS kept
FROM b
"""
