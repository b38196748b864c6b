"""Mixing sources to target weights, with DataFrame functions only.

Sources, in code point order and null last, weigh 5, 2, 1 and so on in turn. They
share the corpus's words by weight; a target stops at `max_epochs` times its
source's words, and the excess goes to the others by weight until none is above
(water filling, solved in closed form over the table of sources).

Each document gets a hash-random key. Within its source the documents stand in key
order: the key's first three hex digits cut that order into 4096 ranges of equal
expected size (a parameter sets how many), whose word counts are summed and accumulated,
and a window inside each range continues from there. So no source, however large, meets in one task.
A source's budget is then met exactly: whole epochs first, after which the order is
cut at the remaining words; the document at the cut gives only its first words.

Null text counts as no words; null sources are one source; repeated rows are
separate documents; an empty table gives an empty result. Ties of the key are
broken by doc_id and size; rows equal in these are interchangeable. Extra columns
are ignored by `mix_plan` and kept by `mix_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ahead, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target (double)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the table of sources is small beside the documents, so its ordered windows need no split
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    by_ratio = Window.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - (F.sum(cap).over(by_ratio) - cap)).cast("double") / (
        F.sum("w").over(every) - (F.sum("w").over(by_ratio) - F.col("w"))
    )
    free = F.when(cap >= F.col("level") * F.col("w"), F.col("level"))
    return (
        per.withColumn("w", w)
        .withColumn("level", level)
        .withColumn("level", F.max(free).over(every))  # levels fall along the sources that are not capped
        .select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("w"), cap.cast("double"))).alias("target"))
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A source is cut into 16 ** range_digits ranges, each of which one task accumulates."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sized, weights, max_epochs)
    keyed = sized.withColumn("key", key).withColumn("range", F.conv(F.substring("key", 1, range_digits), 16, 10).cast("long"))
    ranges = ahead(keyed.groupBy("source", "range").agg(F.sum("size").alias("n")), ["source"], "range")
    plan = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("s"), F.col("range").alias("g"), "ahead", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    return (
        keyed.withColumn("upto", F.sum("size").over(inside))
        .join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
        .withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - (F.col("upto") - F.col("size")))))
        .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    gaps = F.split(text, WORD)  # the white space before each word, and after the last
    parts = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(words, F.lit(1), n), lambda g, w: F.length(g) + F.length(w))
    return F.substring(text, F.lit(1), F.aggregate(parts, F.lit(0), lambda a, x: a + x))


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, range_digits: int = RANGE_DIGITS) -> DataFrame:
    """The mixed corpus, with the columns of docs: a document taken more than once is repeated, and
    the one at its source's cut keeps its first words and the white space between them."""
    plan = mix_plan(docs, weights, max_epochs, seed, range_digits).where("taken > 0")
    # rows equal in doc_id, source and size are interchangeable, so they are matched by their rank
    plan = plan.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("taken"))).alias("p")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("row.text"))).alias("d")
    same = F.lit(True)
    for c in ("doc_id", "source", "size", "n"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
    joined = rows.join(plan, same).select("d.row", (F.col("taken") / F.col("p.size")).cast("int").alias("whole"), (F.col("taken") % F.col("p.size")).cast("int").alias("rest"))
    copies = F.concat(F.array_repeat(F.lit(True), F.col("whole")), F.array_repeat(F.lit(False), F.when(F.col("rest") > 0, 1).otherwise(0)))
    out = joined.select("row", "rest", F.explode(copies).alias("whole"))
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("rest")))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(row.alias("row")).select("row.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
             3 * source_size AS cap, CAST((SELECT sum(size) FROM d) AS BIGINT) AS everything FROM s),
levels AS (  -- capped sources are those whose cap lies below the level that holds when all smaller ratios are capped
  SELECT a.source, CAST(a.everything - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap * a.w < a.cap * b.w OR (b.cap * a.w = a.cap * b.w AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))), 0) AS DOUBLE)
    / ((SELECT sum(w) FROM w) - coalesce((SELECT sum(b.w) FROM w b WHERE b.cap * a.w < a.cap * b.w OR (b.cap * a.w = a.cap * b.w AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))), 0)) AS level, a.cap, a.w
  FROM w a),
t AS (SELECT w.source, source_size, cap, least(CAST(w.cap AS DOUBLE), (SELECT max(level) FROM levels l WHERE l.cap >= l.level * l.w) * w.w) AS target FROM w),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix-1'), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM o
"""
