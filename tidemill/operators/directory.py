"""The media directory: searched words by category, what the searches found, and the ids to configure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .control import joined_list, ordered_distinct

#: Collections that are searched, and the most results taken of a search.
COLLECTION_WORDS = ("China", "Chinese", "Hong Kong", "Taiwan", "Asia")
MOST_COLLECTIONS, MOST_SOURCES, MOST_SHOWN = 20, 10, 20
#: What is shown of an item.
SHOWN = ("id", "name", "label", "url", "domain", "pub_country", "language")


def parse_words(lines: DataFrame, line: str = "value", order: str = "ord") -> DataFrame:
    """ord, category, word of a list in text lines: '# name' begins a category, rules of '=' and blanks do not count."""
    text = F.trim(F.regexp_replace(F.col(line), "[\"',]", ""))
    head = F.when(text.startswith("#") & ~text.rlike("^#[ =]*$"), F.trim(F.regexp_replace(text, "^#+", "")))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a list of hundreds, kept by hand
    named = lines.select(F.col(order).alias("ord"), text.alias("word"), F.last(head, ignorenulls=True).over(before).alias("category"))
    return named.where((F.col("word") != "") & ~F.col("word").startswith("#")).select("ord", F.coalesce("category", F.lit("")).alias("category"), "word")


#: The fields of a directory's item that are looked at.
ITEM = "struct<id: long, name: string, label: string, url: string, homepage: string, domain: string, pub_country: string, primary_language: string>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """parse_words() of a text file; its lines are numbered in the order in which they are read."""
    return parse_words(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def read_found(spark: SparkSession, path: str) -> DataFrame:
    """word, item_ix, item: what was found, from JSON lines."""
    return spark.read.schema(f"word string, item_ix int, item {ITEM}").json(path)


def distinct_words(words: DataFrame) -> DataFrame:
    """Each word once, where it came first, and how often it is listed: a repeated word needs no second search."""
    return words.groupBy("word").agg(F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category"), F.count("*").alias("times"))


def search_results(words: DataFrame, found: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """words (ord, word) joined with found (word, item_ix, item): the first `most` items of each search. A word whose search failed has none."""
    return words.join(found, "word").where(F.col("item_ix") < most)


def show_items(results: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    """The first items of each search, in the seven shown fields; a name falls back to the label, a url to the homepage."""
    i = lambda name: F.col(f"item.{name}")
    either = lambda a, b: F.coalesce(F.nullif(i(a), F.lit("")), i(b))
    fields = [i("id"), either("name", "label"), i("label"), either("url", "homepage"), i("domain"), i("pub_country"), i("primary_language")]
    return results.where(F.col("item_ix") < most).select("ord", "word", "item_ix", *[f.alias(n) for f, n in zip(fields, SHOWN)])


def discovered_ids(results: DataFrame) -> DataFrame:
    """id, first: ids in the order in which the searches found them, each once."""
    return ordered_distinct(results.select(F.col("item.id").alias("id"), F.struct("ord", "item_ix").alias("at")), "id", "at")


def id_setting(results: DataFrame) -> DataFrame:
    """One row: the ids as one comma-separated text, to be copied into the settings."""
    ids = discovered_ids(results)
    return ids.agg(joined_list(ids, "id", "first").alias("ids"))


def collection_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(COLLECTION_WORDS)), "ord int, word string")
