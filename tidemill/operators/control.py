"""Paging and fallback rules as relational plans: page stop, cascade, threshold fallback, ordered distinct, retry bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_BELOW, CASCADE_AT = 5, 10


def asked_pages(pages: DataFrame, task: list[str], page: str, full: Column, first: int = 1) -> DataFrame:
    """The pages that are asked for at all: all pages from `first` up to them are there, succeeded and were full.

    A page without a row counts as failed, so nothing behind a gap is asked for. full: whether a page
    succeeded and was full (null: no). Rows of the same page are asked for together."""
    order = Window.partitionBy(*task).orderBy(page)
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    go = F.coalesce(F.min(F.coalesce(full, F.lit(False)).cast("int")).over(before), F.lit(1)) == 1
    return pages.withColumn("_go", go & (F.dense_rank().over(order) == F.col(page) - (first - 1))).where("_go").drop("_go")


def page_stop(pages: DataFrame, task: list[str], page: str, ok: str, full: str, first: int = 1) -> DataFrame:
    """A page is kept if it succeeded and all pages before it are there, succeeded and were full; a short page is the last."""
    return asked_pages(pages, task, page, F.col(ok) & F.col(full), first).where(ok)


def cascade(steps: DataFrame, task: list[str], step: str, n: str, enough: int = CASCADE_AT) -> DataFrame:
    """A step runs if those before it gave fewer than `enough` rows in all."""
    before = Window.partitionBy(*task).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_before", F.coalesce(F.sum(n).over(before), F.lit(0))).where(F.col("_before") < enough).drop("_before")


def few(rows: DataFrame, tasks: DataFrame, task: list[str], below: int = FALLBACK_BELOW) -> DataFrame:
    """The tasks that have fewer than `below` rows, none included."""
    counts = tasks.select(*task).join(rows.groupBy(*task).agg(F.count("*").alias("_n")), task, "left")
    return counts.where(F.coalesce("_n", F.lit(0)) < below).select(*task)


def with_fallback(primary: DataFrame, fallback: DataFrame, tasks: DataFrame, task: list[str], below: int = FALLBACK_BELOW) -> DataFrame:
    """Primary rows, and the fallback rows of each task that has fewer than `below` of them, none included."""
    return primary.unionByName(fallback.join(few(primary, tasks, task, below), task, "left_semi"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each truthy value once, with the place where it was first seen."""
    kept = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "") & (F.col(value).cast("string") != "0"))
    return kept.groupBy(value).agg(F.min(order).alias("first"))


def joined_list(df: DataFrame, value: str, order: str) -> Column:
    """Aggregate: the values in order, as one comma-separated text."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), ",")


#: Statuses that mean "wait and try again", delays in seconds.
LIMITED = (403, 412, 418, 429)
LEAST_DELAY, MOST_DELAY, LONGEST_WAIT = 1.8, 4.5, 20


def status_class(status: Column) -> Column:
    return F.when(status.isin(*LIMITED), "wait").when(status.between(200, 299), "ok").otherwise("retry")


def delay_bounds(attempt: Column) -> tuple[Column, Column]:
    """Pause before attempt 0, 1, ..."""
    return (attempt + 1) * LEAST_DELAY, (attempt + 1) * MOST_DELAY


def wait_bounds(attempt: Column) -> tuple[Column, Column]:
    """Wait after a limited answer to that attempt."""
    return F.least(F.lit(LONGEST_WAIT), 3 * (attempt + 1)), F.least(F.lit(LONGEST_WAIT), 3 * (attempt + 1) + 3)


def retried(attempts: DataFrame, task: list[str], attempt: str, status: str, retries: int = 2) -> DataFrame:
    """Per task: the attempt (from 0) whose answer is used (null: none), and how many were made: they end with the first 2xx or the last retry."""
    tried = attempts.where(F.col(attempt) <= retries)
    good = F.min(F.when(status_class(F.col(status)) == "ok", F.col(attempt)))
    return tried.groupBy(*task).agg(good.alias("used"), F.least(F.coalesce(good, F.max(attempt)), F.max(attempt)).alias("_last")).withColumn("made", F.col("_last") + 1).drop("_last")
