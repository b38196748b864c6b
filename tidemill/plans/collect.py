"""From stored answers to the merged snapshot: every connector, its paging and its fallback, as one plan.

answers: keyword, platform, step, page, payload, error. A step is one of a platform's services: 0 its own,
from 1 on the search engines (in order); of the feeds their number; of the media sites three searches each.
An answer that failed has no payload and gives no rows; where a service is asked page by page it also ends its paging,
as does a page that has no answer at all."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import article_text
from ..operators import control
from ..operators.records import FIELDS, RECORD, assign_ids, cleaned, deduplicate, make_record, raw_fields
from ..scratch import SMALL_BATCHES, aside, exists, materialise, scratch_dir
from ..sources import files
from ..sources import payloads as P
from ..sources.fetch import repaired_text
from ..sources.store import Store, is_store, restart
from . import spec as S

ANSWERS = "keyword string, platform string, step int, page int, payload string, error string"
OWN = ("weibo", "zhihu", "toutiao", "xiaohongshu")
SEQ = ("keyword_ix", "platform_ix", "step", "page", "item_ix")


#: A larger answer is not read, and counts as failed.
MOST_BYTES = 1 << 30


def read_answers(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Answers of a folder in any store that Spark reads: <keyword>/<platform>/<step>-<page>.<ext>, bytes in any charset.

    Files are listed first and then read, each by itself: one that cannot be opened, breaks off, or is longer than
    most_bytes gives a row with its error. Other files and tasks do not notice. One that is gone by then, or is
    empty, is no answer."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    at = r"([^/]+)/([^/]+)/([0-9]+)-([0-9]+)\.[^/]*$"
    listed = found.load(root).select("path", "length").where(F.col("path").rlike(at))  # of these columns no file is opened
    content = found.load(root).where(F.col("length") <= most_bytes).select("path", F.col("content"))
    text = repaired_text(F.col("content"), F.lit(None).cast("string"))
    read = content.where(F.col("path").rlike(at)).select("path", text.alias("payload"), F.col("content").isNotNull().alias("_read"))  # so that files are read even where only errors are asked for
    parts = [F.regexp_extract("path", at, i) for i in range(1, 5)]
    error = F.when(F.col("_read").isNull() & (F.col("length") > most_bytes), "too long").when(F.col("_read").isNull(), "unreadable")
    return listed.join(read, "path", "left").select(
        parts[0].alias("keyword"), parts[1].alias("platform"), parts[2].cast("int").alias("step"), parts[3].cast("int").alias("page"), "payload", error.alias("error")
    )


def read_details(spark: SparkSession, root: str) -> DataFrame:
    """url, html: articles stored beside the answers, as JSON lines in _articles/; none where there is no such folder."""
    path, schema = f"{root.rstrip('/')}/_articles", "url string, html string"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def by_platform(answers: DataFrame) -> DataFrame:
    """answers written once in a folder per platform, so that each connector reads its own."""
    spark = answers.sparkSession
    path = scratch_dir(spark)
    answers.write.partitionBy("platform").option("compression", "zstd").parquet(path)
    return spark.read.schema(answers.schema).parquet(path)


def failures(answers: DataFrame) -> DataFrame:
    """Per task with a failed answer: how many, and one of the errors."""
    return answers.where("error IS NOT NULL").groupBy("keyword", "platform").agg(F.count("*").alias("failed"), F.min("error").alias("error"))


def _seq() -> Column:
    return F.struct(*SEQ)


TASK = ["keyword_ix", "platform_ix"]


def _kind(value: Column) -> Column:
    """NULL where a value is absent, VOID where it is null, else its type."""
    return F.coalesce(F.schema_of_variant(value), F.lit("NULL"))


def raises(platform: str, payload: str = "payload") -> Column:
    """Whether an answer that is JSON makes its connector raise, so that its whole task gives nothing.

    That is so where the answer is no object, where its hits are null (unless the service may leave them null) or
    no list, where a hit is no object, and where the object a hit's missing name or text is looked up in is null."""
    root = F.try_parse_json(payload)
    get = lambda v, path: F.try_variant_get(v, path, "variant")
    *outer, last = P.ITEMS[platform].split(".")
    found, bad = get(root, "$." + ".".join([*outer, last])), _kind(root).rlike("^(?!OBJECT|NULL)")
    if outer:
        bad = bad | _kind(get(root, f"$.{outer[0]}")).rlike("^(?!OBJECT|NULL)")
    hits = F.try_variant_get(root, "$." + ".".join([*outer, last]), "array<variant>")
    empty = F.coalesce(found.cast("string").isin("", "{}"), F.lit(False)) | (F.lit(platform in NULL_HITS) & (_kind(found) == "VOID"))
    bad = bad | (_kind(found).rlike("^(?!ARRAY|NULL)") & ~empty)
    bad = bad | F.coalesce(F.exists(hits, lambda x: ~_kind(x).startswith("OBJECT")), F.lit(False))

    def null_inside(x: Column, field: str, *before: str) -> Column:
        """The field is null, and looked at since those before it are falsy."""
        missing = F.lit(True)
        for b in before:
            missing = missing & F.coalesce(F.try_variant_get(x, f"$.{b}", "string").isin("", "0", "false"), F.lit(True))
        return (_kind(get(x, f"$.{field}")) == "VOID") & missing

    if platform == "mediacloud":
        bad = bad | F.coalesce(F.exists(hits, lambda x: null_inside(x, "media", "media_name", "source_name")), F.lit(False))
    if platform == "toutiao":
        bad = bad | F.coalesce(F.exists(hits, lambda x: null_inside(x, "display", "title") | null_inside(x, "display", "abstract", "description")), F.lit(False))
    return F.coalesce(bad, F.lit(False))


#: Services whose list of hits may be null.
NULL_HITS = ("bilibili", "zhihu", "toutiao")


def _sound(pages: DataFrame, platform: str) -> DataFrame:
    """Pages of tasks none of whose answers makes the connector raise."""
    bad = pages.where(raises(platform)).select(*TASK).distinct()
    return pages.join(bad, TASK, "left_anti")


def _stopped(pages: DataFrame, platform: str) -> DataFrame:
    """The hits (item_ix, item) of pages up to the first that is missing, failed or was empty, and none behind a page that was not full.

    A task gives nothing if a page that is asked for makes its connector raise."""
    size = F.size(F.from_json("payload", P.SCHEMAS[platform])[P.ITEMS[platform]])
    read = F.try_parse_json("payload").isNotNull()
    if platform == "mediacloud":
        more, void = F.coalesce(F.get_json_object("payload", "$.pagination_token"), F.lit("")) != "", read & raises(platform)
    else:
        other = ~_kind(F.try_parse_json("payload")).startswith("OBJECT")
        read = read & (F.coalesce(F.get_json_object("payload", "$.status"), F.lit("")) == "ok")
        more, void = F.col("_size") >= S.FULL_PAGE[platform], raises(platform) & (read | other)
    marked = pages.withColumn("_size", F.coalesce(size, F.lit(0))).withColumn("_raises", void)
    marked = marked.withColumn("_ok", F.coalesce(read & (F.col("_size") > 0), F.lit(False))).withColumn("_full", F.col("_ok") & F.coalesce(more, F.lit(False)))
    asked = control.asked_pages(marked.select(*SEQ[:4], "payload", "_ok", "_full", "_raises"), [*TASK, "step"], "page", F.col("_full"))
    whole = asked.withColumn("_void", F.max("_raises").over(Window.partitionBy(*TASK, "step"))).where("_ok AND NOT _void")
    return P.items(whole.select(*SEQ[:4], "payload"), platform)


def prepared(answers: DataFrame, tasks: DataFrame, spec: S.CollectSpec) -> DataFrame:
    """The answers of the wanted tasks with their places in the order of collection, written by platform. Failed ones stay: they stop the paging."""
    named = answers.where(F.col("platform").isin(*spec.platforms)).join(tasks.select("keyword_ix", "keyword", "platform_ix", "platform"), ["keyword", "platform"])
    return by_platform(named.select("keyword_ix", "platform_ix", "platform", "step", "page", "payload"))


def raw_records(answers: DataFrame, tasks: DataFrame, spec: S.CollectSpec, details: DataFrame | None = None) -> DataFrame:
    """The five fields as the connectors find them, and seq (SEQ), of all wanted platforms. details: url, html of articles."""
    named, out = prepared(answers, tasks, spec), []
    for platform in spec.platforms:
        own = S.options(spec, platform)
        pages = named.where((F.col("platform") == platform) & (F.col("page") <= own["pages"]))
        there = pages.where("payload IS NOT NULL")
        if platform == "news":
            hits = P.items(_sound(there, platform), platform).where(F.col("item_ix") < own["hits"])
            detail = None
            if own["fetch_detail"] and details is not None:
                read = details.groupBy("url").agg(F.min("html").alias("html")).select(F.col("url").alias("_url"), article_text(F.col("html")).alias("_detail"))
                hits, detail = hits.join(read, F.col("item.url") == F.col("_url"), "left"), F.col("_detail")
            out.append(P.extract(hits, platform, _seq(), detail=detail, make=raw_fields))
        elif platform in ("newsapi", "currents", "mediacloud"):
            out.append(P.extract(_stopped(pages, platform), platform, _seq(), make=raw_fields))
        elif platform == "bilibili":
            out.append(P.extract(P.items(_sound(there, platform), platform), platform, _seq(), make=raw_fields))
        elif platform == "rssnews":
            out.append(aggregated_rss(there, raw_fields))
        elif platform == "sitenews":
            out.append(site_rss(there, int(own["sites"]), raw_fields))
        else:
            out.append(_with_search(there, tasks, platform))
    return reduce(DataFrame.unionByName, out)


def platform_records(answers: DataFrame, tasks: DataFrame, spec: S.CollectSpec, details: DataFrame | None = None) -> DataFrame:
    """Records (id null, the five fields, seq) of all wanted platforms, cleaned once behind the union of the connectors."""
    return cleaned(raw_records(answers, tasks, spec, details))


def aggregated_rss(pages: DataFrame, make=make_record) -> DataFrame:
    """Records of both aggregating feeds, in order; their step tells which."""
    label = F.element_at(F.array(*map(F.lit, S.FEEDS)), F.col("step") + 1)
    return P.rss_records(P.rss_items(pages.where(F.col("step") < len(S.FEEDS)), "payload"), label, False, _seq(), make=make)


def site_rss(pages: DataFrame, sites: int, make=make_record) -> DataFrame:
    """Records of the media sites' searches. A site's next search counts while those before it gave fewer than ten rows."""
    n = len(S.SITE_SEARCHES)
    pages = pages.where(F.col("step") < sites * n)
    label = F.concat(F.element_at(F.array(*[F.lit(m) for m, _ in S.MEDIA]), F.expr(f"step div {n}").cast("int") + 1), F.lit("-"), F.element_at(F.array(*map(F.lit, S.SITE_SEARCHES)), F.col("step") % n + 1))
    rows = P.rss_records(P.rss_items(pages, "payload"), label, True, _seq(), make=make)
    of = [F.col("seq.keyword_ix").alias("k"), F.expr(f"seq.step div {n}").alias("site"), (F.col("seq.step") % n).alias("search")]
    counts = rows.select(*of).groupBy("k", "site", "search").agg(F.count("*").alias("n"))
    kept = control.cascade(counts, ["k", "site"], "search", "n").select("k", F.expr(f"site * {n} + search").alias("s"))
    return rows.join(kept, (F.col("seq.keyword_ix") == F.col("k")) & (F.col("seq.step") == F.col("s")), "left_semi")


def _with_search(pages: DataFrame, tasks: DataFrame, platform: str) -> DataFrame:
    """A platform's own records and, where a task has fewer than five, what the search engines find on its sites.

    The engines' pages of other tasks are left out before they are parsed."""
    first, domains, label = pages.where("step = 0"), list(S.FALLBACK_DOMAINS[platform]), S.PLATFORMS[platform]
    if platform == "xiaohongshu":
        return site_search(pages, label, domains)
    if platform == "weibo":
        own = P.weibo_records(P.html_items(first, "weibo", "payload"), _seq(), make=raw_fields)
    else:
        own = P.extract(P.items(_sound(first, platform), platform), platform, _seq(), make=raw_fields)
    few = control.few(own.select(F.col("seq.keyword_ix").alias("keyword_ix")), tasks.where(F.col("platform") == platform), ["keyword_ix"])
    return own.unionByName(site_search(pages.join(few, "keyword_ix", "left_semi"), label, domains))


def site_search(pages: DataFrame, label: str, domains: list[str]) -> DataFrame:
    """All three engines' hits as raw fields, in order; an engine that failed has none."""
    parts = [P.search_records(P.html_items(pages.where(F.col("step") == i), engine, "payload"), engine, label, domains, _seq(), make=raw_fields) for i, engine in enumerate(S.ENGINES, 1)]
    return reduce(DataFrame.unionByName, parts)


def collect(answers: DataFrame, tasks: DataFrame, spec: S.CollectSpec, details: DataFrame | None = None) -> DataFrame:
    """The numbered batch: id, the five fields.

    Records are written before they are numbered: the numbering ranges them by a sample first, which would read all answers twice."""
    found = materialise(platform_records(answers, tasks, spec, details), SMALL_BATCHES)
    return assign_ids(deduplicate(found), start=spec.start_id).select(*FIELDS)


def run(spark: SparkSession, spec: S.CollectSpec, answers: DataFrame, out: str, at: datetime.datetime, details: DataFrame | None = None, exports: bool = True) -> DataFrame:
    """Collects a batch, keeps it under its time, merges it into the snapshot under `out`, and returns the summary (one row).

    A run of the same time replaces its own batch. Exports are single files for small snapshots, and need a local `out`."""
    prefix = f"{out.rstrip('/')}/{spec.output_prefix}"
    name = files.batch_name(prefix, at)
    files.write_table(collect(answers, S.tasks(spark, spec), spec, details), f"{prefix}_batches", f"{at:%Y%m%d_%H%M%S}")
    batch = spark.read.schema(RECORD).parquet(f"{prefix}_batches/batch_id={at:%Y%m%d_%H%M%S}")
    total = add_to_snapshot(spark, batch, f"{prefix}_snapshot", spec)
    if exports:
        files.export(batch, name)
        files.export(files.read_snapshot(spark, f"{prefix}_snapshot"), prefix, ("json", "csv"))
    return batch.agg(F.count("*").alias("collected")).withColumn("total", F.lit(total).cast("long"))


def add_to_snapshot(spark: SparkSession, batch: DataFrame, path: str, spec: S.CollectSpec) -> int:
    """Adds a batch to the store at path, or starts it anew (reset); returns how many records it then has.

    A snapshot that is a plain table, or was set aside by a run that died, becomes a store first."""
    ordered = batch.withColumn("seq", F.col("id"))
    if spec.reset:
        return restart(spark, path, ordered, spec.start_id)
    if not is_store(spark, path) and (exists(spark, path) or exists(spark, aside(path))):
        old = files.read_snapshot(spark, path)
        restart(spark, path, old.withColumn("seq", F.col("id")), spec.start_id)
    store = Store(spark, path, spec.start_id)
    store.merge(ordered)
    return store.manifest()["records"]
