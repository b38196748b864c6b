r"""How sources of a language diverge in their words, by integer-dictionary encoding.

Terms are runs of letters (`[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, A-Z lower-cased). A language keeps the
terms of at least `least_docs` of its documents. A group (language and source) and the language as a
whole give each kept term the share p = 1 + floor(10**9 (count + 1) / (N + V)), N being the counts' sum
and V the number of kept terms; what p adds to q is f = floor((p - q)**2 / q).

1. Each task encodes the terms of some texts with an exact dictionary and counts (source, term) and
   the documents of each by bincount over integer ids; Spark adds these counts up.
2. The counts are ranged by language and term. Each range is read in order, kept terms become sorted
   arrays of bounded size, ids are found by searchsorted, and bincount gives each source's dense vector
   over the array. Arrays and ids preserve UTF-8 order.
3. With the groups' totals beside them, chunks give shares and all f at once: sums by pair of sources,
   and each group's best terms, the smaller id first among equals. Partial sums and each chunk's best
   are then added up and ranked.

A chunk holds at most `cells` numbers, however many terms and sources a language has, so memory is
bounded; a frequent term or source costs one row per task in the shuffle. Whole numbers throughout:
10**9 times a count is divided in steps of 1000 (N below 9 * 10**15), (p - q)**2 is below 2**60.

Null text, lang and source count as ''. A group without terms still has its shares, and so its pairs;
a language that keeps no term has pairs of value 0 and no terms. Repeated rows are documents of their
own. Ties of value go by item in UTF-8 order. Extra columns are ignored; an empty table gives an empty
result. A text is one unit of memory: the longest text must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, materialise, tidy

LEAST_DOCS, TOP_TERMS = 3, 200
SCALE_STEPS = (1000, 1000, 1000)
#: Numbers of a dense chunk (sources by terms), and rows of counts that a task gathers before it adds them up.
CELLS, GATHERED = 1 << 20, 1 << 20
SALTS = 64

#: Fixed value: which bytes belong to a term, those of A-Z, a-z and of all code points from 0x80 on.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True

COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a chunk of texts (bytes, and where each begins), in order, and the number of each term's text."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    begin = np.flatnonzero(first)
    bytes_ = LOWER[data[inside]]
    where = np.cumsum(inside) - inside  # of each byte, among those of terms
    offsets = np.append(where[begin], len(bytes_)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
    return terms, np.searchsorted(at, begin, "right") - 1


def _counted(groups: np.ndarray, n_groups: int, texts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """For each chunk of texts: group, term, occurrences and documents of each pair that occurs. groups: of each text."""
    for chunk in chunks(texts):
        terms, text = terms_of(chunk.data, chunk.at)
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        pair = np.unique(text * size + code)  # each term once per text
        group = groups[chunk.rows.start : chunk.rows.stop]
        key, n = np.unique(group[text] * size + code, return_counts=True)
        known, docs = np.unique(group[pair // size] * size + pair % size, return_counts=True)
        assert len(known) == len(key)
        yield key // size, coded.dictionary.take(pa.array(key % size)), n, docs


def _added(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term) in these texts, added up as far as GATHERED rows allow. A row of term '' tells that a group occurs."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        names = pa.table({"lang": pc.fill_null(batch.column(1), ""), "source": pc.fill_null(batch.column(2), "")})
        lang, source = names["lang"].combine_chunks().dictionary_encode(), names["source"].combine_chunks().dictionary_encode()
        n_source = max(1, len(source.dictionary))
        both = lang.indices.to_numpy().astype(np.int64) * n_source + source.indices.to_numpy()
        groups, of = np.unique(both, return_inverse=True)
        langs, sources = lang.dictionary.take(pa.array(groups // n_source)), source.dictionary.take(pa.array(groups % n_source))

        def table(group, term, n, docs):
            at = pa.array(group)
            return pa.Table.from_arrays([langs.take(at), sources.take(at), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)

        zero = np.zeros(len(groups), np.int64)
        held.append(table(np.arange(len(groups)), pa.array([""] * len(groups), pa.string()), zero, zero))
        for group, term, n, docs in _counted(of, len(groups), batch.column(0)):
            held.append(table(group, term.cast(pa.string()), n, docs))
            rows += len(n)
            if rows > GATHERED:
                held = [_added(held)]
                rows = held[0].num_rows
                if rows > GATHERED // 2:  # adding up no longer helps
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
    if held:
        yield from _added(held).to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a row of term '' and zeros for each group."""
    read = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return read.mapInArrow(tidy(_count), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- dense chunks of kept terms

CHUNKS = "lang string, terms array<string>, sources array<string>, counts binary"
_CHUNKS = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("counts", pa.binary())])


def _dense(rows: pa.Table, least_docs: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Rows of one language, sorted by term, all rows of a term among them: chunks of its kept terms, counts by source and term."""
    term = rows["term"].combine_chunks().dictionary_encode()  # codes in order of appearance: sorted
    code = term.indices.to_numpy().astype(np.int64)
    docs = np.bincount(code, rows["docs"].to_numpy(), len(term.dictionary)).astype(np.int64) if len(code) else np.zeros(0, np.int64)
    kept = np.flatnonzero(docs >= least_docs)  # the sorted array of kept codes
    source = rows["source"].combine_chunks().dictionary_encode()
    names, who, n = source.dictionary, source.indices.to_numpy().astype(np.int64), rows["n"].to_numpy()
    step = max(1, cells // max(1, len(names)))
    for a in range(0, len(kept), step):
        part = kept[a : a + step]
        lo, hi = np.searchsorted(code, part[0], "left"), np.searchsorted(code, part[-1], "right")
        at = np.searchsorted(part, code[lo:hi])
        known = part[np.minimum(at, len(part) - 1)] == code[lo:hi]
        cell = who[lo:hi][known] * len(part) + at[known]
        dense = _whole_bincount(cell, n[lo:hi][known], len(names) * len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows["lang"][0].as_py()], pa.string()), pa.array([term.dictionary.take(pa.array(part)).to_pylist()], _CHUNKS.field(1).type), pa.array([names.to_pylist()], _CHUNKS.field(2).type), pa.array([dense.tobytes()], pa.binary())], schema=_CHUNKS
        )


def _whole_bincount(cell: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """bincount with whole weights, exact beyond 2**53."""
    low = np.bincount(cell, n & 0xFFFFFF, size).astype(np.int64)
    return low + (np.bincount(cell, n >> 24, size).astype(np.int64) << 24)


def _chunked(least_docs: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows in; they are gathered up to a change of language, or to a change of term beyond some rows."""
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t)
            rows += len(t)
            if rows < cells // 4:
                continue
            t = pa.concat_tables(held)
            last = len(t) - 1
            same = pc.and_(pc.equal(t["lang"], t["lang"][last]), pc.equal(t["term"], t["term"][last]))
            cut = len(t) - pc.sum(same).as_py()
            yield from by_lang(t.slice(0, cut))
            held, rows = [t.slice(cut)], len(t) - cut
        if held:
            yield from by_lang(pa.concat_tables(held))

    def by_lang(t: pa.Table):
        if not len(t):
            return
        code = t["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(t)]
        for a, b in zip(cut[:-1], cut[1:]):
            yield from _dense(t.slice(a, b - a), least_docs, cells)

    return run


def kept_chunks(counts: DataFrame, least_docs: int = LEAST_DOCS, cells: int = CELLS) -> DataFrame:
    """Dense vectors: per chunk lang, terms (sorted), sources (of the chunk), counts (int64, source by source)."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = counts.where("term <> ''").repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
    return ranged.select("lang", "term", "source", "n", "docs").mapInArrow(tidy(_chunked(least_docs, cells)), CHUNKS)


_SUMS = "lang string, source string, terms long, n long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its kept terms (source null), and the sum of each source's counts."""
    for batch in batches:
        for r in batch.to_pylist():
            dense = np.frombuffer(r["counts"], np.int64).reshape(len(r["sources"]), -1)
            yield pa.RecordBatch.from_pydict(
                {"lang": [r["lang"]] * (1 + len(dense)), "source": [None, *r["sources"]], "terms": [len(r["terms"])] + [0] * len(dense), "n": [0, *dense.sum(1).tolist()]},
                schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", pa.int64()), ("n", pa.int64())]),
            )


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (total + kept)), in whole numbers."""
    below = np.asarray(total + kept, np.int64)
    whole, rest = np.divmod(count + 1, below)
    for step in SCALE_STEPS:
        more, rest = np.divmod(rest * step, below)
        whole = whole * step + more
    return whole + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


_PARTS = "lang string, source string, part string, item string, value long"
_PARTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class _Best:
    """What a task knows of a language: sums by pair of its sources, and each source's best terms so far."""

    def __init__(self, sources: list[str], top: int) -> None:
        self.sources, self.top = sources, top
        self.pair = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def take(self, p: np.ndarray, q: np.ndarray, occurs: np.ndarray, terms: list[str]) -> None:
        """Shares of sources (rows) and language in some terms, in order."""
        for j in range(len(self.sources)):
            self.pair[:, j] += excess(p, p[j]).sum(1)
        over = np.where(occurs & (p > q), excess(p, q), -1)
        for i in range(len(self.sources)):
            at = np.flatnonzero(over[i] >= 0)
            at = at[np.argsort(-over[i][at], kind="stable")[: self.top]]  # equal values: the smaller id, which is the smaller term
            both = [*self.best[i], *zip(over[i][at].tolist(), [terms[k] for k in at.tolist()])]
            self.best[i] = sorted(both, key=lambda x: (-x[0], x[1]))[: self.top]

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        for i, s in enumerate(self.sources):
            others = [j for j in range(len(self.sources)) if j != i]
            values = self.pair[i, others].tolist() + [v for v, _ in self.best[i]]
            items = [self.sources[j] for j in others] + [t for _, t in self.best[i]]
            parts = ["pair"] * len(others) + ["term"] * len(self.best[i])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(values), "source": [s] * len(values), "part": parts, "item": items, "value": values}, schema=_PARTS_ARROW)


def _valued(top: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks beside their language's sources, totals and number of kept terms: sums by pair, and each source's best terms, of all chunks of the task."""
        known: dict[str, _Best] = {}
        for batch in batches:
            for r in batch.to_pylist():
                every, totals, kept, terms = r["every"], np.array(r["totals"], np.int64), r["kept"], r["terms"]
                best = known.setdefault(r["lang"], _Best(every, top))
                place = {s: i for i, s in enumerate(every)}
                found = np.frombuffer(r["counts"], np.int64).reshape(len(r["sources"]), -1)
                rows, step = np.array([place[s] for s in r["sources"]]), max(1, cells // len(every))
                for a in range(0, len(terms), step):
                    dense = np.zeros((len(every), min(step, len(terms) - a)), np.int64)
                    dense[rows] = found[:, a : a + step]
                    best.take(share(dense, totals[:, None], kept), share(dense.sum(0), totals.sum(), kept), dense > 0, terms[a : a + step])
        for lang, best in known.items():
            yield from best.rows(lang)

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair`, the other sources of the language by divergence from
    the source to them; part `term`, the source's `top` terms that stand out of the language."""
    counts = materialise(term_counts(docs))
    dense = materialise(kept_chunks(counts, least_docs, cells))
    sums = dense.select("lang", "terms", "sources", "counts").mapInArrow(_sums, _SUMS).groupBy("lang", "source").agg(F.sum("terms").alias("terms"), F.sum("n").alias("n"))
    kept = sums.where("source IS NULL").select("lang", F.col("terms").alias("kept"))
    totals = counts.where("term = ''").select("lang", "source").join(sums.where("source IS NOT NULL").select("lang", "source", "n"), ["lang", "source"], "left")
    named = F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))
    groups = totals.groupBy("lang").agg(named.alias("g")).join(kept, "lang", "left").select("lang", F.col("g.source").alias("every"), F.col("g.n").alias("totals"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))
    # written, so that the planner knows its size and sends it to all tasks only where it is small; beyond that, salts deal a language's chunks out
    groups = materialise(groups)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = dense.withColumn("salt", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(SALTS)).cast("int"))
    parts = dealt.join(salted, ["lang", "salt"]).select("lang", "terms", "sources", "counts", "every", "totals", "kept").mapInArrow(tidy(_valued(top, cells)), _PARTS)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    nothing = groups.where("kept = 0").select("lang", F.explode("every").alias("source"), "every").select("lang", "source", F.lit("pair").alias("part"), F.explode("every").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    by_value = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(nothing).withColumn("rank", by_value)
    terms = parts.where("part = 'term'").withColumn("rank", by_value).where(F.col("rank") <= top)
    return ranked.unionByName(terms)


DIVERGENCE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (SELECT gt.*, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY gt.lang, gt.source) + v) AS p FROM gt JOIN v USING (lang)),
lp AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM gt GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT gp.lang, source, gp.term AS item, (p - q) * (p - q) // q AS value FROM gp JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM every
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 200
"""
