"""N-gram Jaccard join of whole texts by size, heavy and light.

A text's set holds its distinct five-word shingles (lower-cased A-Z; a text of fewer
words is one shingle; without words the set is empty and links with nothing). Texts
link when 100 * |A and B| >= 75 * |A or B|.

Texts with equal sets are one class, and only the class takes part. Of the rest:

* Light sets (up to a boundary size): for each partner size b that a set of size a can
  link with, its subsets of the needed overlap c(a, b) are enumerated. Two sets of sizes
  a and b link exactly when they share such a subset, so these links need no check.
* Heavy sets scan inverted lists. By a common order of shingles, rare first, two linked
  sets share one of the first n - ceil(0.75 n) + 1 shingles of both, so only those are
  indexed. The order is by counts of all shingles, gathered into a sketch of fixed size
  (any order gives right results; a good one gives short lists).

The boundary is the size that costs least: subsets enumerated below it against postings
and checks above it, from the histogram of small sizes.

Pairs from lists that bitmaps of the sets do not rule out are checked on whole sets. A short list yields all its pairs. A long one
yields a star per size band first. After components are known, the long lists that lie
mainly in one component are one group, and its members outside that component are compared
with all others of the group, in blocks: by bitmaps first, and those that have a possible partner
by whole sets. So a large family of near copies costs one check per
member and list, and no link is lost. The sketch fills up as a table grows, so that more lists are
long there without links in them; these cost bitmaps, a 32nd to a 16th of their sets.

Inside, a set goes by an id of its own, 64 bits of its 128-bit hash (hashed anew should two
sets ever get the same one), so that copies are one set and the texts of one doc_id are several.

Null texts have empty sets; rows with one doc_id count as one document, linked with the
texts of all of them (but keep_one_of_each treats each text by itself); a null doc_id is returned as its own class. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import U64, WORD_ROLLERS, chunks, materialise, mixed, signed, tidy, windows
from .components import components
from .exchange import SCHEMA, bucket_count, dealt, reduced

SHINGLE = 5
PERCENT = 75
SLOTS, PARTS = 1 << 22, 64
SHORT_LIST = 8
BLOCK = 1 << 16
"""Shingles of a block of whole sets (512 KB)."""
MAP_BLOCK, MAP_WEIGHT = 1 << 20, 256
"""Shingles of a block of bitmaps (512 KB at most), and how many more each set counts as."""
LARGEST_LIGHT = 20
"""The largest size for which cost may choose subsets: those of one larger set would fill a worker's memory."""
CHECK_COST = 8.0
"""Cost of one posting of a heavy set, its list's checks included, in subsets enumerated."""
FLUSH = 400_000
MARKS = 1 << 25
"""Bits that tell which texts have pairs to check (4 MB)."""


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def partner_sizes(a: int, percent: int = PERCENT) -> range:
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def shingle_sets(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in order of text and value, and where each text's begin, and their sizes."""
    w = chunk.words(lower=True)
    sums = WORD_ROLLERS[0].sums(w.code)
    begin, text = windows(w.sizes, w.at, SHINGLE)
    few = np.flatnonzero((w.sizes > 0) & (w.sizes < SHINGLE))
    h = np.concatenate([WORD_ROLLERS[0].of(sums, begin, begin + SHINGLE), WORD_ROLLERS[0].of(sums, w.at[few], w.at[few + 1]) ^ U64(0xA5A5)])
    text = np.concatenate([text, few])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    at = np.searchsorted(text, np.arange(len(w.sizes) + 1))
    return h, at, np.diff(at)


def set_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(h ^ U64(salt)), dtype=U64)])
        out.append(mixed(sums[at[1:]] - sums[at[:-1]]))
    return out[0], out[1]


def set_ids(s1: np.ndarray, s2: np.ndarray, salt: int) -> np.ndarray:
    return signed(mixed(s1 ^ mixed(s2 + U64(salt))))


def parities(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap of each set: bit p tells whether an odd number of its shingles end in p. Its bits are a power of two, two a shingle or more.

    The bits in which two sets' bitmaps differ, the longer one folded by exclusive or, are at most the
    shingles that only one of them has."""
    n = np.diff(at)
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    odd = np.zeros(begin[-1], np.uint8)
    np.add.at(odd, np.repeat(begin[:-1], n) + (h & np.repeat(bits - 1, n).astype(U64)).astype(np.int64), 1)
    packed, begin = np.packbits(odd & 1), begin // 8
    return [packed[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


META = "doc_id long, n_shingles long, s1 long, s2 long, parity binary, part int, counts binary, node long"
_META = ["doc_id", "n_shingles", "s1", "s2", "parity", "part", "counts", "node"]


def meta(docs: DataFrame, salt: int = 0) -> DataFrame:
    """Per row: doc_id, size, 128 bits, bitmap and id (node) of its set (part null); and each task's shingle counts (part not null), up to 255."""

    def run(batches):
        counts = None
        for batch in batches:
            out, parity = [], []
            for chunk in chunks(batch.column("text")):
                h, at, n = shingle_sets(chunk)
                parity += parities(h, at)
                if counts is None:
                    counts = np.zeros(SLOTS, np.uint32)
                np.add.at(counts, (h & U64(SLOTS - 1)).astype(np.int64), 1)
                out.append((n, *set_hashes(h, at)))
            if out:
                n, s1, s2 = (np.concatenate(x) for x in zip(*out))
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(parity, pa.binary()), none.cast(pa.int32()), pa.nulls(len(n), pa.binary()), pa.array(set_ids(s1, s2, salt))], _META)
        if counts is not None:
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(PARTS, -1)
            none = pa.nulls(PARTS).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), none], _META)

    return docs.mapInArrow(tidy(run), META)


def shingle_ranks(rows: DataFrame) -> np.ndarray:
    """A rank by frequency for each slot of the sketch; its size is fixed, so it can be sent to all tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), np.uint8)
                sums[part] = sums[part] + x if part in sums else x.astype(np.uint64)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(np.log2(x + 1.0) * 4, 255).astype(np.uint8).tobytes()], pa.binary())], ["part", "ranks"])

    got = rows.where("part IS NOT NULL").select("part", "counts").repartition(min(PARTS, tasks), "part").mapInArrow(add, "part int, ranks binary").collect()
    out = np.zeros(SLOTS, np.uint8).reshape(PARTS, -1)
    for r in got:
        out[r["part"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(-1)


def light_boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The largest size whose sets are light: the one of least total cost."""
    subsets = {n: sum(comb(n, needed(n, b, percent)) for b in partner_sizes(n, percent) if needed(n, b, percent) <= n) for n in range(1, LARGEST_LIGHT + 1)}

    def cost(boundary: int) -> float:
        light = sum(histogram.get(n, 0) * subsets[n] for n in range(1, boundary + 1))
        first = -(-percent * (boundary + 1) // 100)
        return light + CHECK_COST * sum(histogram.get(n, 0) * int(prefix_length(np.array(n), percent)) for n in range(first, LARGEST_LIGHT + 1))

    return min(range(LARGEST_LIGHT + 1), key=cost)


_POSTING = np.dtype([("t", "<u4"), ("doc", "<i8"), ("n", "<u4")])
_SUBSET = np.dtype([("t", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("least", "u1")])
PAIRS = "kind int, a long, b long, docs array<long>, sizes array<long>"
"""kind 0: a pair to check; 1: a link that needs no check; 2: a long list (a: its id)."""


def candidates(docs: DataFrame, ranks, boundary: int, percent: int = PERCENT, salt: int = 0) -> DataFrame:
    """Pairs to check, links, and long lists (PAIRS), by ids of sets."""
    buckets = bucket_count(docs)
    heavy_from = -(-percent * (boundary + 1) // 100)

    def light(h: np.ndarray, doc: int, out: list) -> None:
        a = len(h)
        for b in partner_sizes(a, percent):
            c = needed(a, b, percent)
            if c <= a and c <= b and b <= boundary:
                chosen = np.array(list(combinations(range(a), c)), np.int64)
                key = np.zeros(len(chosen), U64)
                for j in range(c):  # h is in order, so a subset has one spelling
                    key = mixed(key * U64(31) + h[chosen[:, j]])
                r = np.zeros(len(chosen), _SUBSET)
                r["t"], r["doc"], r["n"], r["least"] = mixed(key ^ U64(min(a, b) << 8 | max(a, b))), doc, a, a == min(a, b)
                out.append(r)

    def scan(batches):
        rank = ranks.value
        held, subsets, size, seen = [], [], 0, set()

        def send():
            if held:
                key, doc, n = (np.concatenate(x) for x in zip(*held))
                r = np.zeros(len(key), _POSTING)
                r["t"], r["doc"], r["n"] = key.astype(np.uint32), doc, n
                yield dealt(r, key, buckets, 0)
            if subsets:
                r = np.concatenate(subsets)
                yield dealt(r, r["t"], buckets, 1)
            held.clear()
            subsets.clear()

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                h, at, n = shingle_sets(chunk)
                s1, s2 = set_hashes(h, at)
                doc = set_ids(s1, s2, salt)
                use = np.zeros(len(n), bool)
                for i, k in enumerate(zip(s1.tolist(), s2.tolist())):
                    if n[i] and k not in seen:
                        seen.add(k)
                        use[i] = True
                        if n[i] <= boundary:
                            light(h[at[i] : at[i + 1]], int(doc[i]), subsets)
                use &= n >= heavy_from
                text = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, rank[(h & U64(SLOTS - 1)).astype(np.int64)], text))
                place = np.arange(len(h)) - np.repeat(at[:-1], n)
                take = (place < prefix_length(n, percent)[text]) & use[text]
                held.append((mixed(h[order[take]]), doc[text[take]], n[text[take]]))
                size += int(take.sum())
                if size > FLUSH:
                    yield from send()
                    size = 0
                    seen.clear()
        yield from send()

    def reduce(got):
        p, pairs, lists, done = got[0], [], [], set()
        p = p[np.lexsort((p["doc"], p["n"], p["t"]))]
        if len(p):  # several tasks may send one set
            p = p[np.concatenate([[True], (p["t"][1:] != p["t"][:-1]) | (p["doc"][1:] != p["doc"][:-1])])]
        new = np.ones(len(p), bool)
        new[1:] = p["t"][1:] != p["t"][:-1]
        at = np.concatenate([np.flatnonzero(new), [len(p)]])
        for i in np.flatnonzero(np.diff(at) > 1):
            doc, n = p["doc"][at[i] : at[i + 1]], p["n"][at[i] : at[i + 1]].astype(np.int64)
            raw = doc.tobytes()
            if raw in done:
                continue
            done.add(raw)
            if len(doc) <= SHORT_LIST:
                x, y = np.triu_indices(len(doc), 1)
                ok = (100 * n[x] >= percent * n[y]) & (doc[x] != doc[y])
                pairs.append((doc[x[ok]], doc[y[ok]]))
                continue
            hub, hubs = 0, []
            while hub < len(doc):  # each size band has its hub, its smallest set
                end = int(np.searchsorted(n, 100 * n[hub] // percent, "right"))
                pairs.append((np.full(end - hub - 1, doc[hub]), doc[hub + 1 : end]))
                hubs.append(hub)
                hub = end
            order = np.argsort(doc, kind="stable")
            name = int.from_bytes(hashlib.blake2b(doc[order].tobytes(), digest_size=8).digest(), "little", signed=True)
            lists.append((name, doc[order].tolist(), n[order].tolist()))
        a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        kinds, sub = [], got[1]
        ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        ab = ab[:, ab[0] != ab[1]]
        if len(sub):
            sub = sub[np.lexsort((sub["doc"], 1 - sub["least"], sub["t"]))]
            new = np.ones(len(sub), bool)
            new[1:] = sub["t"][1:] != sub["t"][:-1]
            first = sub[new][np.cumsum(new) - 1]
            ok = (first["least"] > 0) & (first["doc"] != sub["doc"])  # without a member of the smaller size nothing follows
            sure = np.stack([np.minimum(first["doc"], sub["doc"])[ok], np.maximum(first["doc"], sub["doc"])[ok]])
            sure = np.unique(sure, axis=1) if sure.shape[1] else sure
        else:
            sure = np.zeros((2, 0), np.int64)
        kinds = [0] * ab.shape[1] + [1] * sure.shape[1] + [2] * len(lists)
        a = np.concatenate([ab[0], sure[0], np.array([x[0] for x in lists], np.int64)])
        b = np.concatenate([ab[1], sure[1], np.zeros(len(lists), np.int64)])
        none, whole = [None] * (len(a) - len(lists)), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(a), pa.array(b), pa.array(none + [x[1] for x in lists], whole), pa.array(none + [x[2] for x in lists], whole)],
            ["kind", "a", "b", "docs", "sizes"],
        )

    return reduced(docs.where("doc_id IS NOT NULL").mapInArrow(tidy(scan), SCHEMA), {0: _POSTING, 1: _SUBSET}, reduce, PAIRS)


def marked(ids: DataFrame) -> np.ndarray:
    """MARKS bits, in 64-bit words: those that doc_ids hash to are set. Of fixed size, so it can be sent to all tasks."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    got = ids.select(place.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def whole_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """doc_id (a set's id), shingles (binary): each set in wanted (doc_id) once; reps: doc_ids that have them.

    Marks of the reps let most other texts go before they are read, and the join decides."""
    marks = docs.sparkSession.sparkContext.broadcast(marked(reps))

    def run(batches):
        bits = marks.value
        seen: set[int] = set()
        for batch in batches:
            p = batch.column("_p").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[p >> 6] >> (p & 63)) & 1 == 1))
            for chunk in chunks(batch.column("text")):
                h, at, n = shingle_sets(chunk)
                ids, out = set_ids(*set_hashes(h, at), salt), []
                for i, node in enumerate(ids.tolist()):
                    if n[i] and node not in seen:
                        seen.add(node)
                        out.append((node, h[at[i] : at[i + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "shingles"])

    rows = docs.where("doc_id IS NOT NULL").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("_p"))
    found = rows.mapInArrow(tidy(run), "doc_id long, shingles binary").join(wanted, "doc_id", "left_semi")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(1)))).where("_n = 1").drop("_n")


def ids_of(texts: pa.Array, salt: int) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for chunk in chunks(texts):
        h, at, _ = shingle_sets(chunk)
        out.append(set_ids(*set_hashes(h, at), salt))
    return np.concatenate(out)


def bitmaps(ids: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node, n, p: size and bitmap of each set in ids (node), from the rows of META of its class's least doc_id."""
    reps = classes.join(ids, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node")
    return rows.join(reps, ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.max("n_shingles").alias("n"), F.max("parity").alias("p")).select("node", "n", "p")


def possible(pairs: DataFrame, rows: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of sets that sizes and bitmaps of rows (META) do not rule out; no pair that links is lost."""
    one = bitmaps(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), rows, classes)

    def run(batches):
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("pa"), batch.column("pb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                apart = np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0) ^ small
                ok.append(int(np.bitwise_count(apart).sum()) <= na + nb - 2 * needed(na, nb, percent))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return pairs.select("a", "b").join(one.toDF("b", "nb", "pb"), "b").join(one.toDF("a", "na", "pa"), "a").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(tidy(run), "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link, checked on whole sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                i = np.searchsorted(large, small)
                both = int((large[np.minimum(i, len(large) - 1)] == small).sum()) if len(large) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def joining(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the edges (a, b) that join what those before them leave apart."""
    at: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := at.setdefault(x, x)) != x:
            at[x] = at.setdefault(y, y)
            x = at[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            at[max(x, y)] = min(x, y)
            out.append(k)
    return out


def block_pairs(group: DataFrame, values: DataFrame, value: str, weight, most: int) -> DataFrame:
    """group: main, doc_id, n, c (component). left, right: blocks of each group, every one of members outside component `main` beside every one
    of all members, as arrays of doc_id, n, c and the value that values (doc_id, value) has for each.

    Members are dealt by hash into blocks of about `most` in weight, and the blocks of a group by the right block's
    number; a task holds two blocks at a time."""
    parts = group.groupBy("main").agg(F.ceil(F.sum(weight) / most).alias("rights"), F.ceil(F.sum(F.when(F.col("c") != F.col("main"), weight)) / most).alias("lefts")).where("lefts > 0")
    member = F.struct("doc_id", "n", "c", value)

    def blocks(members: DataFrame, count: str, name: str, *keep: str) -> DataFrame:
        placed = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col(count))).join(values, "doc_id")
        return placed.groupBy("main", "part", *keep).agg(F.collect_list(member).alias(name))

    some = group.join(parts, "main")
    left = blocks(some.where("c <> main"), "lefts", "left", "rights").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights").cast("long") - 1)))
    return left.join(blocks(some, "rights", "right"), ["main", "part"]).select("main", "left", "right")


def near_members(group: DataFrame, maps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """main, doc_id: the members of each group that may link with one of another component, one of both outside component `main`;
    sizes and bitmaps (maps: doc_id, p) rule out the others. No member of a link is lost."""

    def rows(items):
        x = items.values
        return x.field("doc_id").to_numpy(), x.field("n").to_numpy(), x.field("c").to_numpy(), [v.as_buffer() for v in x.field("p")]

    def by_length(raw) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes, places, bitmaps as rows) of the bitmaps of each length."""
        size = np.array([v.size for v in raw])
        return [(k, at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), k)) for k in np.unique(size).tolist() for at in [np.flatnonzero(size == k)]]

    def compare(batches):
        for batch in batches:
            for main, left, right in zip(batch.column("main").to_pylist(), batch.column("left"), batch.column("right")):
                a, na, ca, pa_ = rows(left)
                b, nb, cb, pb = rows(right)
                near_a, near_b, others = np.zeros(len(a), bool), np.zeros(len(b), bool), by_length(pb)
                for ka, ia, xa in by_length(pa_):
                    for kb, ib, xb in others:
                        if max(ka, kb) > 2 * min(ka, kb):  # sizes that can link have bitmaps of one length or of the next
                            continue
                        k = min(ka, kb)
                        x, y = (np.ascontiguousarray(np.bitwise_xor.reduce(z.reshape(len(z), -1, k), axis=1)).view(np.uint64) for z in (xa, xb))
                        for i, one in zip(ia.tolist(), x):
                            n = na[i] + nb[ib]
                            fit = np.flatnonzero((cb[ib] != ca[i]) & (100 * np.minimum(na[i], nb[ib]) >= percent * np.maximum(na[i], nb[ib])))
                            apart = np.bitwise_count(y[fit] ^ one).sum(axis=1, dtype=np.int64)
                            hit = fit[apart <= (n - 2 * -(-percent * n // (100 + percent)))[fit]]
                            near_a[i] |= len(hit) > 0
                            near_b[ib[hit]] = True
                found = np.unique(np.concatenate([a[near_a], b[near_b]]))
                yield pa.RecordBatch.from_arrays([pa.array([main] * len(found), pa.int64()), pa.array(found)], ["main", "doc_id"])

    pairs = block_pairs(group, maps, "p", F.col("n") + MAP_WEIGHT, MAP_BLOCK)
    return pairs.mapInArrow(tidy(compare), "main long, doc_id long").distinct()


def linked_rest(group: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """group: main, doc_id, n, c (component). Of the links between a member outside component `main` and any member of another
    component, as many from each pair of blocks as join the same components."""

    def rows(items):
        x = items.values
        raw = [v.as_buffer() for v in x.field("shingles")]
        return x.field("doc_id").to_numpy(), x.field("n").to_numpy(), x.field("c").to_numpy(), np.array([v.size // 8 for v in raw]), np.frombuffer(b"".join(raw), U64)

    def compare(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, na, ca, sa, ha = rows(left)
                b, nb, cb, sb, hb = rows(right)
                token = np.intersect1d(ha, hb)  # only shingles of both blocks count
                x, y = np.repeat(np.arange(len(a)), sa), np.repeat(np.arange(len(b)), sb)
                ia, ib = np.isin(ha, token), np.isin(hb, token)
                x, wa, y, wb = x[ia], np.searchsorted(token, ha[ia]), y[ib], np.searchsorted(token, hb[ib])
                both = np.zeros((len(a), len(b)), np.float32)
                for lo in range(0, len(token), 4096):
                    ja, jb = (wa >= lo) & (wa < lo + 4096), (wb >= lo) & (wb < lo + 4096)
                    p, q = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
                    p[x[ja], wa[ja] - lo] = 1
                    q[y[jb], wb[jb] - lo] = 1
                    both += p @ q.T
                ok = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :])
                i, j = np.nonzero(ok)
                use = joining(ca[i], cb[j])
                yield pa.RecordBatch.from_arrays([pa.array(a[i[use]]), pa.array(b[j[use]])], ["a", "b"])

    return block_pairs(group, sets, "shingles", F.col("n"), BLOCK).select("left", "right").mapInArrow(tidy(compare), "a long, b long")


def labelled(docs: DataFrame, percent: int, whole_documents: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows of META; classes: node, rep (least doc_id), n; the component of each linked node (node, component); the salt of the ids.

    Classes of equal sets are the vertices, so copies take no part. With whole_documents, the classes of one doc_id are linked."""
    spark, salt = docs.sparkSession, 0
    while True:
        everything = materialise(meta(docs, salt))
        rows = everything.where("part IS NULL")
        ends = [f(c).alias(f"{name}_{c}") for c in ("s1", "s2") for name, f in (("lo", F.min), ("hi", F.max))]
        classes = materialise(rows.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), *ends))
        if not classes.where("lo_s1 <> hi_s1 OR lo_s2 <> hi_s2").take(1):
            break
        salt += 1
    classes = classes.where("n > 0").select("node", "rep", "n")
    ranks = spark.sparkContext.broadcast(shingle_ranks(everything))
    sizes = {r["n_shingles"]: r["n"] for r in rows.where(f"n_shingles BETWEEN 1 AND {LARGEST_LIGHT}").groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    found = materialise(candidates(docs, ranks, light_boundary(sizes, percent), percent, salt).distinct())
    pairs = materialise(possible(found.where("kind = 0"), rows, classes, percent))

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted, classes["node"] == wanted["doc_id"], "left_semi").select(F.col("rep").alias("doc_id"))
        return materialise(whole_sets(docs, reps, wanted, salt))

    sets = sets_of(materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()))
    links = linked(pairs, sets, percent).unionByName(found.where("kind = 1").select("a", "b"))
    if whole_documents:
        several = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
        texts = rows.where("n_shingles > 0").select("doc_id", F.col("node").alias("b"))
        links = links.unionByName(several.join(texts, "doc_id").where("a <> b").select("a", "b").distinct())
    links = materialise(links)
    label = components(links)
    if len(found.where("kind = 2").take(1)):
        label = materialise(label)
        long = _members(found)
        long = materialise(long.join(label, long["doc_id"] == label["node"], "left").select("list", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")))
        main = materialise(long.groupBy("list", "c").agg(F.count("*").alias("k")).groupBy("list").agg(F.max_by("c", F.struct("k", "c")).alias("main")))
        # lists of one main component are one group; its members outside that component are compared with all others, in blocks
        group = materialise(long.join(main, "list").groupBy("main", "doc_id").agg(F.max("n").alias("n"), F.max("c").alias("c")))
        # most lists of a large table have no links: only members that bitmaps leave a partner send their whole sets
        maps = bitmaps(group.select(F.col("doc_id").alias("node")).distinct(), rows, classes).select(F.col("node").alias("doc_id"), "p")
        group = materialise(group.join(near_members(group, maps, percent), ["main", "doc_id"], "left_semi"))
        if not group.take(1):
            return rows, classes, label, salt
        more = linked_rest(group, sets_of(materialise(group.select("doc_id").distinct())), percent)
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))  # a star for each component
    return rows, classes, label, salt


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    rows, classes, label, _ = labelled(docs.select("doc_id", "text"), percent, True)
    named = materialise(classes.join(label, "node").select("node", "component", "rep"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    # one row per linked class, as plain rows of a table, so that AQE can split the rows of a class that many texts belong to
    named = materialise(named.join(least, "component").select("node", "least"))
    alone = materialise(classes.select("node", "rep").join(named, "node", "left").select(F.col("node").alias("_node"), F.coalesce("least", "rep").alias("least")))
    out = rows.join(alone, (rows["node"] == alone["_node"]) & (rows["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("least")), F.col("doc_id")).alias("component_id"))


def _members(found: DataFrame) -> DataFrame:
    """The members of the long lists: list, doc_id, n."""
    return found.where("kind = 2").select(F.col("a").alias("list"), F.explode(F.arrays_zip("docs", "sizes")).alias("m")).select(
        "list", F.col("m.docs").alias("doc_id"), F.col("m.sizes").alias("n")
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of texts, that of the least doc_id; near copies go, whatever their doc_id, and so do repeated rows. Empty texts stay, once per doc_id."""
    rows, classes, label, salt = labelled(docs.select("doc_id", "text"), percent, False)
    label = label.toDF("node", "component")
    first = classes.join(label, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min(F.struct("rep", "node")).alias("m")).select("m.*").toDF("_doc", "_node")
    first = materialise(first.unionByName(rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node")).distinct()))
    times = materialise(rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("_k")))
    several = times.where("_k > 1").select("_doc")
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"))
    # where a doc_id has one row, it tells the row; the rows of the others are told by their sets
    kept = named.join(first.join(times.where("_k = 1"), "_doc").select("_doc"), "_doc", "left_semi").select("_row")
    kept = kept.unionByName(named.where("_doc IS NULL").select("_row"))
    if not several.take(1):
        return kept.select("_row.*")

    def run(batches):
        for batch in batches:
            texts = batch.column("_row").field("text")
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_doc"), pa.array(ids_of(texts, salt))], ["_row", "_doc", "_node"])

    schema = StructType([*named.schema.fields, StructField("_node", LongType())])
    told = named.join(several, "_doc", "left_semi").select("_row", "_doc").mapInArrow(tidy(run), schema)
    # a doc_id's rows stay together, so the order in a group is by the row itself
    order = Window.partitionBy("_doc", "_node").orderBy(F.xxhash64("_row"))
    told = told.join(first, ["_doc", "_node"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row")
    return kept.unionByName(told).select("_row.*")


JACCARD_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS h FROM (
        SELECT doc_id, w[i + 1 : i + 5] AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
