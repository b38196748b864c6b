"""Approximate nearest neighbours by additive quantisation.

A vector (scaled to length one) lies in the cell of the nearest of some centroids of a bounded
sample. Its difference from the centroid, scaled to length one again, is approximated by a sum of
codewords, one from each of several full-dimensional codebooks, so the error shrinks with the
difference and nearly equal vectors stay apart. Codebooks start as residual k-means on the sample
and are refitted by least squares against beam-search encodings. Every vector is indexed: beam
search keeps the best partial sums over the codebooks; the scale and the norm of the approximated
difference are stored with the codes.

A query scans the codes of its nearest cells, in blocks: the squared distance is read from lookup
tables of products of codewords and the query's own difference from the centroid, and from the
stored scales and norms. Each block gives twice its even share of the number that is reranked, and
the best of all its blocks together, that number, are reranked by exact cosine in double precision
on original vectors, which are fetched by key; codes, scales and norms alone take part in the scan.

How many cells a query visits and how many vectors are reranked is measured: some queries are also
answered exactly. So many cells are visited as hold nearly all of their true neighbours, and the
number of reranked vectors is doubled until enough of these are found (at the end all vectors of
all cells are reranked, so the target is always reached).
`exact=True` answers all queries exactly, in blocks.

Equal vectors are indexed once, with the smallest few ids of each, so copies of one vector
cannot crowd out others. Null, zero, or non-finite vectors take no part. Vectors of different
lengths are not comparable, so each length is a search of its own. Ties go to the smaller id; rows
with one id are candidates of their own. With fewer candidates than asked for, all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy

BOOKS, WORDS, BEAM = 32, 64, 4
SAMPLE = 8192
"""At most so many distinct vectors train the codebooks; every vector is indexed."""
REFITS = 1
CELL, CELLS = 1024, 512
"""Vectors that a cell should have, and the most cells: the sample must fill them."""
BLOCK = 4096
QUERIES = 512
RERANK = 192
"""Where the search for enough reranked vectors begins."""
TRIALS, TARGET, REACH = 64, 0.95, 0.99
"""Queries that are also answered exactly, the share of their true neighbours to be found, and the share that visited cells must hold."""


def usable(column: str):
    c = F.col(column)
    number = F.transform(c, lambda x: x.cast("double"))
    return (
        c.isNotNull()
        & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(number, lambda x: x != 0)
    )


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)
        for j in range(len(centre)):
            if (m := near == j).any():
                centre[j] = x[m].mean(0)
    return np.concatenate([centre, np.zeros((k - len(centre), x.shape[1]))])


class AdditiveQuantiser:
    """books: codewords by codebook, (BOOKS, WORDS, dimension)."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books
        self.square = (books**2).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, refits: int = REFITS, seed: int = 7) -> "AdditiveQuantiser":
        rng, rest, out = np.random.default_rng(seed), x.copy(), []
        for _ in range(books):
            book = kmeans(rest, words, rng)
            rest = rest - book[np.argmin((book**2).sum(1) - 2 * rest @ book.T, axis=1)]
            out.append(book)
        model = cls(np.stack(out))
        for _ in range(refits):  # least squares of the codewords, given the codes
            codes = model.encode(x)[0].astype(np.int64)
            b = np.zeros((len(x), books * words))
            for m in range(books):
                b[np.arange(len(x)), m * words + codes[:, m]] = 1
            gram = b.T @ b + 0.05 * np.eye(books * words)
            old = model.books.reshape(books * words, -1)
            model = cls(np.linalg.solve(gram, b.T @ x + 0.05 * old).reshape(books, words, -1))
        return model

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, BOOKS) and squared norms of the approximations, by beam search."""
        n = len(x)
        codes, sums, loss = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, x.shape[1])), np.zeros((n, 1))
        for m, book in enumerate(self.books):
            rest = x[:, None, :] - sums
            step = loss[:, :, None] * 0 + (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + self.square[m]
            flat = step.reshape(n, -1)
            k = min(beam, flat.shape[1])
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            which, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, which], word[:, :, None].astype(np.uint8)], axis=2)
            sums = sums[row, which] + book[word]
            loss = flat[row, best]
        best, row = np.argmin(loss, axis=1), np.arange(n)
        return codes[row, best], (sums[row, best] ** 2).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries and codewords, (n, BOOKS, WORDS)."""
        return np.einsum("qd,mwd->qmw", q, self.books)


def _distinct(rows: DataFrame, dimension: int, ids: int, kind: str) -> DataFrame:
    """vector (bytes of `kind`), ids: each distinct vector once, with its `ids` smallest ids."""

    def run(batches):
        held: dict[bytes, list[int]] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(v)[:ids] for v in held.values()], pa.list_(pa.int64()))], ["vector", "ids"])
            held.clear()

        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dimension)
            for i, x in zip(batch.column("id").to_pylist(), flat):
                v = held.setdefault(x.tobytes(), [])
                v.append(i)
                if len(v) > 64:
                    v[:] = sorted(v)[:ids]
            if len(held) > 20_000:
                yield from flush()
        if held:
            yield from flush()

    one = rows.mapInArrow(tidy(run), "vector binary, ids array<long>")
    # at most `ids` ids from each task meet here
    return one.groupBy("vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))


def _matrix(column, kind: str, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimension).astype(np.float64)


def _trained(sample: DataFrame, cells: int, kind: str, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks and centroids, trained in one task on the sample; only they go to the driver."""

    def train(batches):
        x = [_matrix(b.column("vector"), kind, dimension) for b in batches]
        x = unit(np.concatenate(x))
        x = x[np.lexsort(x.T)]  # whatever the order of arrival, so that reruns agree
        centre = kmeans(x, cells, np.random.default_rng(5))[: min(cells, len(x))]
        books = AdditiveQuantiser.fit(_differences(x, centre)[1]).books
        yield pa.RecordBatch.from_arrays([pa.array([books.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary())], ["books", "centre"])

    got = sample.repartition(1).mapInArrow(tidy(train), "books binary, centre binary").first()
    return np.frombuffer(got["books"]).reshape(BOOKS, WORDS, dimension), np.frombuffer(got["centre"]).reshape(-1, dimension)


def _near(x: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row."""
    d = (centre**2).sum(1) - 2 * x @ centre.T
    return np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centre) else np.tile(np.arange(len(centre)), (len(x), 1))


def _differences(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each row, its difference from the centroid scaled to length one (zero if equal), and the scale."""
    cell = _near(x, centre, 1)[:, 0]
    rest = x - centre[cell]
    scale = np.sqrt(np.einsum("ij,ij->i", rest, rest))
    return cell, rest / np.where(scale > 0, scale, 1)[:, None], scale


def _coded(index: DataFrame, books: np.ndarray, centre: np.ndarray, kind: str, dimension: int) -> DataFrame:
    """cell, key, codes, scale, norm of every vector of the index."""

    def encode(batches):
        quantiser = AdditiveQuantiser(books)
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                cell, rest, scale = _differences(unit(_matrix(part.column("vector"), kind, dimension)), centre)
                codes, norms = quantiser.encode(rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), part.column("key"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), pa.array((scale**2 * norms).astype(np.float32))],
                    ["cell", "key", "codes", "scale", "norm"],
                )

    return index.select("key", "vector").mapInArrow(tidy(encode), "cell int, key long, codes binary, scale float, norm float")


def _sizes(coded: DataFrame) -> DataFrame:
    """cell, parts: how many blocks of about BLOCK each cell has; at most CELLS rows."""
    return coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))


def _blocks(coded: DataFrame, sizes: DataFrame) -> DataFrame:
    """cell, part, items: the vectors of each cell in blocks, dealt by hash."""
    placed = coded.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod("key", F.col("parts")))
    return placed.groupBy("cell", "part").agg(F.collect_list(F.struct("key", "codes", "scale", "norm")).alias("items"))


def _candidates(asked: DataFrame, blocks: DataFrame, sizes: DataFrame, books: np.ndarray, centre: np.ndarray, probes: int, rerank: int, quota: int, kind: str, dimension: int) -> DataFrame:
    """id, key: the `rerank` vectors of least approximate distance in each query's `probes` nearest cells, at most `quota` of each block."""

    def visit(batches):
        for batch in batches:
            cells = _near(unit(_matrix(batch.column("vector"), kind, dimension)), centre, probes)
            row = np.repeat(np.arange(len(batch)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(cells.ravel(), pa.int32())], ["id", "vector", "cell"])

    visits = asked.mapInArrow(tidy(visit), "id long, vector binary, cell int")
    turns = max(1, -(-4 * probes * asked.count() // (len(centre) * QUERIES)))
    groups = visits.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(turns)).alias("turn")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    # a group of queries goes to each block of its cell, so a cell with most of the vectors is many tasks
    groups = groups.join(F.broadcast(sizes), "cell").select("cell", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def scan(batches):
        quantiser = AdditiveQuantiser(books)
        for batch in batches:
            for cell, items, queries in zip(batch.column("cell").to_pylist(), batch.column("items"), batch.column("queries")):
                items, queries = items.values, queries.values
                key = items.field("key").to_numpy()
                codes = np.frombuffer(b"".join(items.field("codes").to_pylist()), np.uint8).reshape(len(key), -1)
                scale, norms, ids = items.field("scale").to_numpy(), items.field("norm").to_numpy(), queries.field("id").to_numpy()
                r = min(quota, len(key))
                for lo in range(0, len(ids), QUERIES):
                    away = unit(_matrix(queries.field("vector").slice(lo, QUERIES), kind, dimension)) - centre[cell]
                    table = quantiser.tables(away).astype(np.float32)
                    product = np.zeros((len(away), len(key)), np.float32)
                    for m in range(codes.shape[1]):
                        product += table[:, m, :][:, codes[:, m]]
                    inside = norms - 2 * scale * product
                    best = np.argpartition(inside, r - 1, axis=1)[:, :r]
                    distance = (away**2).sum(1)[:, None] + np.take_along_axis(inside, best, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + QUERIES], r)), pa.array(key[best].ravel()), pa.array(distance.ravel())], ["id", "key", "distance"])

    found = groups.join(blocks, ["cell", "part"]).select("cell", "items", "queries").mapInArrow(tidy(scan), "id long, key long, distance double")
    order = Window.partitionBy("id").orderBy("distance", "key")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rerank).select("id", "key")


def _ranked(scored: DataFrame, k: int, *more: str) -> DataFrame:
    """query_id, rank, vec_id, score (and more columns) from id, score, ids: the query's own row left out once."""
    rows = scored.select(F.col("id").alias("query_id"), "score", F.explode("ids").alias("vec_id"), *more)
    own = F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score")))
    rows = rows.withColumn("_own", F.when(F.col("query_id") == F.col("vec_id"), own)).where("_own IS NULL OR _own > 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def _reranked(pairs: DataFrame, asked: DataFrame, index: DataFrame, k: int, kind: str, dimension: int) -> DataFrame:
    """Exact scores of the pairs (id, key), ranked."""

    def score(batches):
        for batch in batches:
            q, x = _matrix(batch.column("q"), kind, dimension), _matrix(batch.column("vector"), kind, dimension)
            both = np.einsum("ij,ij->i", q, x) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(both), batch.column("ids")], ["id", "score", "ids"])

    whole = pairs.join(asked.withColumnRenamed("vector", "q"), "id").join(index, "key").select("id", "q", "vector", "ids")
    return _ranked(whole.mapInArrow(tidy(score), "id long, score double, ids array<long>"), k)


def _exact(asked: DataFrame, index: DataFrame, k: int, kind: str, dimension: int, centre: np.ndarray | None = None) -> DataFrame:
    """All queries against all vectors, in blocks: each block gives a query's best, ties included. With centroids, also
    `place`: how many cells are nearer to the query than the neighbour's own."""
    parts = -(-index.count() // BLOCK)
    blocks = index.withColumn("part", F.pmod("key", F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct("vector", "ids")).alias("items"))
    count = asked.count()
    groups = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // QUERIES))))).groupBy("turn").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    # a stated query set against all rows: each block of queries goes to each block of the index
    groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def scan(batches):
        for batch in batches:
            for items, queries in zip(batch.column("items"), batch.column("queries")):
                x, q = _matrix(items.values.field("vector"), kind, dimension), _matrix(queries.values.field("vector"), kind, dimension)
                ids, own, out = items.values.field("ids").to_pylist(), queries.values.field("id").to_pylist(), []
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                cell = np.zeros(len(x), np.int64) if centre is None else _near(x / norm[:, None], centre, 1)[:, 0]
                for i, one in zip(own, q):
                    far = None if centre is None else (centre**2).sum(1) - 2 * centre @ (one / np.sqrt(one @ one))
                    score = np.einsum("ij,j->i", x, one) / (norm * np.sqrt(one @ one))
                    least = np.partition(score, -min(len(score), k + 1))[-min(len(score), k + 1)]
                    out += [(i, float(score[j]), ids[j], 0 if far is None else int((far < far[cell[j]]).sum())) for j in np.flatnonzero(score >= least)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.int32()))], ["id", "score", "ids", "place"])

    found = groups.join(blocks, "part").select("items", "queries").mapInArrow(tidy(scan), "id long, score double, ids array<long>, place int")
    return _ranked(found, k, *(["place"] if centre is not None else []))


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of true neighbours that were found; a neighbour of the same score counts as well."""
    least = true.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.join(least, "query_id").where(F.col("score") >= F.col("least") - 1e-12).groupBy("query_id").agg(F.count("*").alias("hit"))
    got = least.join(hits, "query_id", "left").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"), F.sum("n").alias("n")).first()
    return 1.0 if not got["n"] else got["h"] / got["n"]


SCHEMA = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", query_every: int = 50, k: int = 5, target: float = TARGET, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by query_every."""
    single = vectors.schema[column].dataType.elementType.typeName() == "float"
    number = F.transform(column, lambda x: x.cast("float" if single else "double"))
    fine = vectors.where(F.col(id_column).isNotNull() & usable(column)).select(F.col(id_column).cast("long").alias("id"), number.alias("v"))
    sizes = [r["n"] for r in fine.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # lengths are those of a few models
    out = [_nearest(fine.where(F.size("v") == n), n, "<f4" if single else "<f8", query_every, k, target, exact) for n in sizes]
    return reduce(DataFrame.unionByName, out) if out else vectors.sparkSession.createDataFrame([], SCHEMA)


def _nearest(fine: DataFrame, dimension: int, kind: str, query_every: int, k: int, target: float, exact: bool) -> DataFrame:
    index = materialise(_distinct(fine, dimension, k + 1, kind).withColumn("key", F.xxhash64("vector")))
    count = index.count()

    def pack(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], ["id", "vector"])

    asked = fine.where(F.pmod("id", F.lit(query_every)) == 0).mapInArrow(tidy(pack), "id long, vector binary")
    asked = materialise(asked.groupBy("id", "vector").agg(F.count("*").alias("_")).drop("_"))
    if exact:
        return _exact(asked, index, k, kind, dimension)
    cells = min(CELLS, -(-count // CELL))
    sample = index.orderBy("key", "vector").limit(SAMPLE).select("vector")
    books, centre = _trained(sample, cells, kind, dimension)  # BOOKS * WORDS codewords and at most CELLS centroids, whatever the input
    coded = materialise(_coded(index, books, centre, kind, dimension))
    sizes = materialise(_sizes(coded))
    blocks = materialise(_blocks(coded, sizes))

    def search(some: DataFrame, probes: int, rerank: int) -> DataFrame:
        quota = count if rerank >= count else min(rerank, 2 * rerank // probes + 4)
        return _reranked(_candidates(some, blocks, sizes, books, centre, probes, rerank, quota, kind, dimension), some, index, k, kind, dimension)

    trial = materialise(asked.orderBy(F.xxhash64("id"), "vector").limit(TRIALS))
    true = materialise(_exact(trial, index, k, kind, dimension, centre))
    places = sorted(r["place"] for r in true.select("place").collect())  # at most TRIALS * k rows
    probes = places[min(len(places) - 1, int(len(places) * REACH))] + 1 if places else 1
    rerank = RERANK
    while (probes < len(centre) or rerank < count) and recall(search(trial, probes, rerank), true) < target:
        probes, rerank = probes if rerank < count else len(centre), 2 * rerank
    return search(asked, probes, rerank)
