"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad, or nothing on a document, from counts of
its characters, words, five-word windows and lines. Expectation-maximisation over the counts of vote patterns of all documents
(at most 3 ** labellers of them) estimates the share of good documents and, for each labeller, how
often it votes what on good and on bad ones; labellers are taken as independent given the truth, and a start that says they are better than chance counts as one
twentieth of the corpus.
The posterior of a pattern is its documents' weak label.

Posteriors of a bounded sample of documents (the first in order of a hash, up to so many rows and
characters; one task reads them, and only weights go to the driver) train a linear scorer over hashed words and word
pairs and a few hashed counts of form, by logistic regression. The scorer runs on every
whole text, so it also judges documents on which the labellers say little; the score is its
log-odds added to that of the weak label, as one probability.

Null text is empty (labellers see no words); repeated rows are scored alike; an empty table gives
an empty result; extra columns are ignored. With no votes at all the posterior is the prior.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_ROLLERS, chunks, mixed, tidy, windows

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 64_000_000
"""At most so many documents, by hash, and so many characters of them train the scorer; patterns are counted over all."""
BITS = 18
PRIOR = 0.85
ANCHOR = 0.05
"""Weight of where the estimation starts, as a share of the corpus."""


LABELLERS = ("symbols", "exclamations", "capitals", "stutter", "windows", "lines", "sentences")

#: Classes of bytes that are counted per text.
_FORM = np.zeros(256, np.int64)
_FORM[ord("A") : ord("Z") + 1] = 1
_FORM[ord("0") : ord("9") + 1] = 2
for _c in b"#*$%&|<>":
    _FORM[_c] = 3
_FORM[ord("!")] = 4
_FORM[ord("\n")] = 5
_FORM[ord("a") : ord("z") + 1] = 6
for _c in b".?":
    _FORM[_c] = 7


def _repeats(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts, how many of its hashes equal an earlier one of it."""
    order = np.lexsort((h, text))
    t, x = text[order], h[order]
    return np.bincount(t[1:][(t[1:] == t[:-1]) & (x[1:] == x[:-1])], minlength=n)


class Measures:
    """What labellers and scorer read of a chunk's texts."""

    def __init__(self, chunk) -> None:
        n = len(chunk.at) - 1
        self.words = w = chunk.words()
        self.n = w.sizes
        self.per = np.maximum(w.sizes, 1)
        sizes = np.diff(chunk.at)
        self.form = np.bincount(np.repeat(np.arange(n) * 8, sizes) + _FORM[chunk.data], minlength=8 * n).reshape(-1, 8)
        self.text = w.text_of()
        same = self.text[:-1] == self.text[1:]
        self.stutter = np.bincount(self.text[:-1][same & (w.code[:-1] == w.code[1:])], minlength=n)
        begin, run = windows(w.sizes, w.at, 5)
        sums = WORD_ROLLERS[0].sums(w.code)
        self.windows = np.maximum(w.sizes - 4, 0)
        self.repeated = _repeats(run, WORD_ROLLERS[0].of(sums, begin, begin + 5), n)
        edge = np.union1d(np.flatnonzero(chunk.data == 10), chunk.at)  # lines by their words
        first = np.searchsorted(w.begin, edge)
        a, b = first[:-1], first[1:]
        line = np.searchsorted(w.at, a, "right") - 1
        some = b > a
        self.lines = np.bincount(line[some], minlength=n)
        self.repeated_lines = _repeats(line[some], WORD_ROLLERS[0].of(sums, a[some], b[some]), n)

    def votes(self) -> np.ndarray:
        """(text, labeller): 1 good, -1 bad, 0 nothing."""
        f, n = self.form, self.per
        stops = f[:, 7] * 100
        return np.stack([
            -(f[:, 3] * 100 > n * 15).astype(np.int64),
            -(f[:, 4] * 100 > n * 25).astype(np.int64),
            -((f[:, 1] * 100 > (f[:, 1] + f[:, 6]) * 60) & (self.n >= 5)).astype(np.int64),
            -(self.stutter * 100 > n * 20).astype(np.int64),
            -(self.repeated * 100 > np.maximum(self.windows, 1) * 30).astype(np.int64),
            -((self.repeated_lines * 100 > self.lines * 50) & (self.repeated_lines > 2)).astype(np.int64),
            ((stops >= n * 2) & (stops <= n * 40)).astype(np.int64),
        ], axis=1)

    def codes(self) -> np.ndarray:
        return ((self.votes() + 1) * 3 ** np.arange(len(LABELLERS))).sum(1)


def pattern(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 - 1 for i in range(len(LABELLERS)))


def em(patterns: list[tuple[tuple[int, ...], int]], prior: float = PRIOR, rounds: int = 100) -> tuple[dict[tuple[int, ...], float], float, np.ndarray]:
    """The posterior of good for each pattern, the share of good, and P(vote | truth) as (labeller, truth, vote+1).

    Bad documents are bad in different ways, so the bad truth is a mixture with one part per
    labeller that speaks against; each part starts with its labeller's votes likely."""
    votes = np.array([p for p, _ in patterns], np.int64) + 1
    count = np.array([n for _, n in patterns], float)
    k = votes.shape[1]
    against = [j for j in range(k) if (votes[:, j] == 0).any()]
    kinds = 1 + max(1, len(against))
    start = np.empty((kinds, k, 3))
    for j in range(k):
        speaks_for = (votes[:, j] == 2).any()
        start[0, j] = (0.01, 0.34, 0.65) if speaks_for else (0.002, 0.998, 0.0)
        start[1:, j] = (0.05, 0.55, 0.4) if speaks_for else (0.1, 0.9, 0.0)
    for i, j in enumerate(against):
        start[1 + i, j] = (0.8, 0.15, 0.05)
    given, share = start.copy(), np.array([prior] + [(1 - prior) / (kinds - 1)] * (kinds - 1))
    weight = ANCHOR * count.sum() * share
    post = np.zeros((kinds, len(count)))
    for _ in range(rounds):
        log = np.log(share)[:, None] + sum(np.log(given[:, j, votes[:, j]] + 1e-12) for j in range(k))
        post = np.exp(log - log.max(0))
        post /= post.sum(0)
        mass = post * count
        share = (mass.sum(1) + 1e-3 * count.sum()) / ((1 + 1e-3 * kinds) * count.sum())
        for c in range(kinds):
            for j in range(k):
                x = np.bincount(votes[:, j], mass[c], 3) + start[c, j] * weight[c] + 1e-6
                given[c, j] = x / x.sum()
    good = float(min(max(share[0], 0.01), 0.99))
    bad = (given[1:] * (share[1:] / share[1:].sum())[:, None, None]).sum(0)
    return {p: float(x) for (p, _), x in zip(patterns, post[0])}, good, np.stack([bad, given[0]], axis=1)


def features(m: Measures, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: feature numbers, values, and where each text's begin."""
    w, text, n = m.words, m.text, len(m.n)
    pair = mixed(w.code[:-1] * U64(3) + w.code[1:])
    same = text[:-1] == text[1:]
    mask = U64((1 << BITS) - 1)
    rows, numbers = [text, text[:-1][same]], [(w.code & mask).astype(np.int64), (pair[same] & mask).astype(np.int64)]
    values = [1 / np.sqrt(m.per[text]), 1 / np.sqrt(m.per[text[:-1][same]])]
    extra = np.concatenate([m.form[:, [1, 2, 3, 4, 5]], m.stutter[:, None], m.repeated[:, None], m.repeated_lines[:, None]], axis=1) / m.per[:, None]
    level = np.minimum(np.log2(1 + 32 * extra), 8).astype(np.int64)  # levels of each count per word
    for k in range(level.shape[1]):
        rows.append(np.arange(n))
        numbers.append((mixed((level[:, k] + 1000 * (k + 1)).astype(U64)) & mask).astype(np.int64))
        values.append(np.ones(n))
    rows, numbers, values = (np.concatenate(x) for x in (rows, numbers, values))
    order = np.argsort(rows, kind="stable")
    return numbers[order], values[order], np.searchsorted(rows[order], np.arange(n + 1))


def fit_scorer(texts: list[str], target: np.ndarray, epochs: int = 2, rate: float = 0.3) -> np.ndarray:
    """Weights by hashed feature; the last is the intercept."""
    parts = [features(Measures(c), c) for c in chunks(pa.array(texts, pa.string()))]
    docs = [(n[a:b], v[a:b]) for n, v, at in parts for a, b in zip(at[:-1], at[1:])]
    w, step = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            n, v = docs[i]
            g = 1 / (1 + math.exp(-max(-60.0, min(60.0, float(w[n] @ v + w[-1]))))) - target[i]
            sums = np.bincount(np.searchsorted(u := np.unique(n), n), v * g)
            step[u] += sums * sums
            w[u] -= rate * sums / np.sqrt(step[u])
            step[-1] += g * g
            w[-1] -= rate * g / math.sqrt(step[-1])
    return w


def vote_codes(docs: DataFrame) -> DataFrame:
    """Per row: code, the votes of all labellers as one number (pattern() reads it)."""

    def run(batches):
        for batch in batches:
            out = [Measures(c).codes() for c in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else [], pa.int64())], ["code"])

    return docs.select("text").mapInArrow(tidy(run), "code long")


def fitted(docs: DataFrame, weak: np.ndarray, count: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The scorer's weights, trained in one task on the sample. weak: the posterior of each vote code; count: rows of docs."""
    place = F.xxhash64("doc_id", "text")
    share = min(1.0, 1.2 * sample_rows / count + 1e-6)  # more than are taken, so that few rows are sorted
    by_hash = docs.where("text IS NOT NULL").select(F.col("text"), place.alias("_place")).where(F.pmod("_place", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = by_hash.orderBy(F.pmod("_place", F.lit(1 << 30)), "_place", "text").limit(sample_rows).select("text")

    def train(batches):
        texts, size = [], 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                size += len(t)
                if size <= SAMPLE_CHARS or not texts:
                    texts.append(t)
        target = [weak[Measures(c).codes()] for c in chunks(pa.array(texts, pa.string()))]
        w = fit_scorer(texts, np.concatenate(target)) if texts else np.zeros((1 << BITS) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["weights"])

    got = sample.repartition(1).mapInArrow(tidy(train), "weights binary").collect()  # one row of 2 ** BITS numbers
    return np.frombuffer(got[0]["weights"], "<f4").astype(float) if got else np.zeros((1 << BITS) + 1)


RESULT = "doc_id long, n_words long, weak_label double, score double, kept boolean"


def quality_scores(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_words, weak_label (posterior), score, kept."""
    spark = docs.sparkSession
    counted = [(pattern(r["code"]), r["n"]) for r in vote_codes(docs).groupBy("code").agg(F.count("*").alias("n")).collect()]  # at most 3 ** labellers rows
    if not counted:
        return spark.createDataFrame([], RESULT)
    posterior, good, _ = em(sorted(counted))
    weak = np.full(3 ** len(LABELLERS), good)
    for p, x in posterior.items():
        weak[sum((v + 1) * 3**i for i, v in enumerate(p))] = x
    weights = fitted(docs, weak, sum(n for _, n in counted), sample_rows)
    sent = spark.sparkContext.broadcast((weights, weak))  # 2 ** BITS numbers, whatever the input
    prior = math.log(good / (1 - good))

    def run(batches):
        w, weak = sent.value
        for batch in batches:
            out, label, words = [], [], []
            for chunk in chunks(batch.column("text")):
                m = Measures(chunk)
                n, v, at = features(m, chunk)
                sums = np.concatenate([[0.0], np.cumsum(w[n] * v)])
                out.append(sums[at[1:]] - sums[at[:-1]] + w[-1])
                label.append(weak[m.codes()])
                words.append(m.n)
            if not out:
                continue
            p = np.clip(np.concatenate(label), 1e-9, 1 - 1e-9)
            odds = np.log(p / (1 - p)) + np.concatenate(out) - prior
            score = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(words), pa.int64()), pa.array(p), pa.array(score), pa.array(score >= threshold)],
                ["doc_id", "n_words", "weak_label", "score", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), RESULT)
