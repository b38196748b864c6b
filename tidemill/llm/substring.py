"""Substring dedup over words by difference-cover anchors.

A window is `WINDOW` consecutive words. D is a perfect difference cover of the period
31: for any two positions i, j some t < 31 has both i+t and j+t in D modulo 31. So two
equal runs of 50 words, wherever they stand, share a 20-word window that begins at a
cover position in both. Only windows at cover positions are hashed and exchanged (6 of
31). Texts that hold a shared anchor then extend it: every 50-word window around a
shared anchor gets a 96-bit hash, and each such window goes where its equals go,
to find the smallest doc_id that has it. A word is removed if a window over it also
starts in a document with a smaller doc_id.

Texts with equal words are resolved first: only the one with the smallest doc_id takes
part, and each other is a repeat from end to end (if it has 50 words).

Hot anchors and windows: each task sends one row per distinct value, having decided
those it can by itself, so a passage in a third of all documents costs one row per task
at the place where it meets.

Null and short texts have no windows and lose nothing. Rows that are repeated with the
same doc_id are not each other's smaller document. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_ROLLERS, chunks, covered, materialise, signed, tidy, windows
from .exchange import SCHEMA, bucket_count, by_group, dealt, reduced

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
FLUSH = 1_000_000
"""Anchors or windows that a task holds before it sends them."""


def sequence_hash(words, sums) -> np.ndarray:
    """64 bits of each text's word sequence."""
    return WORD_ROLLERS[0].of(sums, words.at[:-1], words.at[1:]) ^ U64(0x5851F42D4C957F2D) * words.sizes.astype(U64)


def anchors(words, sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin (in the chunk's words), text number and hash of each window of ANCHOR words at a cover position."""
    begin, run = windows(words.sizes, words.at, ANCHOR)
    at_cover = np.isin((begin - words.at[run]) % PERIOD, COVER)
    begin, run = begin[at_cover], run[at_cover]
    return begin, run, WORD_ROLLERS[0].of(sums, begin, begin + ANCHOR)


META = "doc_id long, n_words long, s1 long, s2 long"


def meta(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words and 128 bits of its words."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for chunk in chunks(batch.column("text")):
                w = chunk.words()
                a, b = WORD_ROLLERS[0].sums(w.code), WORD_ROLLERS[1].sums(w.code)
                out.append((w.sizes, sequence_hash(w, a), WORD_ROLLERS[1].of(b, w.at[:-1], w.at[1:])))
            if out:
                n, s1, s2 = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(signed(s1)), pa.array(signed(s2))], ["doc_id", "n_words", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), META)


# anchors only name candidates, so 32 bits travel, beside the bucket's own; an accident costs work, not a result
_ANCHOR = np.dtype([("h", "<u4"), ("doc", "<i8"), ("many", "u1")])
_FOUND = np.dtype([("doc", "<i8"), ("h", "<u4")])
CANDIDATES = "doc_id long, hashes binary"


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and where in it the first key changes."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    return order, np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Per document and bucket: the hashes of its anchors that another doc_id has too."""
    buckets = bucket_count(docs)

    def send(held):
        h, doc = (np.concatenate(x) for x in zip(*held))
        order, new = _first_of(h, doc)
        h, doc = h[order], doc[order]
        once = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        h, doc, new = h[once], doc[once], new[once]
        many = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]])) > 1
        here = np.repeat(many, np.diff(np.concatenate([np.flatnonzero(new), [len(h)]])))
        found = np.zeros(here.sum(), _FOUND)
        found["h"], found["doc"] = h[here], doc[here]
        rows = np.zeros(new.sum(), _ANCHOR)
        rows["h"], rows["doc"], rows["many"] = h[new], doc[new], many
        yield dealt(rows, h[new], buckets, 0)
        yield dealt(found, h[here], buckets, 1)

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                w = chunk.words()
                _, run, h = anchors(w, WORD_ROLLERS[0].sums(w.code))
                held.append((h, ids[chunk.rows.start : chunk.rows.stop][run].astype(np.int64)))
                size += len(h)
                if size > FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def reduce(got):
        rows, found = got[0], got[1]
        order, new = _first_of(rows["h"], rows["doc"])
        h, doc, many = rows["h"][order], rows["doc"][order], rows["many"][order] > 0
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        if len(h):
            first = doc[starts][group]
            differs = np.zeros(len(starts), bool)
            np.logical_or.at(differs, group, (doc != first) | many)
            shared = differs[group]
        else:
            shared = np.zeros(0, bool)
        docs_, hs = np.concatenate([doc[shared], found["doc"]]), np.concatenate([h[shared], found["h"]])
        pairs = [(d, np.unique(x).tobytes()) for d, x in by_group(docs_, hs)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], ["doc_id", "hashes"])

    sent = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(tidy(scan), SCHEMA)
    return reduced(sent, {0: _ANCHOR, 1: _FOUND}, reduce, CANDIDATES)


# tag: 16 bits of the text's words, which tell apart texts that share a doc_id
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("tag", "<u2"), ("start", "<i4")])
_HIT = np.dtype([("doc", "<i8"), ("tag", "<u2"), ("start", "<i4")])
HITS = "doc_id long, tag int, starts binary"


def repeated_windows(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text, parts (its shared anchors). Per document: starts of windows that a smaller doc_id has too."""
    buckets = bucket_count(texts)

    def decide(w):
        """The first record of each distinct window by doc_id, and the records of larger doc_ids."""
        order = np.lexsort((w["doc"], w["b"], w["a"]))
        w = w[order]
        new = np.ones(len(w), bool)
        new[1:] = (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])
        least = w["doc"][new][np.cumsum(new) - 1] if len(w) else w["doc"]
        late = w["doc"] > least
        hits = np.zeros(late.sum(), _HIT)
        for k in ("doc", "tag", "start"):
            hits[k] = w[k][late]
        return w[~late], hits

    def send(held):
        first, hits = decide(np.concatenate(held))
        yield dealt(first, first["a"], buckets, 0)
        yield dealt(hits, hits["doc"].astype(U64) << U64(40), buckets, 1)

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = batch.column("parts")
            for chunk in chunks(batch.column("text")):
                w = chunk.words()
                a, b = WORD_ROLLERS[0].sums(w.code), WORD_ROLLERS[1].sums(w.code)
                begin, run, h = anchors(w, a)
                tag = (sequence_hash(w, a) >> U64(48)).astype(np.uint16)
                known = np.zeros(len(h), bool)
                cut = np.searchsorted(run, np.arange(len(chunk.rows) + 1))
                for i, row in enumerate(chunk.rows):
                    x = parts[row].as_py()
                    known[cut[i] : cut[i + 1]] = np.isin(h[cut[i] : cut[i + 1]].astype(np.uint32), np.frombuffer(b"".join(x), "<u4"))
                begin, run = begin[known], run[known]
                if not len(begin):
                    continue
                mark = np.zeros(len(w.code) + 1, np.int64)
                last = np.maximum(w.at[1:] - WINDOW, w.at[:-1] - 1)  # the last window of each text
                lo, hi = np.maximum(begin - (WINDOW - ANCHOR), w.at[run]), np.minimum(begin, last[run])
                ok = lo <= hi
                np.add.at(mark, lo[ok], 1)
                np.add.at(mark, hi[ok] + 1, -1)
                start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                text = np.searchsorted(w.at, start, "right") - 1
                r = np.zeros(len(start), _WINDOW)
                r["a"], r["b"] = WORD_ROLLERS[0].of(a, start, start + WINDOW), WORD_ROLLERS[1].of(b, start, start + WINDOW)
                r["doc"] = ids[chunk.rows.start : chunk.rows.stop][text]
                r["tag"], r["start"] = tag[text], start - w.at[text]
                held.append(r)
                size += len(r)
                if size > FLUSH // 2:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def reduce(got):
        _, hits = decide(got[0])
        hits = np.concatenate([hits, got[1]])
        rows = []
        for doc, tag, start in by_group(hits["doc"], hits["tag"], hits["start"]):
            rows += [(doc, t, x.tobytes()) for t, x in by_group(tag, start)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "tag", "starts"]
        )

    return reduced(texts.select("doc_id", "text", "parts").mapInArrow(tidy(scan), SCHEMA), {0: _WINDOW, 1: _HIT}, reduce, HITS)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def dedup_words(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space)."""
    docs = docs.select("doc_id", "text")
    rows = materialise(meta(docs))
    first = rows.where("doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k"))
    # as a plain table, so that AQE can split the rows of a text that many documents have
    several = materialise(first.where("k > 1").select("s1", "s2", "first"))
    copies = (
        rows.where(F.col("n_words") >= WINDOW).join(several, ["s1", "s2"]).where("doc_id > first")
        .groupBy("doc_id").agg(F.collect_set("s1").alias("copy_of"))
    )
    candidates = shared_anchors(docs).groupBy("doc_id").agg(F.collect_list("hashes").alias("parts"))
    origins = first.select(F.col("first").alias("doc_id")).distinct()
    hits = repeated_windows(docs.join(candidates, "doc_id").join(origins, "doc_id", "left_semi"))
    spans = hits.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "starts")).alias("hits"))
    marks = spans.join(copies, "doc_id", "full_outer")

    def finish(batches):
        for batch in batches:
            out = []
            hits, copy_of = batch.column("hits"), batch.column("copy_of")
            for chunk in chunks(batch.column("text")):
                w = chunk.words()
                own = signed(sequence_hash(w, WORD_ROLLERS[0].sums(w.code)))
                raw = chunk.data.tobytes()
                for i, row in enumerate(chunk.rows):
                    n, gone = int(w.sizes[i]), np.zeros(0, bool)
                    found, copy = hits[row].as_py() or (), copy_of[row].as_py() or ()
                    begin, end = w.begin[w.at[i] : w.at[i + 1]], w.end[w.at[i] : w.at[i + 1]]
                    if int(own[i]) in copy:
                        begin, end = begin[:0], end[:0]
                    elif mine := [x["starts"] for x in found if x["tag"] == (int(own[i]) >> 48) & 0xFFFF]:
                        gone = np.zeros(n, bool)
                        for a, b in zip(*covered(np.unique(np.frombuffer(b"".join(mine), "<i4")).astype(np.int64), WINDOW)):
                            gone[a:b] = True
                        begin, end = begin[~gone], end[~gone]
                    kept = b" ".join([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())])
                    out.append((n, n - len(begin), hashlib.sha256(kept).hexdigest(), kept.decode()))
            n, removed, sha, text = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "hits", "copy_of").mapInArrow(tidy(finish), OUT)


SUBSTRING_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(words[i + 1 : i + 50], ' ')) AS h
      FROM (SELECT r, doc_id, words, unnest(range(len(words) - 49)) AS i FROM t WHERE len(words) >= 50)),
l AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
hit AS (SELECT w.r, w.i FROM w JOIN l USING (h) WHERE w.doc_id > l.least),
gone AS (SELECT DISTINCT r, i + d AS i FROM hit, (SELECT unnest(range(50)) AS d)),
u AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
k AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u ANTI JOIN gone USING (r, i) GROUP BY u.r)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (r)
"""
