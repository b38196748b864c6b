"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere.

Sorting every suffix would move many times the input. So suffixes are taken only at
anchors that equal strings share: a 400-byte window's anchor is its 32-byte string of
least hash, the leftmost one. Equal windows have equal anchors at equal offsets, so only
suffixes at anchors with equal 32 bytes need comparing, about one in 185.

An anchor stands for the windows that chose it; their bytes are its context. Anchors with
equal contexts (96-bit hashes, offsets included) settle all their windows at once. Where
anchors agree in 32 bytes and differ in context, the contexts themselves meet: their right
parts and their reversed left parts are put in suffix order by deep-shallow sorting
(suffix.py). For an offset d of the window's start before the anchor, two windows are equal
when the right parts share 400-d bytes and the left parts d bytes, and both classes can be
read off the two lists of common prefixes.

Hot anchors: a task forwards one anchor per distinct context, and where one 32-byte string
has very many contexts, in a task or overall, its windows are dealt by their own hashes
instead. Both ways give the same windows.

Null and short texts lose nothing; the same document may repeat itself; repeated rows are
places of their own; an empty table gives an empty result. Only doc_id and text are read;
doc_id should not be null (such rows are returned, untouched).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, BYTE_ROLLERS, U64, chunks, materialise, mixed, tidy
from .exchange import SCHEMA, bucket_count, by_group, dealt, packed, reduced
from .suffix import sorted_with_prefixes

LENGTH = 400
GRAM = 32
SPAN = LENGTH - GRAM + 1
FLUSH = 500_000
SEGMENT = 1 << 22
HERE, EVERYWHERE = 64, 4096
"""Contexts of one 32-byte string in a task, and in all, beyond which its windows are dealt one by one."""


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of x[i : i+span] for each i."""
    n = len(x) - span + 1
    padded = np.full(-(-len(x) // span) * span, np.iinfo(np.uint64).max, U64)
    padded[: len(x)] = x
    block = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


_PLACE = np.dtype([("k", "<u8"), ("c", "<u8"), ("c2", "<u4"), ("doc", "<i8"), ("tag", "<u2"), ("at", "<i4"), ("back", "<u2"), ("wide", "<u2"), ("many", "u1"), ("hot", "u1")])
"""at: the anchor's byte; its windows start from at-back to at-back+wide."""


def text_tags(chunk, sums: np.ndarray) -> np.ndarray:
    """16 bits of each text, which tell apart texts that share a doc_id."""
    return (BYTE_ROLLERS[0].of(sums, chunk.at[:-1], chunk.at[1:]) >> U64(48)).astype(np.uint16)


def anchors(chunk, ids: np.ndarray) -> np.ndarray:
    """The places of all anchors of a chunk's texts."""
    out, tags = [], None
    for base in range(0, max(1, len(chunk.data)), SEGMENT):
        data = chunk.data[base : base + SEGMENT + LENGTH - 1]
        one, two = BYTE_ROLLERS[0].sums(BYTE_CODES[0][data]), BYTE_ROLLERS[1].sums(BYTE_CODES[1][data])
        if tags is None:
            tags = text_tags(chunk, one) if len(chunk.data) <= SEGMENT else np.array(
                [int.from_bytes(hashlib.sha256(chunk.data[a:b].tobytes()).digest()[:2], "little") for a, b in zip(chunk.at[:-1], chunk.at[1:])], np.uint16)
        if len(data) < LENGTH:
            continue
        i = np.arange(len(data) - GRAM + 1)
        gram = BYTE_ROLLERS[0].of(one, i, i + GRAM)
        least = sliding_least((gram & U64(0xFFFFFFFFFF000000)) | i.astype(U64), SPAN) & U64(0xFFFFFF)
        start = np.arange(len(least))
        text = np.searchsorted(chunk.at, start + base, "right") - 1
        ok = start + base + LENGTH <= chunk.at[text + 1]
        start, text, at = start[ok], text[ok], least[ok].astype(np.int64)
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
        first, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
        at, text = at[new], text[new]
        r = np.zeros(len(new), _PLACE)
        r["k"], r["doc"], r["tag"] = gram[at], ids[text], tags[text]
        r["at"], r["back"], r["wide"] = at + base - chunk.at[text], at - first, last - first
        shape = mixed((at - first).astype(U64) << U64(16) | (last - first).astype(U64))
        r["c"] = BYTE_ROLLERS[0].of(one, first, last + LENGTH) ^ shape
        r["c2"] = (BYTE_ROLLERS[1].of(two, first, last + LENGTH) ^ shape).astype(np.uint32)
        out.append(r)
    return np.concatenate(out) if out else np.zeros(0, _PLACE)


def whole_text_tag(data: np.ndarray) -> int:
    """The tag of one text by itself, as anchors() gives it."""
    if len(data) > SEGMENT:
        return int.from_bytes(hashlib.sha256(data.tobytes()).digest()[:2], "little")
    sums = BYTE_ROLLERS[0].sums(BYTE_CODES[0][data])
    return int(BYTE_ROLLERS[0].of(sums, np.array([0]), np.array([len(data)]))[0] >> U64(48))


_HIT = np.dtype([("doc", "<i8"), ("tag", "<u2"), ("first", "<i4"), ("last", "<i4")])


def _hits(r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), _HIT)
    out["doc"], out["tag"] = r["doc"], r["tag"]
    out["first"] = r["at"] - r["back"].astype(np.int64)
    out["last"] = out["first"] + r["wide"]
    return out


def _classes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r in order of k and context, where k and where the context begins, and the size of each row's context class."""
    r = r[np.lexsort((r["c2"], r["c"], r["k"]))]
    k = np.ones(len(r), bool)
    k[1:] = r["k"][1:] != r["k"][:-1]
    c = k.copy()
    c[1:] |= (r["c"][1:] != r["c"][:-1]) | (r["c2"][1:] != r["c2"][:-1])
    at = np.flatnonzero(c)
    size = np.diff(np.concatenate([at, [len(r)]]))
    many = np.logical_or.reduceat(r["many"] > 0, at) if len(at) else np.zeros(0, bool)
    return r, k, c, np.repeat(np.where(many, 2, size), size)


def _per_group(new: np.ndarray, value: np.ndarray, how) -> np.ndarray:
    """how.reduceat of value per group, given back to each row."""
    at = np.flatnonzero(new)
    return np.repeat(how.reduceat(value, at), np.diff(np.concatenate([at, [len(new)]]))) if len(at) else value


OUT = "doc_id long, what int, data binary"
"""what 0: hits; what 1: places whose context is asked for."""


def _rows(hits: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    rows = [(d, 0, x.tobytes()) for d, x in by_group(hits["doc"], hits)] + [(d, 1, x.tobytes()) for d, x in by_group(asked["doc"], asked)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "what", "data"])


def settle(docs: DataFrame) -> DataFrame:
    """Hits of anchors with equal contexts, and the places that have to be compared (OUT)."""
    buckets = bucket_count(docs)

    def send(held):
        r, k, c, size = _classes(np.concatenate(held))
        hit = _hits(r[size > 1])
        r["many"] = size > 1
        n = _per_group(k, c.astype(np.int64), np.add)
        hot = (n > HERE) & c
        asked = r[hot]
        asked["hot"] = 1
        forward = c & (~hot | k)
        r["hot"] = n > HERE
        yield dealt(r[forward], r["k"][forward], buckets, 0)
        yield dealt(asked, asked["k"] ^ mixed(asked["c"]), buckets, 1)
        yield dealt(hit, mixed(hit["doc"].astype(U64)), buckets, 2)

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                held.append(anchors(chunk, ids[chunk.rows.start : chunk.rows.stop].astype(np.int64)))
                size += len(held[-1])
                if size > FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def reduce(got):
        r, k, c, size = _classes(got[0])
        if not len(r):
            yield _rows(got[2], got[1])
            return
        hit = _hits(r[(size > 1) & (r["many"] == 0)])  # a forwarded anchor with `many` was a hit where it came from
        r = r.copy()
        any_many = size > 1
        n = _per_group(k, c.astype(np.int64), np.add)
        hot = (_per_group(k, r["hot"].astype(np.int64), np.maximum) > 0) | (n > EVERYWHERE)
        open_ = _per_group(k, (~any_many).astype(np.int64), np.maximum) > 0  # some context stands alone
        ask = c & (open_ | hot) & ((n > 1) | hot) & ~((r["hot"] > 0))
        asked = r[ask]
        asked["many"], asked["hot"] = any_many[ask], hot[ask]
        yield _rows(np.concatenate([hit, got[2]]), np.concatenate([asked, got[1]]))

    sent = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(tidy(scan), SCHEMA)
    return reduced(sent, {0: _PLACE, 1: _PLACE, 2: _HIT}, reduce, OUT)


_CONTEXT = np.dtype([("k", "<u8"), ("doc", "<i8"), ("tag", "<u2"), ("at", "<i4"), ("back", "<u2"), ("wide", "<u2"), ("many", "u1")])
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("tag", "<u2"), ("start", "<i4"), ("many", "u1")])
_BYTES = np.dtype("u1")


def equal_windows(r: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Hits among places whose contexts differ; contexts[i] has the bytes of all windows of place i."""
    back = r["back"].astype(np.int64)
    lowest = back - r["wide"]
    order, prefix = sorted_with_prefixes([c[b:] for c, b in zip(contexts, back.tolist())])
    left_order, left_prefix = sorted_with_prefixes([c[:b][::-1] for c, b in zip(contexts, back.tolist())])
    _, gram = np.unique(r["k"], return_inverse=True)
    found: list[tuple[np.ndarray, int]] = []
    right, left = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
    alone = r["many"] == 0
    for d in range(int(lowest.min()), int(back.max()) + 1):
        active = (lowest <= d) & (d <= back)
        if active.sum() < 2:
            continue
        right[order] = np.cumsum(prefix < LENGTH - d)
        left[left_order] = np.cumsum(left_prefix < d)
        i = np.flatnonzero(active)
        _, which, n = np.unique(right[i] * (len(r) + 1) + left[i], return_inverse=True, return_counts=True)
        i = i[(n[which] > 1) & alone[i]]
        if len(i):
            found.append((i, d))
    if not found:
        return np.zeros(0, _HIT)
    i = np.concatenate([f[0] for f in found])
    d = np.repeat([f[1] for f in found], [len(f[0]) for f in found])
    out = np.zeros(len(i), _HIT)
    out["doc"], out["tag"], out["first"] = r["doc"][i], r["tag"][i], r["at"][i] - d
    out["last"] = out["first"]
    out = out[np.lexsort((out["first"], out["tag"], out["doc"]))]
    new = np.ones(len(out), bool)
    new[1:] = (out["doc"][1:] != out["doc"][:-1]) | (out["tag"][1:] != out["tag"][:-1]) | (out["first"][1:] > out["first"][:-1] + 1)
    at = np.flatnonzero(new)
    runs = out[at]
    runs["last"] = out["first"][np.concatenate([at[1:], [len(out)]]) - 1]
    return runs


def compare(texts: DataFrame) -> DataFrame:
    """texts: doc_id, text, asked. Hits of places that share 32 bytes and not their whole contexts (OUT)."""
    buckets = bucket_count(texts)

    def decide(w):
        w = w[np.lexsort((w["b"], w["a"]))]
        new = np.ones(len(w), bool)
        new[1:] = (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.concatenate([at, [len(w)]]))
        many = (np.logical_or.reduceat(w["many"] > 0, at) | (n > 1)) if len(at) else np.zeros(0, bool)
        hit = w[np.repeat(many, n) & (w["many"] == 0)] if len(w) else w
        first = w[new]
        first["many"] = many
        out = np.zeros(len(hit), _HIT)
        out["doc"], out["tag"], out["first"], out["last"] = hit["doc"], hit["tag"], hit["start"], hit["start"]
        return first, out

    def send(held):
        first, hit = decide(np.concatenate(held))
        yield dealt(first, first["a"], buckets, 2)
        yield dealt(hit, mixed(hit["doc"].astype(U64)), buckets, 3)

    def scan(batches):
        windows, size = [], 0
        for batch in batches:
            ids, asked = batch.column("doc_id").to_pylist(), batch.column("asked")
            head, body, key, lengths = [], [], [], []
            for chunk in chunks(batch.column("text")):
                for i, row in enumerate(chunk.rows):
                    data = chunk.data[chunk.at[i] : chunk.at[i + 1]]
                    p = np.frombuffer(b"".join(asked[row].as_py()), _PLACE)
                    p = p[p["tag"] == whole_text_tag(data)]
                    if not len(p):
                        continue
                    first = p["at"] - p["back"].astype(np.int64)
                    raw = data.tobytes()
                    for q, f in zip(p[p["hot"] == 0], first[p["hot"] == 0].tolist()):
                        head.append(tuple(q[n] for n in _CONTEXT.names))
                        body.append(raw[f : f + int(q["wide"]) + LENGTH])
                    hot, f = p[p["hot"] > 0], first[p["hot"] > 0]
                    if len(hot):
                        n = hot["wide"].astype(np.int64) + 1
                        start = np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        one, two = BYTE_ROLLERS[0].sums(BYTE_CODES[0][data]), BYTE_ROLLERS[1].sums(BYTE_CODES[1][data])
                        w = np.zeros(len(start), _WINDOW)
                        w["a"] = BYTE_ROLLERS[0].of(one, start, start + LENGTH)
                        w["b"] = BYTE_ROLLERS[1].of(two, start, start + LENGTH).astype(np.uint32)
                        w["doc"], w["tag"], w["start"], w["many"] = ids[row], hot["tag"][0], start, np.repeat(hot["many"], n)
                        windows.append(w)
                        size += len(w)
                        if size > FLUSH:
                            yield from send(windows)
                            windows, size = [], 0
            if head:
                h = np.array(head, _CONTEXT)
                to = ((h["k"] >> U64(40)) % U64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(h)]])
                rows = []
                for a, b in zip(cut[:-1], cut[1:]):
                    part = order[a:b]
                    rows += [(int(to[part[0]]), 0, packed(h[part])), (int(to[part[0]]), 1, packed(np.frombuffer(b"".join(body[j] for j in part), _BYTES)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "data"])
        if windows:
            yield from send(windows)

    def reduce(got):
        hits = [got[3], decide(got[2])[1]]
        if len(r := got[0]):
            raw = got[1].tobytes()
            end = np.cumsum(r["wide"].astype(np.int64) + LENGTH)
            hits.append(equal_windows(r, [raw[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())]))
        yield _rows(np.concatenate(hits), np.zeros(0, _PLACE))

    sent = texts.select("doc_id", "text", "asked").mapInArrow(tidy(scan), SCHEMA)
    return reduced(sent, {0: _CONTEXT, 1: _BYTES, 2: _WINDOW, 3: _HIT}, reduce, OUT)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup_bytes(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left)."""
    docs = docs.select("doc_id", "text")
    settled = materialise(settle(docs))
    asked = settled.where("what = 1").groupBy("doc_id").agg(F.collect_list("data").alias("asked"))
    more = compare(docs.join(asked, "doc_id"))
    hits = settled.where("what = 0").unionByName(more).groupBy("doc_id").agg(F.collect_list("data").alias("hits"))

    def finish(batches):
        for batch in batches:
            out, hits = [], batch.column("hits")
            for chunk in chunks(batch.column("text")):
                for i, row in enumerate(chunk.rows):
                    data = chunk.data[chunk.at[i] : chunk.at[i + 1]]
                    x = np.frombuffer(b"".join(hits[row].as_py() or ()), _HIT)
                    n, spans = len(data), 0
                    if len(x) and len(x := x[x["tag"] == whole_text_tag(data)]):
                        x = x[np.argsort(x["first"], kind="stable")]
                        end = np.maximum.accumulate(x["last"].astype(np.int64) + LENGTH)
                        new = np.concatenate([[True], x["first"][1:] > end[:-1]])
                        at = np.flatnonzero(new)
                        begin, stop = x["first"][at], end[np.concatenate([at[1:], [len(x)]]) - 1]
                        keep = np.ones(n, bool)
                        for a, b in zip(begin.tolist(), stop.tolist()):
                            keep[a:b] = False
                        data, spans = data[keep], len(at)
                    raw = data.tobytes()
                    out.append((n, n - len(raw), spans, hashlib.sha256(raw).hexdigest(), raw if keep_text else None))
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return docs.join(hits, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(tidy(finish), RESULT)
