"""Packing token sequences by non-negative least squares over length combinations.

A document's ids are those of the tokenizer, then the end id. Every full window of
`length` ids is a sequence of its own; what remains (1 to length-1 ids) is one piece.
Remainders are counted by length class: 16 ids wide, but exact below 128 ids, so that short
texts fill a window too. Combinations of one to three wide classes that fill a window are
enumerated, and their repeat counts solve min |A x - h|, x >= 0 against the histogram h
(Lawson-Hanson). The counts are rounded down, and what is left of the histogram is packed
greedily, largest class first, in runs of equal combinations. All this works on at most
length/16 + 128 numbers, so the driver holds no document. Pieces then get their place from their rank within their class,
counted in parallel over hash ranges, so that a class that holds most rows is split.

Text is tokenised once. Plain Latin text takes a fast path that applies the
tokenizer's own split pattern and remembers pieces' ids, in bounded memory; any other text,
and every text of a tokenizer with another normaliser or pattern, goes to the tokenizer
itself. Both give the same ids (tested).

Null text is empty and packs as the end id alone; repeated rows are packed separately;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ahead, materialise, tidy

LENGTH = 4096
CLASS = 16
FINE = 128
"""Remainders shorter than this are classes by their exact length."""
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

#: The fast path's texts: characters on which lower-casing, normalisation and the classes of letters and digits are beyond doubt.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer file's split pattern, written out for those characters.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


#: The normaliser and the split for which PIECE is written.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes."""

    REMEMBERED = 160 << 20
    """Bytes of memory, about, that known pieces may take."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # pieces in use since the last turn, and those of the turn before; what neither holds is forgotten
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        normaliser, parts = (json.loads(x.__getstate__()) if x is not None else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        parts = parts.get("pretokenizers") or [{}]
        self.fast = (
            normaliser.get("normalizers") == NORMALISER and len(parts) == 2 and parts[0].get("pattern") == {"Regex": SPLIT}
            and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and parts[1].get("add_prefix_space") is False
            and parts[1].get("use_regex") is False and getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        )

    def ids(self, text: str) -> bytes:
        x = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(x)}I", *x)

    def learn(self, pieces: set[str]) -> None:
        """Makes all of these pieces known. New ones are encoded as one text; an id that ends a word ends a piece."""
        if self.size > self.REMEMBERED // 2:
            self.before, self.known, self.size = self.known, {}, 0
        old, new = self.before, []
        for p in pieces:
            if p not in self.known:
                if p in old:
                    self._keep(p, old[p])
                else:
                    new.append(p)
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(part) or len(ids) and end[-1] != len(ids):
                for p in part:
                    self._keep(p, self.ids(p))
                continue
            raw = ids.tobytes()
            for p, a, b in zip(part, (np.concatenate([[0], end[:-1]]) * 4).tolist(), (end * 4).tolist()):
                self._keep(p, raw[a:b])

    def _keep(self, piece: str, ids: bytes) -> None:
        self.known[piece] = ids
        self.size += 200 + len(piece) + len(ids)  # two objects and their place in the table

    def all(self, texts: list[str]) -> Iterator[bytes]:
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and size < 1 << 20:
                size += len(texts[j])
                j += 1
            split = [PIECE.findall(t.lower()) if self.fast and PLAIN.fullmatch(t) else None for t in texts[i:j]]
            self.learn({p for s in split if s for p in s})
            get = self.known.__getitem__
            for t, s in zip(texts[i:j], split):
                yield self.ids(t) if s is None else b"".join(map(get, s))
            i = j


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its memory of pieces outlives a task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: whole windows and the remainder of each document."""
    tail = struct.pack("<I", end_id)

    def pieces(batches):
        enc = encoder(tokenizer)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for doc, data in zip(ids, enc.all(texts)):
                data += tail
                n = len(data) // 4
                view = memoryview(data)
                rows += [(doc, a, min(length, n - a), zlib.crc32(view[4 * a : 4 * min(n, a + length)]), n) for a in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], bool)
    gain = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0)))
    while not passive.all() and rounds > 0 and (best := int(np.argmax(np.where(passive, -np.inf, gain)))) >= 0 and gain[best] > tol:
        passive[best] = True
        while rounds > 0:
            rounds -= 1
            s = np.zeros_like(x)
            p = np.flatnonzero(passive)
            used = a[:, p]  # only passive columns meet in a square matrix
            s[p] = np.linalg.solve(used.T @ used + 1e-12 * np.eye(len(p)), used.T @ b)
            if s[passive].min(initial=1) > 0:
                break
            low = passive & (s <= 0)
            step = float((x[low] / np.maximum(x[low] - s[low], 1e-300)).min())
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = np.maximum(s, 0)
        p = np.flatnonzero(x)
        gain = a.T @ (b - a[:, p] @ x[p])
    return x


def combinations(classes: list[int], units: int) -> list[tuple[int, ...]]:
    """One to three of the classes present, largest first, that fill a window of so many units up to one unit."""
    have, out = set(classes), []
    for a in classes:
        if units - 1 <= a <= units:
            out.append((a,))
        for b in (x for x in classes if x <= a and a + x <= units):
            if a + b >= units - 1:
                out.append((a, b))
            out += [(a, b, c) for c in (units - a - b,) if 0 < c <= b and c in have]
    return out


def plan_counts(histogram: dict[int, int], room: int, grain: int = 1, fine: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """(combination of classes, times): every remainder in exactly one. A class is a length, at most room; those from `fine` on are multiples of grain."""
    classes = sorted(histogram, reverse=True)
    left, plan = dict(histogram), []
    wide = [c for c in classes if c >= fine]
    combos = [tuple(c * grain for c in combo) for combo in combinations([c // grain for c in wide], room // grain)]
    if combos:
        at = {c: i for i, c in enumerate(wide)}
        a = np.zeros((len(wide), len(combos)))
        for j, combo in enumerate(combos):
            for c in combo:
                a[at[c], j] += 1
        total = float(sum(histogram[c] for c in wide))
        x = nnls(a, np.array([histogram[c] / total for c in wide])) * total
        for j in np.argsort(-x, kind="stable"):
            need = {c: combos[j].count(c) for c in combos[j]}
            n = min(int(x[j] + 1e-6), *(left[c] // k for c, k in need.items()))
            if n > 0:
                plan.append((combos[j], n))
                for c, k in need.items():
                    left[c] -= n * k
    while left := {c: n for c, n in left.items() if n}:
        combo: list[int] = []
        free, need = room, {}
        for c in sorted(left, reverse=True):
            if k := min(free // c, left[c]):
                need[c] = k
                combo += [c] * k
                free -= k * c
        n = min(left[c] // k for c, k in need.items())
        plan.append((tuple(combo), n))
        for c, k in need.items():
            left[c] -= n * k
    return plan


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer, length, end_id))
    n = F.col("length")
    rest = pieces.where(n < length).withColumn("class", F.when(n < FINE, n).otherwise(F.ceil(n / CLASS) * CLASS).cast("int"))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(4096)))
    counts = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most length / CLASS + FINE rows
    plan = plan_counts(histogram, length, CLASS, FINE)
    intervals, taken, first = [], dict.fromkeys(histogram, 0), 0
    for combo, n in plan:
        for c in sorted(set(combo), reverse=True):
            k = combo.count(c)
            intervals.append((c, taken[c], taken[c] + n * k, k, first))
            taken[c] += n * k
        first += n
    # at most a few combinations per class, so this table is bounded by length / CLASS
    table = spark.createDataFrame(intervals or [(0, 0, 0, 1, 0)], "c int, lo long, hi long, k long, first long")
    before = ahead(counts, ["class"], "salt").toDF("c2", "s2", "ahead")
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = (
        salted.withColumn("r", rank)
        .join(before, (F.col("class") == F.col("c2")) & (F.col("salt") == F.col("s2")))
        .withColumn("rank", F.col("r") + F.col("ahead"))
        .join(F.broadcast(table), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("k")))
    )
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    # full windows are sequences by themselves; their ids follow, from per-range counts as above
    full = pieces.where(F.col("length") == length).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(4096)))
    before = full.groupBy("salt").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(Window.orderBy("salt")) - F.col("n")).select(F.col("salt").alias("s2"), "ahead")  # 4096 rows
    rank = F.row_number().over(Window.partitionBy("salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    full = full.withColumn("r", rank).join(before, F.col("salt") == F.col("s2")).withColumn("sequence_id", F.col("r") + F.col("ahead") + first).withColumn("offset", F.lit(0))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset")]
    return placed.select(*columns).unionByName(full.select(*columns))
