"""Which charset a body without one is in, from its bytes alone.

UTF-8 goes first (its form is no chance), then UTF-16 by its byte order mark or by zero bytes on one side. Of
the other codecs that decode the body, the one wins in which it is the least surprising, summed over its
characters by what stands beside them:

- a two-byte codec lays its common characters out in rows of their own (level 1 of each national standard), so
  a character there surprises by the size of that level, one elsewhere by more, and one between ASCII letters by
  more still, which is what a one-byte text looks like when it is read in pairs;
- in a one-byte codec a letter beside letters of its script, lower case within words, surprises little; signs
  and letters at odd places surprise.

UTF-16 without a mark and without zero bytes (long Chinese without a line break) is not recognised. The whole body counts, a body of ASCII alone is the same in all, and nothing is trained: the levels are read
off the codecs by their rows."""

from __future__ import annotations

import functools
import math

import numpy as np

#: Rows of common characters (first and last lead byte) of the two-byte codecs and the least second byte, and the rows of their syllabic signs.
COMMON = {"gb18030": (0xB0, 0xD7, 0xA1), "big5": (0xA4, 0xC6, 0x40), "shift_jis": (0x88, 0x97, 0x40), "euc_jp": (0xB0, 0xCF, 0xA1), "euc_kr": (0xB0, 0xC8, 0xA1)}
SYLLABLES = {"shift_jis": (0x82, 0x83, 0x40), "euc_jp": (0xA4, 0xA5, 0xA1)}
SIGNS = {"gb18030": ((0xA1, 0xA1, 0xA1), (0xA3, 0xA3, 0xA1)), "big5": ((0xA1, 0xA1, 0x40),), "shift_jis": ((0x81, 0x81, 0x40),), "euc_jp": ((0xA1, 0xA1, 0xA1), (0xA3, 0xA3, 0xA1)), "euc_kr": ((0xA1, 0xA1, 0xA1), (0xA3, 0xA3, 0xA1))}
#: Surprise of the codec itself, which decides where a few characters fit in several: most bodies here are in the first.
FIRST = {"big5": 3.0, "shift_jis": 3.0, "euc_jp": 5.0, "euc_kr": 6.0, "cp1251": 4.0, "koi8_r": 5.0}
#: One-byte codecs, the more usual first.
SINGLE = ("cp1252", "cp1251", "koi8_r", "cp850", "mac_roman")
#: Marks that texts have beside letters.
MARKS = " «»„“”‘’‚–—…·°§€¿¡№•"
#: Surprise (in nats) of characters: ASCII, control; letters in place, capitals, marks, others; what is odd in two-byte codecs.
PLAIN, CONTROL, LETTER, CAPITAL, MARK, OTHER, RARE, ALONE, RUN = 3.4, 14.0, 4.0, 5.5, 5.5, 9.0, 12.5, 4.0, 2.5


@functools.cache
def _rows(codec: str, first: int, last: int, second: int) -> np.ndarray:
    """A table of the characters in these rows of a two-byte codec, by code point."""
    found = np.zeros(1 << 16, bool)
    for lead in range(first, last + 1):
        for b in range(second, 0xFF):
            try:
                c = bytes((lead, b)).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and 0x80 <= ord(c) < 1 << 16:
                found[ord(c)] = True
    return found


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Script (0: no letter, 1 Latin, 2 Cyrillic), lower and upper case, by code point."""
    script, lower, upper = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for i in [*range(0x180), *range(0x400, 0x530)]:
        c = chr(i)
        if c.isalpha() and i not in (0xAA, 0xBA, 0xB5):
            script[i], lower[i], upper[i] = 1 if i < 0x400 else 2, c.islower(), c.isupper()
    return script, lower, upper


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF).astype(np.int64)


def _beside(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place what stands before and behind it."""
    none = np.zeros(1, x.dtype)
    return np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none])


def surprise(text: str, codec: str) -> float:
    """How surprising a body is if it is this text in this codec."""
    c = _codes(text)
    script, lower, upper = (t[c] for t in _letters())
    (s0, s1), (l0, l1), (u0, u1) = _beside(script), _beside(lower), _beside(upper)
    cost = np.full(len(c), PLAIN)
    cost[(c < 0x20) & ~np.isin(c, (9, 10, 13))] = CONTROL
    high = c >= 0x80
    near = (script > 0) & ((s0 == script) | (s1 == script))
    other = (script > 0) & (((s0 > 0) & (s0 != script)) | ((s1 > 0) & (s1 != script)))
    double = codec in COMMON
    cost[high] = RARE if double else OTHER
    cost[high & np.isin(c, _codes(MARKS))] = MARK + (3 if double else 0)
    cost[high & upper & near & ~other & ~l0 & (l1 | u0 | u1)] = CAPITAL + (3 if double else 0)
    cost[high & lower & near & ~other & ~u1] = LETTER + (3 if double else 0)
    accent = high & (script == 1)
    a0, a1 = _beside(accent)
    cost[accent & (a0 | a1)] += RUN  # Latin words are ASCII for the most part
    if double:
        level = _rows(codec, *COMMON[codec])
        common = level[c]
        cost[common] = math.log(int(level.sum()) / (0.4 if codec in SYLLABLES else 0.8))
        for row in SIGNS[codec]:
            cost[_rows(codec, *row)[c]] = math.log(94 / 0.1)
        if codec in SYLLABLES:
            kana = _rows(codec, *SYLLABLES[codec])[c] & (c >= 0x3041) & (c <= 0x30F6)
            cost[kana] = math.log(170 / 0.4)
        cost[high & (script == 0) & ((s0 == 1) | (s1 == 1))] += ALONE
    return float(cost.sum()) + FIRST.get(codec, 0.0)


def _utf16(body: bytes) -> str | None:
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    if len(body) < 4 or len(body) % 2:
        return None
    zeros = np.frombuffer(body, np.uint8).reshape(-1, 2) == 0
    first, second = zeros.mean(0)
    if max(first, second) > 0.3 and min(first, second) < 0.1 * max(first, second) + 1e-9:
        return "utf-16-be" if first > second else "utf-16-le"
    return None


def _decoded(body: bytes, codec: str) -> str | None:
    try:
        return body.decode(codec)
    except (LookupError, UnicodeDecodeError):
        return None


def detected(body: bytes) -> tuple[str, str]:
    """The likeliest codec of a body, and its text. What no codec decodes is taken byte by byte (iso-8859-1)."""
    wide = _utf16(body)
    for codec in ([wide] if wide else []) + ["utf-8-sig"]:
        if (text := _decoded(body, codec)) is not None:
            return codec, text
    best = None
    for codec in (*COMMON, *SINGLE):
        if (text := _decoded(body, codec)) is not None:
            cost = surprise(text, codec)
            if best is None or cost < best[0]:
                best = cost, codec, text
    return best[1:] if best else ("iso-8859-1", body.decode("iso-8859-1"))
