"""Order and common prefixes of byte strings by deep-shallow sorting.

Multikey quicksort orders the strings by 8-byte letters down to a shallow depth. Groups
that still agree there go into a blind trie: an inner node knows only the depth at which
its strings first differ and the byte that leads to each child, so a string is inserted
with one blind descent, one comparison with the leaf found, and one split.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 8
"""Depth of the quicksort, in 8-byte letters."""
PAD = 0xFF
"""Stands behind the end of a string; UTF-8 has no such byte, so a string never looks like a longer one."""


def matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of bytes, padded to whole letters, and their lengths."""
    sizes = np.array([len(s) for s in strings], np.int64)
    width = max(8, -(-int(sizes.max(initial=0)) // 8) * 8)
    rows = np.full((len(strings), width), PAD, np.uint8)
    at = np.arange(width) < sizes[:, None]
    rows[at] = np.frombuffer(b"".join(strings), np.uint8)
    return rows, sizes


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int) -> None:
        self.depth, self.children, self.leaf = depth, {}, leaf


def blind_trie_order(strings: list[bytes], group: list[int]) -> list[int]:
    """group ordered by its strings; equal strings keep their order."""

    def letter(i: int, depth: int) -> int:
        s = strings[i]
        return s[depth] if depth < len(s) else PAD

    equal: dict[int, list[int]] = {}
    root = None
    for i in group:
        s = strings[i]
        if root is None:
            root = _Node(-1, i)
            equal[i] = [i]
            continue
        node = root
        while node.children:  # blind: looks only at the bytes where the trie branches
            node = node.children.get(letter(i, node.depth)) or next(iter(node.children.values()))
        other = node.leaf
        depth = common(s, strings[other])
        if depth == len(s) == len(strings[other]):
            equal[other].append(i)
            continue
        equal[i] = [i]
        node, parent, edge = root, None, 0
        while node.children and node.depth < depth:
            parent, edge = node, letter(i, node.depth)
            node = node.children[edge]
        if node.children and node.depth == depth:
            node.children[letter(i, depth)] = _Node(-1, i)
            continue
        split = _Node(depth, other)
        split.children = {letter(other, depth): node, letter(i, depth): _Node(-1, i)}
        if parent is None:
            root = split
        else:
            parent.children[edge] = split
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node.children:
            stack += [node.children[k] for k in sorted(node.children, reverse=True)]
        else:
            out += equal[node.leaf]
    return out


def deep_shallow(strings: list[bytes], rows: np.ndarray) -> np.ndarray:
    """Numbers of the strings in order."""
    letters = rows.view(">u8").astype(np.uint64)
    out: list[int] = []
    stack = [(np.arange(len(strings)), 0)] if strings else []
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out.append(int(group[0]))
        elif depth >= min(SHALLOW, letters.shape[1]):
            out += blind_trie_order(strings, group.tolist())
        else:
            x = letters[group, depth]
            pivot = np.partition(x, len(x) // 2)[len(x) // 2]
            less, more = x < pivot, x > pivot
            for part, d in ((group[more], depth), (group[~(less | more)], depth + 1), (group[less], depth)):
                if len(part):
                    stack.append((part, d))
    return np.array(out, np.int64)


def sorted_with_prefixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it in that order (0 for the first)."""
    rows, sizes = matrix(strings)
    order = deep_shallow(strings, rows)
    prefix = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 4096):
        i, j = order[a - 1 : a + 4095], order[a : a + 4096]
        i = i[: len(j)]
        differs = rows[i] != rows[j]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        prefix[a : a + len(j)] = np.minimum(first, np.minimum(sizes[i], sizes[j]))
    return order, prefix
