"""Bit-sliced Hamming comparison.

Fingerprints are stored vertically: plane p holds bit p of 64 fingerprints in each
machine word. Sorted rows are compared with the rows ``o`` places further on, for every
offset o inside a group at once; one XOR of two plane words yields a differing bit of
64 pairs, and carry-save adders keep 64 distances in a few counter words. After every
eight planes the words (blocks of 64 pairs) in which each distance already exceeds the
radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits that the sets of a comparison are packed into at most; beyond it they are compared as lists.
MOST_BITS = 1 << 30
#: Pairs held before they are reduced to a forest.
PAIRS_HELD = 1 << 20


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(n, w) uint64 fingerprints as (64 w, words) bit planes with one spare zero word."""
    n = len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    words = -(-n // 64) + 1
    out = np.zeros((bits.shape[1], words * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _words(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _unpack(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def _csa(a, b, c):
    half = a ^ b
    return (a & b) | (half & c), half ^ c


def _add_eight(count: list[np.ndarray], x: np.ndarray) -> None:
    """Add eight planes of differing bits to the vertical counters, in place."""
    ones, twos, fours = count[:3]
    two_a, ones = _csa(ones, x[0], x[1])
    two_b, ones = _csa(ones, x[2], x[3])
    four_a, twos = _csa(twos, two_a, two_b)
    two_a, ones = _csa(ones, x[4], x[5])
    two_b, ones = _csa(ones, x[6], x[7])
    four_b, twos = _csa(twos, two_a, two_b)
    carry, fours = _csa(fours, four_a, four_b)
    count[:3] = ones, twos, fours
    for k in range(3, len(count)):
        count[k], carry = count[k] ^ carry, count[k] & carry


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical counters hold more than ``radius``."""
    above = np.zeros_like(count[0])
    equal = ~above
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def _at_offset(planes: np.ndarray, valid: np.ndarray, offset: int, radius: int):
    """Rows i and distances of the pairs (i, i + offset) marked in ``valid`` within the radius."""
    skip, shift = np.divmod(offset, 64)
    live = np.flatnonzero(valid)
    alive = valid[live]
    count = [np.zeros(len(live), np.uint64) for _ in range(len(planes).bit_length())]
    right, left = np.uint64(shift), np.uint64((64 - shift) % 64)
    last = planes.shape[1] - 1
    for p in range(0, len(planes), 8):
        block = planes[p : p + 8]
        other = block[:, np.minimum(live + skip, last)] >> right
        if shift:
            other |= block[:, np.minimum(live + skip + 1, last)] << left
        _add_eight(count, block[:, live] ^ other)
        alive = alive & ~_above(count, radius)
        some = alive != 0
        if not some.all():
            live, alive, count = live[some], alive[some], [c[some] for c in count]
            if not len(live):
                return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(_unpack(alive))
    distance = sum(_unpack(c)[at].astype(np.int64) << k for k, c in enumerate(count))
    return live[at >> 6] * 64 + (at & 63), distance


def minimum_forest(i: np.ndarray, j: np.ndarray, d: np.ndarray):
    """Edges of a minimum spanning forest (Boruvka), ties to the smaller (i, j)."""
    order = np.lexsort((j, i, d))
    i, j, d = i[order], j[order], d[order]
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    label, keep, left = np.arange(len(nodes)), np.zeros(len(i), bool), np.arange(len(i))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return i[keep], j[keep], d[keep]
        best = np.full(len(nodes), len(i))
        back = left[::-1]  # the last assignment, of the smallest edge, stays
        best[label[a[back]]] = back
        for end in (a, b):
            np.minimum.at(best, label[end[left]], left)
        roots = np.flatnonzero(best < len(i))
        edge = best[roots]
        keep[edge] = True
        to = np.arange(len(nodes))
        to[roots] = np.where(label[a[edge]] == roots, label[b[edge]], label[a[edge]])
        own = np.arange(len(nodes))
        mutual = (to[to] == own) & (own < to)
        to[mutual] = own[mutual]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def forest_within(prints: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int):
    """A minimum spanning forest of each group's pairs within ``radius``: arrays i, j, d.

    ``prints`` (n, w) uint64; rows of a group are adjacent and ``group`` is its number.
    Where ``cross`` is set only pairs of different ``side`` count.
    """
    rows = np.arange(len(group))
    found = [np.empty(0, np.int64)] * 3
    held: list[tuple] = []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else rows
    sizes = np.diff(np.r_[starts, len(group)])
    size = np.repeat(sizes, sizes)
    planes = planes_of(prints) if len(group) else None
    offset = 1
    while len(rows) > offset:
        going = size[rows] > offset
        if not going.any():
            break
        if going.sum() * 2 < len(rows):
            rows = rows[going]
            planes = planes_of(prints[rows])
        g, s = group[rows], side[rows]
        ok = (g[:-offset] == g[offset:]) & (~cross[rows[offset:]] | (s[:-offset] != s[offset:]))
        at, d = _at_offset(planes, _words(ok, planes.shape[1]), offset, radius)
        if len(at):
            held.append((rows[at], rows[at + offset], d))
            if sum(len(x[0]) for x in held) > PAIRS_HELD:
                held = [minimum_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        offset += 1
    if held:
        found = minimum_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return found


def pairs_within(prints: np.ndarray, side: np.ndarray, cross: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i < j and distances of all pairs within ``radius``, of different ``side`` if ``cross``, some at a time."""
    planes = planes_of(prints)
    for offset in range(1, len(prints)):
        ok = side[:-offset] != side[offset:] if cross else np.ones(len(prints) - offset, bool)
        at, d = _at_offset(planes, _words(ok, planes.shape[1]), offset, radius)
        if len(at):
            yield at, at + offset, d


def _packed(rows: np.ndarray, columns: np.ndarray, n: int, width: int) -> np.ndarray:
    """A bit for each (row, column), in words."""
    out = np.zeros((n, -(-width // 64) * 8), np.uint8)
    np.bitwise_or.at(out, (rows, columns >> 3), (1 << (columns & 7)).astype(np.uint8))
    return out.view(np.uint64)


def similar_forest(prints: np.ndarray, sizes: np.ndarray, values: np.ndarray, side: np.ndarray, cross: bool, radius: int, similarity: float):
    """A spanning forest i, j of the pairs within ``radius`` whose sets have the Jaccard similarity.

    ``sizes`` and ``values`` hold each row's set of numbers, one after the other. Nearest
    prints come first; a pair whose ends are joined already isn't checked.
    """
    n = len(prints)
    label = np.arange(n)
    out_i: list[int] = []
    out_j: list[int] = []
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    again = count > 1  # what one row has alone is shared with none
    width, number = int(again.sum()), np.cumsum(again) - 1
    few = n * width <= MOST_BITS
    if few:
        shared = again[column]
        packed = _packed(row[shared], number[column[shared]], n, width)
    ends = np.r_[0, np.cumsum(sizes)]

    def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if few:
            return np.bitwise_count(packed[a] & packed[b]).sum(axis=1, dtype=np.int64)
        own = lambda k: values[ends[k] : ends[k + 1]]
        return np.array([len(np.intersect1d(own(u), own(v), assume_unique=True)) for u, v in zip(a, b, strict=True)], np.int64)

    def check(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        order = np.argsort(d, kind="stable")
        i, j = i[order], j[order]
        at, step, most = 0, 1024, max(64, min(1 << 16, (1 << 22) // max(1, width // 64)))
        while at < len(i):
            a, b = i[at : at + step], j[at : at + step]
            at, step = at + step, min(step * 4, most)
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            open_ = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
            a, b = a[open_], b[open_]
            if not len(a):
                continue
            both = overlap(a, b)
            good = both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9
            for u, v in zip(a[good].tolist(), b[good].tolist(), strict=True):
                if label[u] != label[v]:
                    out_i.append(u)
                    out_j.append(v)
                    label[label == label[v]] = label[u]

    held: list[tuple] = []
    for found in pairs_within(prints, side, cross, radius):
        held.append(found)
        if sum(len(x[0]) for x in held) > PAIRS_HELD:
            check(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        check(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return np.array(out_i, np.int64), np.array(out_j, np.int64)
