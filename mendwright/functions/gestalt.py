"""The longest-matching-blocks (gestalt) ratio of many pairs of strings side by side.

Two strings match in their longest common block (the first in the one string, of these the first in the other), and what lies left
and right of it matches in the same way; the ratio is twice the letters in blocks over all letters. Every open stretch
of every pair is a rectangle, and a round finds the longest block of all rectangles at once: row after row of the letters of
the first strings, the lengths of common blocks that end at each letter of the second are an array for all rectangles.
The next round has the rectangles to both sides of the blocks found.

In second strings of 200 letters or more, letters that make up over a hundredth of it (and one) begin no block; blocks extend over them.
"""

from __future__ import annotations

import numpy as np

#: Cells of the arrays of one group of pairs; from so many letters of the second string on frequent letters begin no block.
MOST_CELLS, LONG = 200_000, 200


def ratios(first: list[str | None], second: list[str | None]) -> np.ndarray:
    """The ratio of each pair, in this order (it is not symmetric); 0 if either string is null or empty."""
    out = np.zeros(len(first))
    size_a, size_b = (np.array([len(x) if x else 0 for x in side], np.int64) for side in (first, second))
    open_pairs = np.flatnonzero((size_a > 0) & (size_b > 0))
    order = open_pairs[np.lexsort((size_a[open_pairs], size_b[open_pairs]))]
    at = 0
    while at < len(order):  # pairs of like lengths together
        n = min(len(order) - at, max(1, MOST_CELLS // int(size_b[order[at]] + 2)))
        while n > 1 and n * (int(size_b[order[at + n - 1]]) + 2) > 2 * MOST_CELLS:
            n = (n + 1) // 2
        group = order[at : at + n]
        at += n
        matched = _matched(*_rows([first[i] for i in group], [second[i] for i in group]), size_a[group], size_b[group])
        out[group] = 2.0 * matched / (size_a[group] + size_b[group])
    return out


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, whether a place of a row belongs to its string): rows have a place more than the longest string."""
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.arange(int(sizes.max()) + 1)[None, :] < sizes[:, None]


#: What stands in place of no letter of a first string, of a second one, and of letters that begin no block.
NONE_A, NONE_B, FREQUENT = 0, 1, 2


def _rows(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of both sides as rows of small numbers."""
    (flat_a, in_a), (flat_b, in_b) = _codes(first), _codes(second)
    number = np.zeros(0x110000, np.int32)
    number[flat_a] = number[flat_b] = 1
    found = np.flatnonzero(number)
    number[found] = np.arange(3, len(found) + 3)
    kind = np.uint8 if len(found) < 250 else np.int32
    a, b = np.full(in_a.shape, NONE_A, kind), np.full(in_b.shape, NONE_B, kind)
    a[in_a], b[in_b] = number[flat_a], number[flat_b]
    return a, b


def _frequent(b: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Which letters of long second strings begin no block."""
    long = np.flatnonzero(sizes >= LONG)
    if not len(long):
        return None
    out = np.zeros(b.shape, bool)
    for k in long:
        row = b[k, : sizes[k]]
        _, back, counts = np.unique(row, return_inverse=True, return_counts=True)
        out[k, : sizes[k]] = counts[back] > sizes[k] // 100 + 1
    return out


def _matched(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Letters in blocks of each pair."""
    total = np.zeros(len(a), np.int64)
    frequent = _frequent(b, size_b)
    usable = b if frequent is None else np.where(frequent, b.dtype.type(FREQUENT), b)
    zero = np.zeros(len(a), np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(a)), zero, size_a, zero, size_b
    while len(pair):
        size, i, j = _longest(a, usable, pair, alo, ahi, blo, bhi)
        if frequent is not None:
            size, i, j = _extended(a, b, pair, alo, ahi, blo, bhi, size, i, j)
        np.add.at(total, pair, size)
        left = (size > 0) & (i > alo) & (j > blo)
        right = (size > 0) & (i + size < ahi) & (j + size < bhi)
        pair, alo, ahi, blo, bhi = (
            np.concatenate([pair[left], pair[right]]), np.concatenate([alo[left], (i + size)[right]]), np.concatenate([i[left], ahi[right]]),
            np.concatenate([blo[left], (j + size)[right]]), np.concatenate([j[left], bhi[right]]),
        )
    return total


def _longest(a: np.ndarray, b: np.ndarray, pair: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in a, start in b) of the longest block of each rectangle."""
    n = len(pair)
    # tall rectangles first, so that each row of letters meets those alone that are as tall
    order = np.argsort(alo - ahi, kind="stable")
    pair, alo, blo, height, width = pair[order], alo[order], blo[order], (ahi - alo)[order], (bhi - blo)[order]
    places = np.arange(int(width.max()))
    inside = places[None, :] < width[:, None]
    own = np.where(inside, b[pair[:, None], np.minimum(blo[:, None] + places, b.shape[1] - 1)], b.dtype.type(NONE_B))
    best, end_a, end_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    run = np.zeros((n, own.shape[1] + 1), np.uint8 if own.shape[1] < 255 else np.int32)
    one = run.dtype.type(1)
    tall = np.searchsorted(-height, -np.arange(int(height.max())), side="left")  # so many rectangles have a row i
    for i, m in enumerate(tall.tolist()):
        same = own[:m] == a[pair[:m], alo[:m] + i][:, None]
        run[:m, 1:] = (run[:m, :-1] + one) * same
        longest = run[:m].max(1)
        more = np.flatnonzero(longest > best[:m])
        best[more], end_a[more], end_b[more] = longest[more], i + 1, run[more].argmax(1)
    size, at_a, at_b = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    size[order], at_a[order], at_b[order] = best, alo + end_a - best, blo + end_b - best
    return size, at_a, at_b


def _extended(a: np.ndarray, b: np.ndarray, pair: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks go on over letters that begin none."""
    size, i, j = size.copy(), i.copy(), j.copy()
    while True:
        k = np.flatnonzero((i > alo) & (j > blo))
        k = k[a[pair[k], i[k] - 1] == b[pair[k], j[k] - 1]]
        if not len(k):
            break
        i[k], j[k], size[k] = i[k] - 1, j[k] - 1, size[k] + 1
    while True:
        k = np.flatnonzero((i + size < ahi) & (j + size < bhi))
        k = k[a[pair[k], i[k] + size[k]] == b[pair[k], j[k] + size[k]]]
        if not len(k):
            return size, i, j
        size[k] += 1
