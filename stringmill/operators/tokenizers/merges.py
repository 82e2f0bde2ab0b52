"""Numpy steps on one Arrow batch: apply merges, count neighbours.

Symbols of all lines of a batch lie in one array with -1 behind each line, so one step
handles every line of the batch at once.
"""

from __future__ import annotations

import numpy as np

SHIFT = 32  # a pair of ids is one long: left << SHIFT | right
MAX_SQUARE = 1024  # with more ids, pairs are sorted, not counted in a table of all pairs


def pair_code(left, right):
    return (left << SHIFT) | right


def pair_ids(code: int) -> tuple[int, int]:
    return code >> SHIFT, code & ((1 << SHIFT) - 1)


def flatten(values: np.ndarray, offsets: np.ndarray, end: int = -1, kind: type | np.dtype = np.int64) -> np.ndarray:
    """Concatenated symbols with ``end`` behind each line."""
    lengths = np.diff(offsets)
    out = np.full(len(values) + len(lengths), end, dtype=kind)
    line = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(values)) + line] = values
    return out


def unflatten(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an array made by :func:`flatten`."""
    ends = np.flatnonzero(flat == -1)
    offsets = np.concatenate(([0], ends - np.arange(len(ends))))
    return flat[flat != -1], offsets


def _without_overlap(at: np.ndarray) -> np.ndarray:
    """In a run of equal symbols every second position starts a merge."""
    run_start = np.concatenate(([True], np.diff(at) != 1))
    first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def apply_merge(flat: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """Replaces the pair by the new symbol, from left to right."""
    at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
    if not len(at):
        return flat
    if left == right:
        at = _without_overlap(at)
    flat = flat.copy()
    flat[at] = new
    keep = np.ones(len(flat), dtype=bool)
    keep[at + 1] = False
    return flat[keep]


def count_pairs(flat: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of all neighbours inside lines; ``end``, above all ids, stands behind each line."""
    size = end + 1
    if size > MAX_SQUARE:
        inside = (flat[:-1] != end) & (flat[1:] != end)
        return np.unique(pair_code(flat[:-1][inside].astype(np.int64), flat[1:][inside].astype(np.int64)), return_counts=True)
    found = flat[:-1].astype(np.int64)
    found *= size
    found += flat[1:]
    square = np.bincount(found, minlength=size * size).reshape(size, size)[:end, :end]
    left, right = np.nonzero(square)
    return pair_code(left, right), square[left, right]


def encode_flat(flat: np.ndarray, codes: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> np.ndarray:
    """Applies merges by rank, lowest rank present first, until none applies.

    ``codes`` is sorted; ``ranks`` and ``results`` belong to it. The rank of each pair is kept
    next to its left symbol and looked up again only around the symbols of the last merge.
    """
    if not len(codes) or not len(flat):
        return flat
    none = np.iinfo(np.int64).max
    by_rank = np.argsort(ranks)

    def rank_at(where: np.ndarray) -> np.ndarray:
        left, right = flat[where], flat[where + 1]
        pairs = np.where((left == -1) | (right == -1), -1, pair_code(left, right))
        slot = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
        return np.where(codes[slot] == pairs, ranks[slot], none)

    rank = np.full(len(flat), none)
    rank[:-1] = rank_at(np.arange(len(flat) - 1))
    while (low := rank.min()) != none:
        i = by_rank[low]
        left, right = pair_ids(int(codes[i]))
        at = np.flatnonzero(rank == low)
        if left == right:
            at = _without_overlap(at)
        flat[at] = results[i]
        keep = np.ones(len(flat), dtype=bool)
        keep[at + 1] = False
        flat, rank = flat[keep], rank[keep]
        merged = at - np.arange(len(at))  # one symbol less per earlier merge
        # a line ends with -1, so a merged symbol always has a right neighbour
        near = np.concatenate((merged, merged - 1))
        near = near[near >= 0]
        rank[near] = rank_at(near)
    return flat
