"""Ways to cut lines into pieces, for all lines of a batch at once.

Lines are sorted by length; one step handles the same position of every line that is still
long enough, so the Python loop runs over positions and piece lengths, not over characters.
"""

from __future__ import annotations

from copy import copy

import numpy as np

CHUNK_CHARS = 250_000  # characters handled together; bounds the memory of a task
_CODE_BITS = 21  # a code point fits


class Lattice:
    """Pieces with scores as a trie of sorted transition keys."""

    def __init__(self, logp: dict[str, float]):
        self.pieces = sorted(logp)
        self.score = np.array([logp[p] for p in self.pieces])
        self.longest = max(map(len, self.pieces))
        lengths = np.array([len(p) for p in self.pieces])
        codes = np.array(self.pieces, f"<U{self.longest}").view(np.uint32).reshape(len(self.pieces), self.longest)
        node, last, keys = np.zeros(len(self.pieces), dtype=np.int64), 0, []
        for k in range(self.longest):  # nodes are numbered by depth, so keys come out sorted
            live = np.flatnonzero(lengths > k)
            level, place = np.unique((node[live] << _CODE_BITS) | codes[live, k].astype(np.int64), return_inverse=True)
            node[live] = last + 1 + place
            last += len(level)
            keys.append(level)
        self.keys = np.concatenate(keys)
        self.child = np.arange(1, last + 1)
        self.ends = np.full(last + 1, -1, dtype=np.int64)
        self.ends[node] = np.arange(len(self.pieces))

    def scored(self, score: np.ndarray) -> Lattice:
        """The same pieces with other scores."""
        out = copy(self)
        out.score = score
        return out

    def matches(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Piece starting at each character per length (row k = length k + 1); -1 = none.

        ``left`` is the number of characters to the end of the line.
        """
        found = np.full((self.longest, len(codes)), -1, dtype=np.int64)
        at, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        for k in range(self.longest):
            inside = left[at] > k
            at, node = at[inside], node[inside]
            key = (node << _CODE_BITS) | codes[at + k]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[slot] == key
            at, node = at[hit], self.child[slot[hit]]
            found[k, at] = self.ends[node]
        return found


def chunks(lines: list[str]) -> list[np.ndarray]:
    """Line numbers in groups of about ``CHUNK_CHARS`` characters, longest line first."""
    lengths = np.array([len(x) for x in lines])
    order = np.argsort(-lengths, kind="stable")
    group = np.cumsum(lengths[order]) // CHUNK_CHARS
    return [g for g in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(g)]


def layout(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, first character of each line, characters left at each character)."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(x) for x in lines])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    return codes, lengths, starts, left


def expected_uses(lattice: Lattice, lines: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all cuts of the lines, weighted."""
    codes, lengths, starts, left = layout(lines)
    found = lattice.matches(codes, left)
    score = np.where(found >= 0, lattice.score[found], -np.inf)
    # one node in front of each character and one behind each line
    nodes = starts + np.arange(len(lines))
    forward = np.full(len(codes) + len(lines), -np.inf)
    backward = forward.copy()
    forward[nodes] = 0.0
    backward[nodes + lengths] = 0.0
    top = int(lengths.max())
    active = np.searchsorted(-lengths, -np.arange(top + 1), side="right")  # lines of at least t
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(1, top + 1):
            n = active[t]
            terms = np.stack(
                [
                    forward[nodes[:n] + t - k] + score[k - 1, starts[:n] + t - k]
                    for k in range(1, min(lattice.longest, t) + 1)
                ]
            )
            forward[nodes[:n] + t] = _log_sum(terms)
        for t in range(top - 1, -1, -1):
            n = active[t + 1]
            here = starts[:n] + t
            terms = np.stack(
                [
                    score[k - 1, here] + _at(backward, nodes[:n] + t + k, left[here] >= k)
                    for k in range(1, lattice.longest + 1)
                ]
            )
            backward[nodes[:n] + t] = _log_sum(terms)
    line = np.repeat(np.arange(len(lines)), lengths)
    node = np.arange(len(codes)) + line
    total = forward[nodes + lengths]
    uses = np.zeros(len(lattice.pieces))
    for k in range(lattice.longest):
        at = np.flatnonzero(found[k] >= 0)
        log_use = forward[node[at]] + score[k, at] + backward[node[at] + k + 1] - total[line[at]]
        uses += np.bincount(
            found[k, at], np.exp(log_use) * weights[line[at]], minlength=len(uses)
        )
    return uses


def best_cut(lattice: Lattice, lines: list[str], unknown: float) -> list[list[int]]:
    """Pieces of the best cut of each line; -1 for a character no piece covers."""
    codes, lengths, starts, left = layout(lines)
    found = lattice.matches(codes, left)
    score = np.where(found >= 0, lattice.score[found], -np.inf)
    score[0] = np.where(found[0] >= 0, score[0], unknown)
    nodes = starts + np.arange(len(lines))
    best = np.full(len(codes) + len(lines), -np.inf)
    step = np.zeros(len(best), dtype=np.int64)
    best[nodes] = 0.0
    top = int(lengths.max())
    active = np.searchsorted(-lengths, -np.arange(top + 1), side="right")
    for t in range(1, top + 1):
        n, longest = active[t], min(lattice.longest, t)
        # from long to short, so that of equal cuts the one with the longer last piece wins
        terms = np.stack(
            [
                best[nodes[:n] + t - k] + score[k - 1, starts[:n] + t - k]
                for k in range(longest, 0, -1)
            ]
        )
        pick = terms.argmax(0)
        best[nodes[:n] + t] = terms[pick, np.arange(n)]
        step[nodes[:n] + t] = longest - pick
    cuts = []
    for start, node, length in zip(starts, nodes, lengths):
        pieces, end = [], int(length)
        while end:
            k = int(step[node + end])
            end -= k
            pieces.append(int(found[k - 1, start + end]))
        cuts.append(pieces[::-1])
    return cuts


def _log_sum(terms: np.ndarray) -> np.ndarray:
    high = terms.max(0)
    base = np.where(np.isfinite(high), high, 0.0)
    return base + np.log(np.exp(terms - base).sum(0))


def _at(values: np.ndarray, index: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.where(inside, values[np.where(inside, index, 0)], -np.inf)
