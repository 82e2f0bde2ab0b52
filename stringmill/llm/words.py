"""Words and hashes of whole Arrow batches at once, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D (none of them occurs inside a UTF-8
sequence). Nulls count as empty texts. Everything works on slices of some MB, so that memory
follows the slice and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG_WORD = 64
_LANE_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over the whole value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x5D2E_9C1B_7F4A_8E63  # any odd number; one table of its powers serves all hashes
_BLOCK = 1 << 17
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0 to n at least of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(1 << n.bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


class Rolling:
    """Polynomial hashes of spans of a sequence from one running sum (modulo 2**64).

    For spans of up to 64 values. The low bits of longer ones depend on few bits of the values where
    these alternate in the pattern of Thue and Morse, so windows() joins longer windows from parts.
    """

    def __init__(self, seed: int):
        self.seed = np.uint64(seed)
        self.bytes = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, np.uint64)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each span; starts ascend. Sums run block by block."""
        out = np.empty(len(starts), np.uint64)
        edges = np.append(np.searchsorted(starts, np.arange(0, max(len(values), 1), _BLOCK)), len(starts))
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            low, high = int(starts[a]), int(ends[a:b].max())
            up, down = _power_tables(high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[low:high] * up[: high - low], out=total[1:])
            h = total[ends[a:b] - low]
            h -= total[starts[a:b] - low]
            h *= down[starts[a:b] - low]
            out[a:b] = mix(h + (ends[a:b] - starts[a:b]).astype(np.uint64))
        return out

    def windows(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n consecutive values."""
        many = max(len(hashes) - n + 1, 0)
        width = min(n, 64)
        starts = np.arange(max(len(hashes) - width + 1, 0))
        out = self.spans(hashes, starts, starts + width)
        while width < n:
            step = min(width, n - width)
            out = mix(mix(out[: len(out) - step] + self.seed) ^ out[step:]) if len(out) > step else out[:0]
            width += step
        return out[:many]


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the bytes of each span: eight bytes a step, the library's hash for those above LONG_WORD."""
    lengths = ends - starts
    lanes = _lane(data)
    first = int(mix(np.array([seed], np.uint64))[0])
    h = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(first)
    live = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(live):
        rest = lengths[live] - at
        lane = lanes[starts[live] + at]
        lane &= _LANE_MASKS[np.minimum(rest, 8)]
        h[live] = mix(h[live] ^ lane)
        at += 8
        live = live[rest > 8]
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]], first)
    return h


@lru_cache(None)
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


def _lane(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


@dataclass
class Words:
    """Words of some texts: byte spans, and the index of the first word of each text."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 1) -> np.ndarray:
        return _span_hashes(self.data, self.starts, self.ends, seed)

    def texts(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, hashes: np.ndarray, n: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Hash of n words from each word on, and whether they lie in one text."""
        out = np.zeros(len(hashes), np.uint64)
        if len(hashes) >= n:
            out[: len(hashes) - n + 1] = rolling(seed).windows(hashes, n)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(hashes))
        return out, left >= n


def same_words(words: Words, at: np.ndarray, others: Words, place: np.ndarray) -> np.ndarray:
    """Whether words and others have equal bytes, pair by pair."""
    sizes = words.ends[at] - words.starts[at]
    equal = sizes == others.ends[place] - others.starts[place]
    lanes, other_lanes = _lane(words.data), _lane(others.data)
    live, done = np.flatnonzero(equal), 0
    while len(live):
        mask = _LANE_MASKS[np.minimum(sizes[live] - done, 8)]
        equal[live] = (lanes[words.starts[at[live]] + done] ^ other_lanes[others.starts[place[live]] + done]) & mask == 0
        done += 8
        live = live[equal[live] & (sizes[live] > done)]
    return equal


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if where else np.zeros(1, np.int64)
    if raw is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of text; a longer text has a batch of its own."""
    for batch in batches:
        lengths = text_bytes(batch.column(text))[1]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(lengths, lengths[low] + size, "right")) - 1)
            yield part_of(batch, low, high)
            low = high
    batch = lengths = None
    give_back()


def part_of(batch: pa.RecordBatch, low: int, high: int) -> pa.RecordBatch:
    """Some rows of a batch; its last ones are a copy, so that who still has them doesn't hold the batch."""
    part = batch.slice(low, high - low)
    return part if high < batch.num_rows else part.take(pa.array(np.arange(len(part))))


def give_back() -> None:
    """Hands unused memory to the system: a Python worker waits for its next task, beside others."""
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """Splits all texts into words, with A-Z in lower case where asked for; space marks the bytes between words."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def ascii_lower(words: Words, but: bytes) -> Words:
    """The same words with A-Z in lower case, except words that hold other than ASCII or the two bytes but.

    A letter followed by a combining mark may have a composed form in one case only, so that lower
    case before and after normalisation differ: such words stay as they are.
    """
    kept = words.data >= 128
    kept[:-1] |= (words.data[:-1] == but[0]) & (words.data[1:] == but[1])
    data = _LOWER[words.data]
    if kept.any():
        total = np.append(0, np.cumsum(kept))
        at = np.flatnonzero(total[words.ends] > total[words.starts])
        own = ragged(words.starts[at], (words.ends - words.starts)[at])
        data[own] = words.data[own]
    return Words(data, words.offsets, words.starts, words.ends, words.first)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of several runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
