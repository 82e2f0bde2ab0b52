"""Context-mixing range coder for id sequences: many independent blocks advance in step.

Per id, order 2 and order 1 each predict one id: the last one seen after the same two ids (the same
id) in this block, with a run length as confidence. How often a prediction of that confidence was
right so far gives its probability, and adaptive weights mix the two; what they leave is spread by
order 0, the id frequencies of the whole sequence, which the header carries. The mixture drives one
range-coder step per id. All arithmetic is on whole numbers, so any machine decodes the same ids.

A stream is a header and blocks of BLOCK ids. Each block starts from a fresh model and carries a
checksum of its ids. Blocks are lanes of numpy arrays: a step codes one id of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
_MAGIC = b"IDMIX2\0\0"
_HEAD = "<8sQIIIIQ"  # magic, ids, block length, distinct ids, order-0 bits, bits of the context tables, header bytes
SLOTS = 10  # bits of the context tables of a block
_ONE = 1 << 16


def _frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, each at least one."""
    total = 1 << bits
    out = np.maximum(1, counts * (total - len(counts)) // max(int(counts.sum()), 1))
    out[int(out.argmax())] += total - int(out.sum())
    return out


class _Lanes:
    """Model state of all blocks of a stream: both directions make the same moves.

    Arrays of two rows hold order 1 in the first and order 2 in the second, so that one call of numpy
    serves both.
    """

    def __init__(self, lanes: int, frequencies: np.ndarray, bits: int, slots: int):
        self.frequency = frequencies.astype(np.uint64)
        self.below = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.mask = (1 << slots) - 1
        self.table = np.zeros(2 * lanes << slots, np.int32)
        self.right = np.tile(np.array([200, 12000, 26000, 36000, 44000, 50000, 55000, 60000], np.int32), 2 * lanes)
        self.share = np.full((2, lanes), _ONE // 2, np.int32)
        number = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.base, self.group, self.at = number << slots, number * 8, np.zeros((2, lanes), np.int64)
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def shrink(self, n: int) -> None:
        """Only the first n blocks go on."""
        for name in ("share", "base", "group", "at", "before", "last"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., :n]))

    def predict(self) -> None:
        """Sets the predicted ids p and their shares m of 2**16."""
        one, two = self.at
        np.multiply(self.last, 40503, out=one)
        one >>= 4
        np.multiply(self.last, 30011, out=two)
        two += self.before * 51787
        two >>= 5
        self.at &= self.mask
        self.at += self.base
        self.entry = self.table.take(self.at)
        self.p = self.entry >> 3
        self.cell = self.group + (self.entry & 7)
        self.q = self.right.take(self.cell)
        self.m = self.q * (self.share >> 2) >> 14
        moved = self.m[0] * (self.p[0] == self.p[1])
        self.m[1] += moved
        self.m[0] -= moved

    def learn(self, x: np.ndarray) -> None:
        x32 = x.astype(np.int32)
        hit = x32 == self.p
        ones = hit.view(np.int8)
        self.right[self.cell] = self.q + ((ones * np.int32(65000) - self.q) >> 5)
        weight = self.share[1]
        weight += (ones[1] - ones[0]) * np.int32(512)
        np.maximum(weight, 4096, out=weight)
        np.minimum(weight, _ONE - 4096, out=weight)
        np.subtract(_ONE, weight, out=self.share[0])
        self.table[self.at] = np.where(hit, np.minimum(self.entry + 1, self.entry | 7), x32 << 3 | 1)
        self.before, self.last = self.last, x


def _layout(n: int, block: int) -> tuple[int, int]:
    lanes = -(-n // block)
    return lanes, n - (lanes - 1) * block if lanes else 0


def _running(lanes: int, tail: int, step: int) -> int:
    """Blocks that still have an id at this step: only the last block may be short."""
    return lanes if step < tail else lanes - 1


def encode(ids: np.ndarray, block: int = BLOCK, slots: int = SLOTS) -> bytes:
    """One stream for a sequence of unsigned 32-bit ids. An empty sequence gives a bare header.

    Longer blocks and larger tables (slots: their bits) predict better and need more memory: 8 bytes
    times 2**slots for each block of the stream, as all its blocks are coded in step.
    """
    ids = np.ascontiguousarray(ids, np.uint32)
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 20:
        counts = np.bincount(ids, minlength=top)
        kinds = np.flatnonzero(counts)
        ranks, counts = (np.cumsum(counts > 0) - 1)[ids], counts[kinds]
    else:
        kinds, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(16, (2 * len(kinds)).bit_length())
    if bits > 24:
        raise ValueError("more than 2**23 distinct ids in one stream: write shorter streams")
    frequency = _frequencies(counts, bits) if len(kinds) else np.zeros(0, np.int64)
    lanes, tail = _layout(len(ids), block)
    head = zlib.compress(np.diff(kinds.astype(np.int64), prepend=0).astype("<u4").tobytes() + frequency.astype("<u4").tobytes(), 6)
    out = [struct.pack(_HEAD, _MAGIC, len(ids), block, len(kinds), bits, slots, len(head)), head]
    if lanes:
        digits, sizes = _encode_lanes(ranks, frequency, bits, slots, block, lanes, tail)
        sums = np.array([zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4")) for i in range(lanes)], "<u4")
        index = np.stack([sizes.astype("<u4"), sums], 1).astype("<u4").tobytes()
        out += [struct.pack("<I", zlib.crc32(index)), index]
        out += [digits[i, : sizes[i]].astype("<u2").tobytes() for i in range(lanes)]
    return b"".join(out)


def _encode_lanes(ranks: np.ndarray, frequency: np.ndarray, bits: int, slots: int, block: int, lanes: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros(lanes * block, np.int64)
    padded[: len(ranks)] = ranks
    steps = np.ascontiguousarray(padded.reshape(lanes, block).T)
    model = _Lanes(lanes, frequency, bits, slots)
    total = np.uint64(16 + bits)
    room = 3 * block + 8
    digits = np.zeros(lanes * room, np.uint32)
    place = np.arange(lanes, dtype=np.int64) * room
    ends = place.copy()
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    edge, up, top, wide = np.uint64(1 << 48), np.uint64(16), np.uint64(48), np.uint64(bits)
    for t in range(block if lanes > 1 else tail):
        n = _running(lanes, tail, t)
        if n < len(low):
            _flush(digits, place[n:], low[n:])
            ends[n:] = place[n:] + 4
            low, width, place = low[:n], width[:n], place[:n]
            model.shrink(n)
        if not n:
            break
        x = steps[t, :n]
        model.predict()
        m1, m2 = model.m.astype(np.uint64)
        p1, p2 = model.p
        both = m2 + m1
        rest = np.uint64(_ONE) - both
        start = (both << wide) + rest * model.below.take(x)
        size = rest * model.frequency.take(x)
        hit = np.flatnonzero((x == p1) & (m1 > 0))
        start[hit], size[hit] = m2[hit] << wide, m1[hit] << wide
        hit = np.flatnonzero((x == p2) & (m2 > 0))
        start[hit], size[hit] = 0, m2[hit] << wide
        r = width >> total
        moved = low + r * start
        carry = np.flatnonzero(moved < low)
        if len(carry):
            digits[place[carry] - 1] += 1
        low, width = moved, r * size
        due = np.flatnonzero(width < edge)
        while len(due):
            value = low[due]
            digits[place[due]] = (value >> top).astype(np.uint32)
            place[due] += 1
            low[due] = value << up
            width[due] <<= up
            due = due[width[due] < edge]
        model.learn(x)
    _flush(digits, place, low)
    ends[: len(place)] = place + 4
    table = digits.reshape(lanes, room)
    sizes = ends - np.arange(lanes, dtype=np.int64) * room
    for i in range(int(sizes.max()) - 1, 0, -1):  # carries move to the digit before
        over = table[:, i] >> 16
        table[:, i - 1] += over
        table[:, i] &= 0xFFFF
    return table, sizes


def _flush(digits: np.ndarray, place: np.ndarray, low: np.ndarray) -> None:
    for i in range(4):
        digits[place + i] = (low >> np.uint64(48 - 16 * i)).astype(np.uint32) & 0xFFFF


def decode(stream: bytes) -> np.ndarray:
    """The ids of a stream. A block whose checksum differs is an error that names the block."""
    magic, n, block, kinds, bits, slots, size = struct.unpack_from(_HEAD, stream)
    if magic != _MAGIC:
        raise ValueError("not an id stream")
    at = struct.calcsize(_HEAD)
    head = np.frombuffer(zlib.decompress(stream[at : at + size]), "<u4").astype(np.int64)
    names, frequency = np.cumsum(head[:kinds]), head[kinds:]
    at += size
    lanes, tail = _layout(n, block)
    if not lanes:
        return np.zeros(0, np.uint32)
    index = stream[at + 4 : at + 4 + 8 * lanes]
    if struct.unpack_from("<I", stream, at)[0] != zlib.crc32(index):
        raise ValueError("block index: checksum differs")
    sizes, sums = np.frombuffer(index, "<u4").reshape(lanes, 2).astype(np.int64).T
    at += 4 + 8 * lanes
    # an id takes three digits at most: a damaged block reads on, but never past this
    digits = np.append(np.frombuffer(stream, "<u2", int(sizes.sum()), at), np.zeros(3 * block + 8, np.uint16)).astype(np.uint64)
    ranks = _decode_lanes(digits, np.cumsum(sizes) - sizes, frequency, bits, slots, block, lanes, tail)
    ids = names[ranks.T.reshape(-1)[:n]].astype("<u4")
    for i in range(lanes):
        if zlib.crc32(ids[i * block : (i + 1) * block]) != sums[i]:
            raise ValueError(f"block {i}: checksum differs")
    return ids


def _decode_lanes(digits: np.ndarray, place: np.ndarray, frequency: np.ndarray, bits: int, slots: int, block: int, lanes: int, tail: int) -> np.ndarray:
    model = _Lanes(lanes, frequency, bits, slots)
    symbols = np.repeat(np.arange(len(frequency), dtype=np.int32), frequency)
    out = np.zeros((block, lanes), np.int32)
    code = np.zeros(lanes, np.uint64)
    for i in range(4):
        code = code << np.uint64(16) | digits[place + i]
    place = place + 4
    width = np.full(lanes, 2**64 - 1, np.uint64)
    total, edge, up, wide = np.uint64(16 + bits), np.uint64(1 << 48), np.uint64(16), np.uint64(bits)
    most = np.uint64((1 << (16 + bits)) - 1)
    for t in range(block if lanes > 1 else tail):
        n = _running(lanes, tail, t)
        if n < len(code):
            code, width, place = code[:n], width[:n], place[:n]
            model.shrink(n)
        if not n:
            break
        model.predict()
        m1, m2 = model.m.astype(np.uint64)
        p1, p2 = model.p
        both = m2 + m1
        rest = np.uint64(_ONE) - both
        r = width >> total
        v = np.minimum(code // r, most)
        y = v - (both << wide)
        known = v < both << wide
        y[known] = 0
        x = symbols.take((y // rest).view(np.int64)).astype(np.int64)
        start = (both << wide) + rest * model.below.take(x)
        size = rest * model.frequency.take(x)
        some = np.flatnonzero(known)
        if len(some):
            first = v[some] < m2[some] << wide
            own, other = some[first], some[~first]
            x[own], start[own], size[own] = p2[own], 0, m2[own] << wide
            x[other], start[other], size[other] = p1[other], m2[other] << wide, m1[other] << wide
        code -= r * start
        width = r * size
        due = np.flatnonzero(width < edge)
        while len(due):
            code[due] = code[due] << up | digits[place[due]]
            place[due] += 1
            width[due] <<= up
            due = due[width[due] < edge]
        model.learn(x)
        out[t, :n] = x
    return out
