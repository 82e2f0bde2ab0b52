"""Fill-in-the-middle: texts cut at two drawn ranks of their units and put together in another order.

A unit is a run of ASCII letters or any other single code point. The cuts are ranks among a text's
units; an indexable skip list finds them. Its bottom lane links each unit to the next, every further
lane only the units whose tower reaches it (one of FANOUT, by a hash of the unit's number), and a link
carries how many units, code points and bytes it passes. A search adds up the widths from the top
lane down until exactly the asked number of units lies behind it: the sums of the other two widths
are the cut in code points and in bytes. All cuts of a piece of text descend side by side.

Texts are taken in pieces of PIECE bytes; the uppermost lane has a link per piece, and the lanes
below exist only for the piece at hand, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_or_empty
from .words import mix, slices, text_bytes

PIECE = 1 << 20
FANOUT = 8
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_INNER = np.arange(256) & 0xC0 == 0x80  # bytes inside a code point


@dataclass
class Lane:
    """Links of one lane: what each passes, and where its node stands in the lane below."""

    below: np.ndarray
    units: np.ndarray
    chars: np.ndarray
    size: np.ndarray


class SkipList:
    """Units of a piece. starts, chars: byte and code point at which each unit begins, and those of the end."""

    def __init__(self, starts: np.ndarray, chars: np.ndarray):
        self.origin = int(chars[0]), int(starts[0])
        nodes = below = np.arange(len(starts), dtype=np.int32)
        towers = mix(nodes.astype(np.uint64))
        self.lanes: list[Lane] = []
        while True:
            # no search goes across the last node of a lane: its link is longer than the piece
            widths = (np.append(np.diff(x[nodes]), len(starts)).astype(np.int32) for x in (np.arange(len(starts)), chars, starts))
            self.lanes.append(Lane(below, *widths))
            reach = towers[nodes] % np.uint64(FANOUT ** len(self.lanes)) == 0
            reach[0] = True
            below = np.flatnonzero(reach)
            if len(below) < 2:
                return
            nodes = nodes[below]

    def find(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes before the unit of each rank; the rank after the last one is the end."""
        node, units = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        chars, size = (np.full(len(ranks), x, np.int64) for x in self.origin)
        for lane in reversed(self.lanes):
            live = np.arange(len(ranks))
            while len(live):
                live = live[units[live] + lane.units[node[live]] <= ranks[live]]
                at = node[live]
                units[live] += lane.units[at]
                chars[live] += lane.chars[at]
                size[live] += lane.size[at]
                node[live] += 1
            node = lane.below[node].astype(np.int64)
        return chars, size


class Pieces:
    """Some texts in pieces: units and code points before each piece and before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, piece: int = PIECE):
        self.data, self.offsets, self.piece = data, offsets, piece
        self.lows = np.arange(0, max(len(data), 1), piece)
        self.units, self.chars = np.zeros(len(self.lows) + 1, np.int64), np.zeros(len(self.lows) + 1, np.int64)
        self.first_unit, self.first_char = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
        for i in range(len(self.lows)):
            starts, chars, total = self._starts(i)
            low = self.lows[i]
            a, b = np.searchsorted(offsets, [low, low + piece])
            b = len(offsets) if i == len(self.lows) - 1 else b
            here = offsets[a:b] - low
            self.first_unit[a:b] = self.units[i] + np.searchsorted(starts, here)
            self.first_char[a:b] = self.chars[i] + np.append(chars, total)[here]
            self.units[i + 1], self.chars[i + 1] = self.units[i] + len(starts), self.chars[i] + total

    def _starts(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Bytes of a piece at which units begin, code points before each of its bytes, and all of them."""
        low = int(self.lows[i])
        part = self.data[low : low + self.piece]
        letter, whole = _LETTER[part], ~_INNER[part]
        goes_on = letter.copy()
        goes_on[1:] &= letter[:-1]
        if len(part):
            goes_on[0] &= low > 0 and _LETTER[self.data[low - 1]]
        a, b = np.searchsorted(self.offsets, [low, low + len(part)])
        goes_on[self.offsets[a:b] - low] = False  # a text begins
        passed = np.cumsum(whole, dtype=np.int32)
        return np.flatnonzero(whole & ~goes_on), passed - whole, int(passed[-1]) if len(part) else 0

    def find(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes before each of the units, counted over all texts."""
        chars, size = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        home = np.searchsorted(self.units[:-1], ranks, "right") - 1
        for i in np.unique(home):
            own = np.flatnonzero(home == i)
            starts, passed, total = self._starts(i)
            end = min(self.piece, len(self.data) - int(self.lows[i]))
            found = SkipList(np.append(starts, end), np.append(passed[starts], total)).find(ranks[own] - self.units[i])
            chars[own], size[own] = found[0] + self.chars[i], found[1] + self.lows[i]
        return chars, size


def draws(key: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of each row: the first digits of the sha256 of "seed:key"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    percent of the texts are cut at two drawn ranks, spm_percent of these put the suffix first (form
    spm), the others the prefix (psm). The remaining texts, empty and null ones and texts that hold a
    marker are plain: output is the text, the two lengths are null. Draws depend on seed and id alone,
    so equal ids draw alike and reruns agree; a null id counts as empty. All other columns are left.
    """
    h = draws(key, seed)
    whole = text_or_empty(text)
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (whole == "") | marked | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            pieces = Pieces(data, offsets)
            n = np.diff(pieces.first_unit)
            drawn = np.sort([batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")], axis=0)
            forms = batch.column("form").to_pylist()
            cut = np.array([f != "plain" for f in forms], bool)
            ranks = (pieces.first_unit[:-1] + drawn)[:, cut]
            chars, size = (x.reshape(2, -1) for x in pieces.find(ranks.ravel()))
            raw, out, j = memoryview(data), [], 0
            for i, f in enumerate(forms):
                start, end = int(offsets[i]), int(offsets[i + 1])
                if f == "plain":
                    out.append(bytes(raw[start:end]))
                    continue
                one, two = size[:, j].tolist()
                prefix, middle, suffix = raw[start:one], raw[one:two], raw[two:end]
                first = (marks[0], prefix, marks[1], suffix) if f == "psm" else (marks[1], suffix, marks[0], prefix)
                out.append(b"".join((*first, marks[2], middle)))
                j += 1
            lengths = np.zeros((2, len(forms)), np.int64)
            lengths[0, cut], lengths[1, cut] = chars[0] - pieces.first_char[:-1][cut], chars[1] - chars[0]
            arrays = [batch.column("doc_id"), pa.array(n), batch.column("form"), *(pa.array(x, mask=~cut) for x in lengths), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, SCHEMA)


def restored(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """Adds the text from which an output was made. No part of a cut text holds a marker."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return rows.withColumn(into, F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output)))
