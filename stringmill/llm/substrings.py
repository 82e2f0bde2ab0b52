"""Repeated passages: every word of a window of n words that also starts somewhere else goes.

Levels double: seeds of about n / 4 words, then twice that length, then n words. Only windows that
repeat at one length alone are extended to the next, both ways, until the full length is reached or
no candidate survives.

Seeds are not all windows but anchors: in every stretch of n words the seed with the smallest hash.
Equal stretches have equal anchors, so every repeated window is met through its anchor, at a
thirteenth of the positions. A level's repeated hashes are counted by a shuffle of hashes alone,
then looked up by the workers in memory-mapped sorted arrays: no text moves. The arrays' size is
checked first; above MAPPED_ROWS the marks come back to the texts by joins instead, with the same
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hash_files
from .base import id_and_text, stored, text_or_empty
from .words import Words, ragged, slices, words_of

WINDOW = 50
#: Hashes of repeated windows that workers may map: at most 16 bytes each, so 4 GB of page cache.
MAPPED_ROWS = 1 << 28
_GATHER = 1 << 21


def levels(n: int) -> list[int]:
    """Window lengths from the seed on: each at most twice the one before, the last is n."""
    out = [n]
    while out[0] > 12:
        out.insert(0, -(-out[0] // 2))
    return out


def anchors(seeds: np.ndarray, inside: np.ndarray, run: int) -> np.ndarray:
    """For each position, the position of the smallest seed among run ones from there on (leftmost)."""
    values = np.where(inside, seeds, np.uint64(2**64 - 1))
    best = np.arange(len(values))
    width = 1
    while width < run:  # minima over doubling widths
        step = min(width, run - width)
        other = np.minimum(np.arange(len(values)) + step, len(values) - 1)
        challenger = best[other]
        best = np.where(values[challenger] < values[best], challenger, best)
        width += step
    return best


@dataclass
class Level:
    """Windows of one length in a slice of texts: their hashes, and which of them are candidates."""

    length: int
    at: np.ndarray
    hashes: np.ndarray
    second: np.ndarray | None = None


class Scan:
    """Candidate windows of a slice, level by level; known answers tell which windows repeat."""

    def __init__(self, words: Words, n: int):
        self.words, self.n, self.lengths = words, n, levels(n)
        single = words.hashes(21)
        self.single = single
        self.left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(single))
        seeds, inside = words.windows(single, self.lengths[0], 22)
        self.starts = np.flatnonzero(self.left >= n)
        self.anchor = anchors(seeds, inside, n - self.lengths[0] + 1)[self.starts] if len(self.starts) else self.starts
        self.alive = np.ones(len(self.starts), bool)
        self.place, self.depth, self._wide = self.anchor, 0, {self.lengths[0]: seeds}

    def wide(self, length: int) -> np.ndarray:
        if length not in self._wide:
            self._wide[length] = self.words.windows(self.single, length, 22)[0]
        return self._wide[length]

    def level(self) -> Level:
        """Distinct candidate windows of the current length."""
        length = self.lengths[self.depth]
        if self.depth == len(self.lengths) - 1:
            at = self.starts[self.alive]
            return Level(length, at, self.wide(length)[at], self.words.windows(self.words.hashes(23), length, 24)[0][at])
        at = np.unique(self.place[self.alive])
        return Level(length, at, self.wide(length)[at])

    def keep(self, level: Level, repeated: np.ndarray) -> None:
        """Goes on to the next length with the windows that repeat at this one."""
        good = np.zeros(len(self.single) + 1, bool)
        good[level.at[repeated]] = True
        if self.depth == len(self.lengths) - 1:
            self.alive &= good[self.starts]
            return
        self.alive &= good[self.place]
        self.depth += 1
        if self.depth < len(self.lengths) - 1:
            # extended to the right where the window holds that, else to the left
            length, old = self.lengths[self.depth], self.lengths[self.depth - 1]
            fits = self.place + length <= self.starts + self.n
            self.place = np.where(fits, self.place, np.maximum(self.place + old - length, self.starts))

    def covered(self) -> np.ndarray:
        """Words inside a repeated window, once all levels are done."""
        edges = np.zeros(len(self.single) + 1, np.int64)
        at = self.starts[self.alive]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.n, -1)
        return np.cumsum(edges)[:-1] > 0


def _scan(batch: pa.RecordBatch, n: int, answers: list) -> Scan:
    """A scan through all levels that are answered: by mapped hashes, or (None) by the texts' marks."""
    scan = Scan(words_of(batch.column("text")), n)
    for depth, answer in enumerate(answers):
        level = scan.level()
        if answer is None:
            marks = batch.column(f"marks_{depth}")
            sizes = np.where(marks.is_valid().to_numpy(zero_copy_only=False), np.diff(marks.offsets.to_numpy()), 0)
            known = np.repeat(scan.words.first[:-1], sizes) + marks.flatten().to_numpy()
            repeated = np.isin(level.at, known)
        else:
            also = None if level.second is None else {"second": level.second.view(np.int64)}
            repeated = answer.find(level.hashes, also=also)[0]
        scan.keep(level, repeated)
    return scan


def _counts(texts: DataFrame, n: int, answers: list) -> DataFrame:
    """Hashes of the next level's candidates that occur more than once: hash, second."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            level = _scan(batch, n, answers).level()
            held.append((level.hashes, np.zeros(len(level.at), np.uint64) if level.second is None else level.second))
            size += len(level.at)
            if size >= _GATHER:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield tuple(map(np.concatenate, zip(*held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second in gathered(batches):
            order = np.lexsort((second, first)) if second.any() else np.argsort(first)
            first, second = first[order], second[order]
            new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
            many = np.diff(np.append(new, len(first)))
            for low in range(0, len(new), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(first[new[part]].view(np.int64)), pa.array(second[new[part]].view(np.int64)), pa.array(many[part])], names=["hash", "second", "n"])

    found = texts.mapInArrow(run, "hash long, second long, n long")
    return found.groupBy("hash", "second").agg(F.sum("n").alias("n")).where("n > 1").select("hash", "second")


def _marked(texts: DataFrame, n: int, answers: list, repeated: DataFrame) -> DataFrame:
    """The texts with the positions of their candidates that repeat, found by a join on the hashes."""
    depth = len(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scan = _scan(batch, n, answers)
            level = scan.level()
            owner = np.searchsorted(scan.words.first, level.at, "right") - 1
            second = np.zeros(len(level.at), np.uint64) if level.second is None else level.second
            arrays = [batch.column("text_key").take(pa.array(owner)), pa.array(level.at - scan.words.first[owner]), pa.array(level.hashes.view(np.int64)), pa.array(second.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["text_key", "at", "hash", "second"])

    once = texts.dropDuplicates(["text_key"])
    windows = once.mapInArrow(run, "text_key string, at long, hash long, second long")
    marks = windows.join(repeated, ["hash", "second"], "left_semi").groupBy("text_key").agg(F.collect_list("at").alias(f"marks_{depth}"))
    return stored(texts.join(marks, "text_key", "left"), "marked")


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    lengths = np.where(keep, words.ends - words.starts + 1, 0)
    at = ragged(words.starts, lengths)
    out = np.append(words.data, np.uint8(32))[at]
    ends = np.cumsum(lengths)
    out[ends[lengths > 0] - 1] = 32
    total = np.append(0, ends)[words.first]
    last = np.zeros(len(out), bool)
    last[total[1:][np.diff(total) > 0] - 1] = True  # no space after a text's last word
    offsets = total - np.append(0, np.cumsum(np.diff(total) > 0))
    out = np.ascontiguousarray(out[~last])
    return pa.Array.from_buffers(pa.string(), len(total) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW, mapped_rows: int = MAPPED_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs of non-space bytes, compared as they are. A word goes when a window of n words
    that covers it has a word sequence that also starts at another place, in the same text or any
    other; windows are judged on the input. So of several copies none stays. Null, empty and short
    texts (under n words) have no window and lose nothing. Repeated rows are copies of each other.
    """
    texts = id_and_text(docs, key, text)
    answers: list = []
    for _ in levels(n):
        repeated = stored(_counts(texts, n, answers), "repeated")
        rows = repeated.count()
        if rows <= mapped_rows:
            answers.append(hash_files.write(repeated, "windows", rows))
        else:
            if "text_key" not in texts.columns:
                texts = texts.withColumn("text_key", F.sha2(text_or_empty("text").cast("binary"), 256))
            texts = _marked(texts, n, answers, repeated)
            answers.append(None)
        if not rows:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scan = _scan(batch, n, answers)
            gone = scan.covered()
            first = scan.words.first
            removed = np.diff(np.append(0, np.cumsum(gone))[first])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(removed), _joined(scan.words, ~gone)], names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
