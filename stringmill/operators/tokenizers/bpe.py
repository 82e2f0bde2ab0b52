"""BPE and WordPiece training as a sequence of Spark jobs.

The corpus is a table of distinct lines with counts, stored in parts with an inverted index from
pairs to parts. One job per round sums pair counts: from the index where the merges of the last
rounds do not occur, and from the lines of the other parts. A round commits every merge that is
certain; after some merges the parts that hold them are rewritten, so a lost executor never costs
more than one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.text import SPECIAL_TOKENS
from ...sources.shared import cut_lineage, spread
from ..batches import sliced
from .merges import pair_code, pair_ids
from .model import PREFIX, TokenModel, line_counts
from .pair_index import PairIndex

TOP_PAIRS = 512  # pairs per round that reach the driver
MERGES_PER_CHECKPOINT = 4
MAX_ALPHABET = 1_114_112  # code points there are


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of the texts), none of which is null."""
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    return chars, np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))


def _alphabet(lines: DataFrame, prefix: str, specials: Sequence[str]) -> list[str]:
    """Symbols in id order: plain characters by code point, then prefixed ones."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, MAX_ALPHABET), dtype=bool)  # anywhere, behind the first place
        for texts in sliced(b.column(0) for b in batches):
            chars, offsets = _characters(texts)
            seen[0, chars] = True
            if prefix:
                inner = np.ones(len(chars), dtype=bool)
                inner[offsets[:-1]] = False
                seen[1, chars[inner]] = True
        place, code = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(code, pa.int32())], ["behind", "code"])

    found = lines.select("line").mapInArrow(look, "behind int, code int").distinct().collect()  # at most 2 * MAX_ALPHABET
    plain, inner = (sorted(chr(r["code"]) for r in found if r["behind"] == k) for k in (0, 1))
    return [c for c in plain if c not in specials] + [prefix + c for c in inner]


def _certain_merges(
    top: list[tuple[int, int]], complete: bool, room: int, min_frequency: int, tokens: list[str],
    join, known: set[str],
) -> list[tuple[int, int]]:
    """The next merges that no merge before them in the same round can change.

    ``top`` is sorted by count descending, code ascending. A pair follows safely when it shares
    no occurrence with the merges before it and when no pair with a new symbol can reach its
    count: such a pair occurs at most as often as its old neighbour pair did.
    """
    floor = 0 if complete else top[-1][1]
    chosen: list[tuple[int, int]] = []
    bound = floor
    for code, n in top:
        left, right = pair_ids(code)
        if len(chosen) == room or n < max(1, min_frequency):
            break
        if chosen:
            touched = any(right == a or left == b for a, b in chosen)
            if touched or n <= bound:
                break
        chosen.append((left, right))
        if join(tokens[left], tokens[right]) in known:
            break  # the symbol exists already, so counts of its old pairs change
        for other, m in top:
            a, b = pair_ids(other)
            if other != code and (b == left or a == right):
                bound = max(bound, m)
                break
    return chosen


def train_merges(
    items: DataFrame,
    vocab_size: int,
    min_frequency: int = 1,
    prefix: str = "",
    specials: Sequence[str] = SPECIAL_TOKENS,
    col: str = "item",
    parts: int | None = None,
) -> TokenModel:
    """Merges until ``vocab_size`` tokens besides the specials exist; the alphabet is never cut.

    ``reads`` of the model tells for each round how many merges it chose and how many of all stored
    parts hold them. ``parts`` is their number; by default it follows the size of the corpus.
    """
    lines = spread(cut_lineage(line_counts(items, col)))
    tokens = [*specials, *_alphabet(lines, prefix, specials)]
    ids = {t: i for i, t in enumerate(tokens)}
    target = vocab_size + len(specials)
    merges: list[tuple[str, str]] = []
    pending: list[tuple[int, int, int]] = []
    algorithm = "WORDPIECE" if prefix else "BPE"

    def joined(a: str, b: str) -> str:
        return _joined(a, b, prefix)

    if len(tokens) >= target:
        return TokenModel(algorithm, tuple(tokens), specials=tuple(specials))
    index = PairIndex(lines, _symbol_ids(ids, prefix), target, parts)
    touched: set[int] = set()
    reads: list[tuple[int, int, int]] = []
    while len(tokens) < target:
        top = [tuple(r) for r in index.counts(pending, touched).orderBy(F.col("n").desc(), "code").limit(TOP_PAIRS).collect()]
        if not top:
            break
        masks = {code: mask for code, _, mask in top}
        chosen = _certain_merges(
            [(code, n) for code, n, _ in top], len(top) < TOP_PAIRS, target - len(tokens), min_frequency, tokens, joined, set(ids)
        )
        if not chosen:
            break
        for left, right in chosen:
            token = joined(tokens[left], tokens[right])
            merges.append((tokens[left], tokens[right]))
            if token not in ids:
                ids[token] = len(tokens)
                tokens.append(token)
            pending.append((left, right, ids[token]))
            touched |= index.in_groups(masks[pair_code(left, right)])
        reads.append((len(chosen), len(touched), index.parts))
        # up to half of the parts are cheaper to rewrite now than to read again in every round
        if len(pending) >= MERGES_PER_CHECKPOINT or 2 * len(touched) <= index.parts:
            index.rewrite(pending, touched)
            pending, touched = [], set()
    index.remove()
    return TokenModel(algorithm, tuple(tokens), tuple(merges), specials=tuple(specials), reads=tuple(reads))


def shrink(model: TokenModel, vocab_size: int) -> TokenModel:
    """The model a smaller size would have given: training with a smaller goal stops earlier."""
    target = vocab_size + len(model.specials)
    prefix = PREFIX if model.algorithm == "WORDPIECE" else ""
    made = {_joined(a, b, prefix) for a, b in model.merges}
    tokens = [t for t in model.tokens if t in model.specials or t not in made]
    known, merges = set(tokens), []
    for a, b in model.merges:
        if len(tokens) >= target:
            break
        merges.append((a, b))
        token = _joined(a, b, prefix)
        if token not in known:
            known.add(token)
            tokens.append(token)
    return replace(model, tokens=tuple(tokens), merges=tuple(merges))


def _joined(left: str, right: str, prefix: str) -> str:
    return left + (right[len(prefix) :] if prefix and right.startswith(prefix) else right)


def _symbol_ids(ids: dict[str, int], prefix: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to (ids of all their symbols, offsets of the texts)."""

    def table(mark: str) -> tuple[np.ndarray, np.ndarray]:
        known = sorted((ord(t[-1]), i) for t, i in ids.items() if len(t) == len(mark) + 1 and t.startswith(mark))
        return np.array([c for c, _ in known], dtype=np.uint32), np.array([i for _, i in known], dtype=np.int64)

    codes, plain = table("")
    inner_codes, inner = table(prefix) if prefix else (codes, plain)

    def convert(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chars, offsets = _characters(texts)
        if not prefix:
            return plain[np.searchsorted(codes, chars)], offsets
        first = np.zeros(len(chars), dtype=bool)
        first[offsets[:-1]] = True
        found = np.empty(len(chars), dtype=np.int64)
        found[first] = plain[np.searchsorted(codes, chars[first])]
        found[~first] = inner[np.searchsorted(inner_codes, chars[~first])]
        return found, offsets

    return convert


def train_bpe(
    items: DataFrame, vocab_size: int, min_frequency: int = 1,
    specials: Sequence[str] = SPECIAL_TOKENS, col: str = "item",
) -> TokenModel:
    """BPE over whole lines; ties go to the smaller pair of ids."""
    return train_merges(items, vocab_size, min_frequency, "", specials, col)


def train_wordpiece(
    items: DataFrame, vocab_size: int, min_frequency: int = 1,
    specials: Sequence[str] = SPECIAL_TOKENS, col: str = "item",
) -> TokenModel:
    """The same rounds on symbols that carry the inner mark behind the first one."""
    return train_merges(items, vocab_size, min_frequency, PREFIX, specials, col)
