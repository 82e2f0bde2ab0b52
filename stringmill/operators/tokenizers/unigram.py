"""Unigram training: seed pieces by count, then EM rounds with pruning, each one a Spark job.

Seeds come from one window per character, sorted like suffixes: neighbours that share a prefix are
the places of that prefix, so no row lists the substrings of a line. A window that begins in one
place of a task's range and a prefix that goes beyond it are added up afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.text import SPECIAL_TOKENS
from ...sources.shared import cut_lineage, spread, stored
from ..cuts import heaviest
from .lattice import Lattice, chunks, expected_uses
from .model import TokenModel, line_counts

MIN_VOCAB = 44  # fixed value: smallest vocabulary, special tokens counted
# the library's values
MAX_PIECE_LENGTH = 16  # characters of a piece
SEED_SIZE = 1_000_000  # seed pieces of two or more characters that start the EM
MIN_COUNT = 2  # occurrences of a seed piece of two or more characters
KEEP = 0.75  # share of pieces that survive one pruning
EM_STEPS = 2
WINDOWS_AT_ONCE = 1 << 18  # windows of a long line counted together
PART_WINDOWS = 500_000  # sorted windows of a task


def _windows(lines: DataFrame, longest: int) -> DataFrame:
    """``window, n``: the ``longest`` characters from each one on (zeros behind the end of the line), counted.

    A window holds four bytes per character (its code point plus one), high byte first, so windows
    sort like their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, weights = batch.column("line").to_pylist(), batch.column("n").to_numpy()
            for i, text in enumerate(texts):
                codes = np.append(np.frombuffer(text.encode("utf-32-be"), ">u4") + 1, np.zeros(longest - 1)).astype(">u4")
                all_windows = np.lib.stride_tricks.sliding_window_view(codes, longest)
                for low in range(0, len(all_windows), WINDOWS_AT_ONCE):
                    part = np.ascontiguousarray(all_windows[low : low + WINDOWS_AT_ONCE]).view(f"V{4 * longest}").ravel()
                    found, counts = np.unique(part, return_counts=True)
                    column = pa.Array.from_buffers(pa.binary(4 * longest), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([column, pa.array(counts * weights[i])], ["window", "n"])

    return lines.select("line", "n").mapInArrow(run, "window binary, n long").groupBy("window").agg(F.sum("n").alias("n"))


def _repeated_prefixes(windows: DataFrame, longest: int, least: int) -> DataFrame:
    """Pieces with counts from sorted windows: runs of windows with a common prefix are the places of that prefix.

    Of the prefixes that lie inside a partition only those with ``least`` places and more than one
    continuation come out, besides single characters; prefixes at its edges come out with what the
    partition holds of them. A row without a piece counts the others (``rare, dominated``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        raw = b"".join(table.column("window").to_pylist())
        codes, n = np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, longest), table.column("n").to_numpy()
        same = np.cumprod(codes[1:] == codes[:-1], axis=1, dtype=np.int8).sum(1)
        common = np.append(0, same)  # characters shared with the window before
        rare = dominated = 0
        pieces, counts = [], []
        for d in range(1, longest + 1):
            starts = np.flatnonzero(common < d)
            total = np.add.reduceat(n, starts)
            ways = np.add.reduceat((common < d + 1).astype(np.int64), starts) if d < longest else np.full(len(starts), 2)
            whole = codes[starts, d - 1] != 0
            goes_on = codes[starts, d] != 0 if d < longest else np.zeros(len(starts), bool)
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            one_way = (ways == 1) & goes_on & (d > 1)
            few = (total < least) & (d > 1)
            out = whole & (edge | ~(one_way | few))
            rare += int((whole & ~edge & few).sum())
            dominated += int((whole & ~edge & ~few & one_way).sum())
            pieces += ["".join(map(chr, row)) for row in (codes[starts[out], :d] - 1).tolist()]
            counts += total[out].tolist()
        size = len(pieces)
        columns = [pa.array([*pieces, None], pa.string()), pa.array([*counts, 0], pa.int64())]
        columns += [pa.array([0] * size + [x], pa.int64()) for x in (rare, dominated)]
        for low in range(0, size + 1, 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(low, 1 << 16) for c in columns], ["piece", "n", "rare", "dominated"])

    parts = max(windows.sparkSession.sparkContext.defaultParallelism, -(-windows.count() // PART_WINDOWS))
    ordered = windows.repartitionByRange(parts, "window").sortWithinPartitions("window")
    return ordered.mapInArrow(run, "piece string, n long, rare long, dominated long")


def undominated(counts: DataFrame) -> DataFrame:
    """Pieces without those that a longer piece of the same count always contains; characters stay."""
    length = F.length("piece")
    inner = F.array(F.substring("piece", F.lit(1), length - 1), F.substring("piece", F.lit(2), length - 1))
    within = counts.where(length > 2).select(F.explode(inner).alias("piece"), F.lit(0).alias("n"), F.col("n").alias("above"))
    both = counts.select("piece", "n", F.lit(0).alias("above")).unionAll(within)
    found = both.groupBy("piece").agg(F.max("n").alias("n"), F.max("above").alias("above"))
    return found.where((F.col("n") > F.col("above")) | (length == 1)).select("piece", "n")


def seed_pieces(lines: DataFrame, longest: int, most: int, least: int) -> tuple[dict[str, int], dict[str, int]]:
    """Counts of the pieces that start the EM, and the numbers of those left out.

    Left out are ``rare`` pieces, ``dominated`` ones, and those ``beyond`` the heaviest ``most``.
    All characters are kept.
    """
    chars = F.length("piece") == 1
    found = stored(_repeated_prefixes(stored(_windows(lines, longest), "windows"), longest, least), "prefixes")
    inside = found.where("piece is null").agg(F.sum("rare").alias("rare"), F.sum("dominated").alias("dominated")).first()
    merged = stored(found.where("piece is not null").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    counts = merged.where((F.col("n") >= least) | chars)
    kept = stored(undominated(counts), "seeds")
    longer = kept.where(~chars)
    frequent, fit, many = counts.count(), kept.count(), longer.count()
    rare = merged.count() - frequent + (inside["rare"] or 0)
    if many > most:
        longer = heaviest(longer, F.col("n") * F.length("piece"), most, "piece")
    seeds = kept.where(chars).collect() + longer.collect()  # one row per character, and most
    left_out = {"rare": rare, "dominated": frequent - fit + (inside["dominated"] or 0), "beyond": max(0, many - most)}
    return {r["piece"]: r["n"] for r in seeds}, left_out


def expected_uses_of(lines: DataFrame, lattice: Broadcast, score: np.ndarray) -> np.ndarray:
    """Expected uses of each piece of a shared lattice under some scores, summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice.value.scored(score)
        total = np.zeros(len(own.pieces))
        for batch in batches:
            texts = batch.column("line").to_pylist()
            weights = batch.column("n").to_numpy().astype(float)
            for group in chunks(texts):
                total += expected_uses(own, [texts[i] for i in group], weights[group])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "expected"])

    rows = lines.select("line", "n").mapInArrow(run, "piece long, expected double")
    out = np.zeros(len(score))
    made = rows.groupBy("piece").agg(F.sum("expected").alias("expected")).toArrow()  # at most one row per live piece
    out[made.column("piece").to_numpy()] = made.column("expected").to_numpy()
    return out


def expected_counts(lines: DataFrame, logp: dict[str, float]) -> dict[str, float]:
    """Expected uses of each piece over the corpus."""
    lattice = Lattice(logp)
    shared = lines.sparkSession.sparkContext.broadcast(lattice)
    uses = expected_uses_of(lines, shared, lattice.score)
    shared.unpersist()
    return dict(zip(lattice.pieces, uses.tolist()))


def train_unigram(
    items: DataFrame,
    vocab_size: int,
    specials: Sequence[str] = SPECIAL_TOKENS,
    col: str = "item",
    max_piece_length: int = MAX_PIECE_LENGTH,
    seed_size: int = SEED_SIZE,
    min_count: int = MIN_COUNT,
) -> TokenModel:
    """Piece probabilities; single characters always stay, so every line can be split."""
    return train_unigrams(items, [vocab_size], specials, col, max_piece_length, seed_size, min_count)[vocab_size]


def train_unigrams(
    items: DataFrame,
    sizes: Sequence[int],
    specials: Sequence[str] = SPECIAL_TOKENS,
    col: str = "item",
    max_piece_length: int = MAX_PIECE_LENGTH,
    seed_size: int = SEED_SIZE,
    min_count: int = MIN_COUNT,
) -> dict[int, TokenModel]:
    """Models of several sizes. They share all rounds until the pruning passes a size.

    Candidates are all substrings of up to ``max_piece_length`` characters that occur at least
    ``min_count`` times, except those that a longer one of the same count contains; the heaviest
    ``seed_size`` of them start. ``left_out`` of each model tells how many did not.
    """
    lines = cut_lineage(spread(cut_lineage(line_counts(items, col))))
    seeds, left_out = seed_pieces(lines, max_piece_length, seed_size, min_count)
    score = {p: float(n * len(p)) for p, n in seeds.items() if p not in specials}
    required = {p for p in score if len(p) == 1}
    fallback = {p: 1e-6 for p in specials if len(p) == 1}  # specials may occur as characters
    goals = {max(MIN_VOCAB, size + len(specials)) - len(specials) for size in sizes}

    def settled(score: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
        # one trie per pruning; a step sends its scores only
        lattice = Lattice(_normalise(score | fallback))
        shared = lines.sparkSession.sparkContext.broadcast(lattice)
        live = np.array([p in score for p in lattice.pieces])
        base = np.array([fallback.get(p, 0.0) for p in lattice.pieces])
        logp = lattice.score
        for _ in range(EM_STEPS):
            weight = np.where(live, np.maximum(expected_uses_of(lines, shared, logp), 1e-6), base)
            logp = np.log(weight) - math.log(math.fsum(weight))
        shared.unpersist()
        kept = {p: float(w) for p, w, own in zip(lattice.pieces, weight, live) if own}
        return kept, dict(zip(lattice.pieces, logp.tolist()))

    def pruned(score: dict[str, float], size: int) -> dict[str, float]:
        order = sorted(score, key=lambda p: (p not in required, -score[p], p))
        return {p: score[p] for p in order[:size]}

    done: dict[int, tuple[dict[str, float], dict[str, float]]] = {}
    state = settled(score)
    while True:
        score = state[0]
        done |= {g: state for g in goals if g not in done and len(score) <= max(g, len(required))}
        open_goals = [g for g in goals if g not in done]
        if not open_goals:
            break
        natural = max(len(required), int(len(score) * KEEP))
        for goal in open_goals:
            if goal > natural and goal != min(open_goals):
                done[goal] = settled(pruned(score, goal))
        state = settled(pruned(score, max(natural, min(open_goals))))

    models = {}
    for size in sizes:
        score, logp = done[max(MIN_VOCAB, size + len(specials)) - len(specials)]
        ranked = sorted(score, key=lambda p: (-score[p], p))
        models[size] = TokenModel(
            "UNIGRAM",
            (*specials, *ranked),
            logp={p: logp[p] for p in ranked},
            specials=tuple(specials),
            left_out=left_out,
        )
    return models


def _normalise(score: dict[str, float]) -> dict[str, float]:
    total = math.log(sum(score.values()))
    return {p: math.log(s) - total for p, s in score.items()}
