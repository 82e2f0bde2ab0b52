"""Training every sensible combination of pre-tokenizer, algorithm and size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ...functions.text import SPECIAL_TOKENS
from ..vocab import MAX_WORDLEVEL, train_wordlevel
from .bpe import shrink, train_bpe, train_wordpiece
from .model import ALGORITHMS, TokenModel, wordlevel_model
from .unigram import MAX_PIECE_LENGTH, SEED_SIZE, train_unigram, train_unigrams

# fixed values: the grid
KINDS = ("CHAR", "ATOM", "SMARTS")
SIZES = (0, 44, 88, 176)


def check_combination(kind: str, algorithm: str, vocab_size: int) -> None:
    kind, algorithm = kind.upper(), algorithm.upper()
    if kind not in KINDS or algorithm not in ALGORITHMS:
        raise ValueError(f"unknown combination {kind} / {algorithm}")
    if kind != "CHAR" and algorithm != "WORDLEVEL":
        raise ValueError(f"{kind} pieces need the WORDLEVEL algorithm")
    if (algorithm == "WORDLEVEL") != (vocab_size == 0):
        raise ValueError("WORDLEVEL takes size 0, all other algorithms a size above 0")


def combinations() -> list[tuple[str, str, int]]:
    """The valid cells of the grid."""
    cells = []
    for kind in KINDS:
        for algorithm in ALGORITHMS:
            for size in SIZES:
                try:
                    check_combination(kind, algorithm, size)
                except ValueError:
                    continue
                cells.append((kind, algorithm, size))
    return cells


def train_tokenizer(
    items: DataFrame,
    kind: str = "CHAR",
    algorithm: str = "WORDLEVEL",
    vocab_size: int = 0,
    min_frequency: int = 1,
    specials: Sequence[str] = SPECIAL_TOKENS,
    pattern: str | None = None,
    col: str = "item",
    wordlevel_limit: int = MAX_WORDLEVEL,
    max_piece_length: int = MAX_PIECE_LENGTH,
    seed_size: int = SEED_SIZE,
) -> TokenModel:
    """One model; a word-level vocabulary takes all pieces up to ``wordlevel_limit`` tokens."""
    check_combination(kind, algorithm, max(0, vocab_size))
    algorithm, min_frequency = algorithm.upper(), max(1, min_frequency)
    if algorithm == "WORDLEVEL":
        return wordlevel_model(train_wordlevel(items, kind, pattern, col, specials, wordlevel_limit), tuple(specials))
    if algorithm == "BPE":
        return train_bpe(items, vocab_size, min_frequency, specials, col)
    if algorithm == "WORDPIECE":
        return train_wordpiece(items, vocab_size, min_frequency, specials, col)
    return train_unigram(items, vocab_size, specials, col, max_piece_length, seed_size)


def tokenizer_grid(
    items: DataFrame,
    cells: Sequence[tuple[str, str, int]] | None = None,
    specials: Sequence[str] = SPECIAL_TOKENS,
    col: str = "item",
    max_piece_length: int = MAX_PIECE_LENGTH,
    seed_size: int = SEED_SIZE,
) -> dict[tuple[str, str, int], TokenModel]:
    """One model per cell of the grid.

    The merges of a small BPE or WordPiece vocabulary are the first merges of a larger one, so
    each of these algorithms is trained once, at its largest size, and cut. Unigram sizes share
    their rounds as far as they are the same.
    """
    cells = list(cells or combinations())
    models: dict[tuple[str, str, int], TokenModel] = {}
    unigrams = [c for c in cells if c[1] == "UNIGRAM"]
    if unigrams:
        trained = train_unigrams(items, [c[2] for c in unigrams], specials, col, max_piece_length, seed_size)
        models |= {c: trained[c[2]] for c in unigrams}
    for cell in sorted(cells, key=lambda c: -c[2]):
        kind, algorithm, size = cell
        larger = [c for c in models if c[1] == algorithm and algorithm in ("BPE", "WORDPIECE")]
        if larger:
            models[cell] = shrink(models[larger[0]], size)
        elif cell not in models:
            models[cell] = train_tokenizer(items, kind, algorithm, size, specials=specials, col=col)
    return {cell: models[cell] for cell in cells}
