"""Scalar text functions: cleaning, header test, identity and similarity keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: special tokens of the token models
BOS, EOS, PAD, UNK, ADD = "^", "_", " ", "§", "°"
SPECIAL_TOKENS = (BOS, EOS, PAD, UNK, ADD)
DELETED_PREFIX = "§§§_"

# fixed values: words a header line of an item file starts with
HEADER_WORDS = ("SMILES", "REACTION", "SMARTS", "SMIRKS", "SELFIES", "MOL")
HEADER_PATTERN = "^(" + "|".join(HEADER_WORDS) + ")"

CRITERIA = ("atom_mapping", "canonical")


def clean_generated(text: Column, prompt: str = BOS, pad: str = PAD, eos: str = EOS) -> Column:
    """Drop every occurrence of the prompt, the padding and the end token."""
    for mark in (prompt, pad, eos):
        if mark:
            text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def enclose(text: Column, bos: str = BOS, eos: str = EOS) -> Column:
    return F.concat(F.lit(bos), text, F.lit(eos))


def is_header(first_line: Column) -> Column:
    return F.upper(first_line).rlike(HEADER_PATTERN)


def strip_atom_mapping(template: Column) -> Column:
    return F.regexp_replace(template, r":\d+", "")


def template_key(
    template: Column, part_fn: Callable[[Column], Column] | None = None
) -> Column:
    """Mapping-free template with sorted parts; null when a part is empty or has no form.

    ``part_fn`` turns one part into its canonical form (null = no form).
    """
    fn = part_fn or (lambda part: part)
    sides = F.transform(
        F.split(strip_atom_mapping(template), ">>", -1),
        lambda side: F.array_sort(F.transform(F.split(side, r"\.", -1), fn)),
    )
    broken = F.exists(
        sides, lambda parts: F.exists(parts, lambda p: F.coalesce(p == "", F.lit(True)))
    )
    joined = F.array_join(F.transform(sides, lambda parts: F.array_join(parts, ".")), ">>")
    return F.when(~broken, joined)


def similarity_key(template: Column, criterion: str = "atom_mapping") -> Column:
    criterion = criterion.lower()
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}, not {criterion!r}")
    return strip_atom_mapping(template) if criterion == "atom_mapping" else template_key(template)


def similar(a: Column, b: Column, criterion: str = "atom_mapping") -> Column:
    """Equality of similarity keys; two templates without a form count as similar."""
    return similarity_key(a, criterion).eqNullSafe(similarity_key(b, criterion))


def identity_key(raw: Column, canonical: Column) -> Column:
    return F.coalesce(canonical, raw)


def digest(value: Column) -> Column:
    """32 bytes that stand for a text of any length in shuffles and joins; null stays null."""
    return F.unhex(F.sha2(value, 256))


def trimmed(text: Column) -> Column:
    """Default canonical form of an item: trimmed, null when nothing is left."""
    form = F.trim(text)
    return F.when(form != "", form)
