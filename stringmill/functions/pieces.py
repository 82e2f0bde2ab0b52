"""Pre-tokenizers: how one string falls into pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: alternatives of the structure pattern; their order decides what matches
BRACKET = r"\[[^\]]+]"
BRACKET_SIGNS = r"\[|\]"
STRUCTURE_PARTS = (
    r"A[cglmrstu]?",
    r"B[aeihkr]?",
    r"C[adeflmorsu]?",
    r"D[bsy]?",
    r"E[rsu]?",
    r"F[emr]?",
    r"G[ade]?",
    r"H[efgos]?",
    r"I[nr]?",
    r"K[r]?",
    r"L[aru]?",
    r"M[dgnot]?",
    r"N[abdeiop]?",
    r"Os?",
    r"P[abdmortu]?",
    r"R[aefghnu]?",
    r"S[bcdegimnr]?",
    r"T[abcehilm]?",
    r"U",
    r"V",
    r"W",
    r"Xe",
    r"Yb?",
    r"Z[nr]?",
    r"as|b|c|n|o|p|se?",
    r"\(|\)",
    r"@@?",
    r"\+\d+|\++|-\d+|-+",
    r"\.|-|=|#\d{1}|\$\(?|:[0-9]*|~|@|\/\??|\\\??",
    r"\%[0-9]{2}",
    r"[0-9]",
    r"\*|>>?|D\d{1}|H\d{1}|h\d{1}|R\d{1}|r\d{1}|v\d{1}|X\d{1}|x\d{1}|#\d{1}",
    r"!|&|,|;",
)

PATTERNS = {
    "CHAR": "",
    "ATOM": "|".join((BRACKET_SIGNS, *STRUCTURE_PARTS)),
    "SMARTS": "|".join((BRACKET, *STRUCTURE_PARTS)),
}

# A noncharacter: it cannot occur in exchanged text, so it is safe as a cut mark.
_CUT = "￿"


def pretokenize(text: Column, kind: str = "CHAR", pattern: str | None = None) -> Column:
    """Pieces of a string: matches of the pattern and the runs between them, in order.

    ``kind`` is CHAR, ATOM or SMARTS; ``pattern`` replaces the built-in expression.
    """
    if pattern is None:
        if kind.upper() not in PATTERNS:
            raise ValueError(f"kind must be one of {tuple(PATTERNS)}, not {kind!r}")
        pattern = PATTERNS[kind.upper()]
    if pattern == "":
        # one piece per code point; only the empty string would yield an empty piece
        none = F.array().cast("array<string>")
        return F.when(text == "", none).otherwise(F.split(text, ""))
    cut = F.split(F.regexp_replace(text, f"({pattern})", f"{_CUT}$1{_CUT}"), _CUT)
    return F.filter(cut, lambda piece: piece != "")


def lexical_check(text: Column) -> Column:
    """Shape test of a structure string. It says nothing about chemistry.

    True when parentheses and brackets are balanced, ring labels outside brackets come in
    pairs, no part is empty and every piece is known to the pattern.
    """
    outside = F.regexp_replace(text, BRACKET, "")
    depth = F.aggregate(
        F.regexp_extract_all(outside, F.lit(r"[()]"), F.lit(0)),
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda s, c: F.struct(
            (s["d"] + F.when(c == "(", 1).otherwise(-1)).alias("d"),
            (s["ok"] & ((c == "(") | (s["d"] > 0))).alias("ok"),
        ),
    )
    rings = F.regexp_extract_all(outside, F.lit(r"%[0-9]{2}|[0-9]"), F.lit(0))
    open_ring = F.exists(
        F.array_distinct(rings), lambda r: F.size(F.filter(rings, lambda x: x == r)) % 2 == 1
    )
    empty_part = F.exists(F.split(text, r">>|\.", -1), lambda p: p == "")
    unknown = F.regexp_replace(text, PATTERNS["SMARTS"], "") != ""
    return (
        ~outside.rlike(r"[\[\]]")
        & (depth["d"] == 0)
        & depth["ok"]
        & ~open_ring
        & ~empty_part
        & ~unknown
    )
