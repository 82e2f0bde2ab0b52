"""The trained model: small by construction, so it travels with the tasks that use it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import schemas
from ...functions.pieces import PATTERNS
from ...functions.text import SPECIAL_TOKENS

ALGORITHMS = ("WORDLEVEL", "BPE", "WORDPIECE", "UNIGRAM")
PREFIX = "##"  # fixed value: mark of a WordPiece token inside a word
MAX_WORD = 1024  # fixed value: length limit of a WordPiece line where a model names none
MAX_MODEL = 1_000_000  # tokens a driver-held model may have


@dataclass(frozen=True)
class TokenModel:
    """Tokens in id order; merges in rank order (BPE); log-probabilities by token (Unigram)."""

    algorithm: str
    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...] = ()
    logp: dict[str, float] = field(default_factory=dict)
    specials: tuple[str, ...] = SPECIAL_TOKENS
    max_word: int = MAX_WORD  # WordPiece: a longer line is one unknown token
    left_out: dict[str, int] = field(default_factory=dict, compare=False)  # Unigram: candidates that did not start
    reads: tuple[tuple[int, int, int], ...] = field(default=(), compare=False)  # BPE: merges, parts with them, all parts

    @property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @property
    def bos_id(self) -> int:
        return self.ids[self.specials[0]]

    @property
    def eos_id(self) -> int:
        return self.ids[self.specials[1]]

    @property
    def pad_id(self) -> int:
        return self.ids[self.specials[2]]

    @property
    def unk_id(self) -> int:
        return self.ids[self.specials[3]]

    def vocab(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(t, i) for i, t in enumerate(self.tokens)], schemas.VOCAB
        )

    def merges_table(self, spark: SparkSession) -> DataFrame:
        """The ordered merge list as ``(rank, left, right)``."""
        return spark.createDataFrame(
            [(i, a, b) for i, (a, b) in enumerate(self.merges)], schemas.MERGES
        )

    def unigram_table(self, spark: SparkSession) -> DataFrame:
        ids = self.ids
        return spark.createDataFrame(
            [(p, float(s), ids[p]) for p, s in self.logp.items()], schemas.UNIGRAM
        )


def to_tokenizer_json(
    model: TokenModel, kind: str = "CHAR", pattern: str | None = None
) -> str:
    """The model as a ``tokenizer.json`` text, the exchange format of tokenizer libraries (its keys are fixed values)."""
    ids = model.ids
    bos, eos = model.specials[0], model.specials[1]
    added = [
        {
            "id": ids[t],
            "content": t,
            "single_word": False,
            "lstrip": False,
            "rstrip": False,
            "normalized": False,
            "special": True,
        }
        for t in model.specials
    ]
    regex = PATTERNS[kind.upper()] if pattern is None else pattern
    split = {
        "type": "Split",
        "pattern": {"Regex": regex},
        "behavior": "Isolated",
        "invert": False,
    }
    post = {
        "type": "TemplateProcessing",
        "single": [
            {"SpecialToken": {"id": bos, "type_id": 0}},
            {"Sequence": {"id": "A", "type_id": 0}},
            {"SpecialToken": {"id": eos, "type_id": 0}},
        ],
        "pair": [{"Sequence": {"id": "A", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 1}}],
        "special_tokens": {t: {"id": t, "ids": [ids[t]], "tokens": [t]} for t in (bos, eos)},
    }
    unk = model.specials[3]
    core: dict[str, object] = {"type": "WordLevel", "vocab": ids, "unk_token": unk}
    decoder = None
    if model.algorithm == "BPE":
        core = {"type": "BPE", "unk_token": unk, "vocab": ids, "merges": [list(m) for m in model.merges]}
    elif model.algorithm == "WORDPIECE":
        core = {
            "type": "WordPiece",
            "unk_token": unk,
            "continuing_subword_prefix": PREFIX,
            "max_input_chars_per_word": model.max_word,
            "vocab": ids,
        }
        decoder = {"type": "WordPiece", "prefix": PREFIX, "cleanup": False}
    elif model.algorithm == "UNIGRAM":
        core = {
            "type": "Unigram",
            "unk_id": model.unk_id,
            "vocab": [[t, model.logp.get(t, 0.0)] for t in model.tokens],
            "byte_fallback": False,
        }
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": added,
            "normalizer": None,
            "pre_tokenizer": split if model.algorithm == "WORDLEVEL" else None,
            "post_processor": post,
            "decoder": decoder,
            "model": core,
        },
        ensure_ascii=False,
    )


def from_tokenizer_json(text: str) -> TokenModel:
    """A model stored as ``tokenizer.json``."""
    data = json.loads(text)
    core, specials = data["model"], tuple(t["content"] for t in data["added_tokens"])
    algorithm = core["type"].upper()
    if algorithm == "UNIGRAM":
        scores = {t: p for t, p in core["vocab"] if t not in specials}
        return TokenModel(algorithm, tuple(t for t, _ in core["vocab"]), logp=scores, specials=specials)
    tokens = tuple(sorted(core["vocab"], key=core["vocab"].get))
    merges = [m.split(" ") if isinstance(m, str) else m for m in core.get("merges", [])]
    longest = core.get("max_input_chars_per_word", MAX_WORD)
    return TokenModel(algorithm, tokens, tuple((a, b) for a, b in merges), specials=specials, max_word=longest)


def wordlevel_model(vocab: DataFrame, specials: tuple[str, ...] = SPECIAL_TOKENS) -> TokenModel:
    """A word-level vocabulary table as a model, after a check of its size."""
    rows = vocab.select("id", "token").orderBy("id").limit(MAX_MODEL + 1).collect()
    if len(rows) > MAX_MODEL:
        raise ValueError(f"more than {MAX_MODEL} tokens: use encode_wordlevel_join")
    if [r["id"] for r in rows] != list(range(len(rows))):
        raise ValueError("ids must be contiguous from 0")
    return TokenModel("WORDLEVEL", tuple(r["token"] for r in rows), specials=tuple(specials))


def model_vocab_size(model: TokenModel) -> tuple[int, int]:
    """(with, without) special tokens."""
    return len(model.tokens), len(set(model.tokens) - set(model.specials))


def line_counts(items: DataFrame, col: str = "item") -> DataFrame:
    """Distinct lines with their number of occurrences: what every trainer works on."""
    return items.where(F.length(col) > 0).groupBy(F.col(col).alias("line")).agg(
        F.count("*").alias("n")
    )
