"""From a folder of splits to a tokenized dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPECIAL_TOKENS, enclose
from ..operators.cuts import random_split
from ..operators.tokenizers.encode import encode, raw_ids
from ..operators.tokenizers.grid import train_tokenizer
from ..operators.tokenizers.model import TokenModel, wordlevel_model
from ..operators.vocab import map_vocab_linear, remap_vocab, zero_fill

MAP_START = 256  # fixed value: ids below stand for single bytes
MAP_ROOM = 0.9  # fixed value: share of the free ids over which the counts are spread


def with_splits(
    df: DataFrame, val_percent: float = 10, test_percent: float = 10, seed: int = 42
) -> DataFrame:
    """The given splits, or an exact random one when there is no validation part.

    A test part that exists without a validation part is replaced, as the random split makes
    its own from the training rows.
    """
    names = {r["split"] for r in df.select("split").distinct().collect()}
    if "validation" in names:
        return df
    if "train" not in names:
        raise ValueError("there is no training split")
    train = df.where(F.col("split") == "train").drop("split")
    return random_split(train, val_percent, test_percent, seed)


def mapped_model(
    model: TokenModel,
    train: DataFrame,
    into: DataFrame,
    kind: str = "CHAR",
    pattern: str | None = None,
    start: int = MAP_START,
    room: float = MAP_ROOM,
    col: str = "item",
) -> TokenModel:
    """The model with its tokens put at ids of another vocabulary ``(token, id)`` by their frequency.

    Frequent tokens of the training rows go to small ids from ``start`` on; begin and end token count
    once per row, tokens that never occur go behind. Entries of the other vocabulary at those ids go,
    and the merges stay. Marks that the other vocabulary lacks are replaced by the end token.
    """
    bos, eos = model.specials[:2]
    spark = train.sparkSession
    used = train.select(F.explode(raw_ids(F.col(col), model, kind, pattern)).alias("id")).groupBy("id").count()
    names = model.vocab(spark)  # at most MAX_MODEL rows
    counts = used.join(names, "id").select("token", "count").where(~F.col("token").isin(bos, eos))
    filled = zero_fill(names.where(~F.col("token").isin(*model.specials)), counts)
    marks = train.agg(F.count("*").alias("count")).select(F.explode(F.array(F.lit(bos), F.lit(eos))).alias("token"), "count")
    frequencies = filled.unionByName(counts.where(F.col("token").isin(*model.specials))).unionByName(marks)
    size, taken = into.agg(F.count("*"), F.count_if(F.col("token").isin(*model.specials))).first()
    never = filled.where(F.col("count") == 0).count()
    end = int(round((size - taken - never - 2) * room, 0))
    vocab = remap_vocab(into, map_vocab_linear(frequencies, size, start, end))
    tokens = wordlevel_model(vocab).tokens
    return replace(model, tokens=tokens, specials=tuple(t if t in set(tokens) else eos for t in model.specials))


def build_tokenized_dataset(
    df: DataFrame,
    kind: str = "CHAR",
    algorithm: str = "WORDLEVEL",
    vocab_size: int = 0,
    min_frequency: int = 1,
    max_length: int | None = None,
    pad_to: str | int | None = None,
    multiple: int = 8,
    val_percent: float = 10,
    test_percent: float = 10,
    seed: int = 42,
    enclosed: tuple[str, str] | None = None,
    specials: Sequence[str] = SPECIAL_TOKENS,
    pattern: str | None = None,
    into: DataFrame | None = None,
    cut_into: str | None = None,
) -> tuple[DataFrame, TokenModel]:
    """Splits ``(split, ord, item)`` where needed, trains on the train part, encodes everything.

    ``enclosed`` puts a begin and an end text around every item first, for models whose own
    marks are not used. ``specials`` and ``pattern`` are the marks and the piece pattern of the
    tokenizer, ``into`` is a vocabulary ``(token, id)`` into which its tokens are mapped. Ids are
    whole unless ``max_length`` is given; ``cut_into`` names a column for the tokens a row lost.
    """
    rows = with_splits(df, val_percent, test_percent, seed)
    if enclosed:
        rows = rows.withColumn("item", enclose(F.col("item"), *enclosed))
    train = rows.where(F.col("split") == "train")
    model = train_tokenizer(train, kind, algorithm, vocab_size, min_frequency, specials, pattern)
    if into is not None:
        model = mapped_model(model, train, into, kind, pattern)
    encoded = encode(
        rows, model, kind, pattern, max_length=max_length, pad_to=pad_to, multiple=multiple, cut_into=cut_into
    )
    return encoded, model
