"""Vocabularies: counting pieces, ranking them, mapping them onto another vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pieces import pretokenize
from ..functions.text import BOS, DELETED_PREFIX, EOS, SPECIAL_TOKENS
from ..sources.shared import cut_lineage, stored
from .cuts import heaviest

MAX_WORDLEVEL = 30_000  # fixed value: size limit of a word-level vocabulary


def piece_counts(
    items: DataFrame, kind: str = "CHAR", pattern: str | None = None, col: str = "item"
) -> DataFrame:
    """Occurrences of each piece over the corpus: ``(token, count)``."""
    pieces = items.select(F.explode(pretokenize(F.col(col), kind, pattern)).alias("token"))
    return pieces.groupBy("token").count()


def token_frequencies(
    items: DataFrame,
    kind: str = "CHAR",
    pattern: str | None = None,
    col: str = "item",
    bos: str = BOS,
    eos: str = EOS,
) -> DataFrame:
    """Token counts plus one begin and one end token per item."""
    marks = items.select(
        F.explode(F.array(F.lit(bos), F.lit(eos))).alias("token"), F.lit(1).alias("one")
    )
    pieces = items.select(
        F.explode(pretokenize(F.col(col), kind, pattern)).alias("token"), F.lit(1).alias("one")
    ).where(~F.col("token").isin(bos, eos))
    return pieces.union(marks).groupBy("token").agg(F.sum("one").alias("count"))


def zero_fill(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts for every vocabulary token, 0 where it never occurs."""
    return vocab.select("token").join(counts, "token", "left").fillna(0, ["count"])


def top_frequent(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.col("count").desc(), "token").limit(k)


def vocab_rank(
    counts: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS, limit: int = MAX_WORDLEVEL
) -> DataFrame:
    """Ids of a word-level vocabulary: specials, then count descending, token ascending.

    Only the top ``limit`` tokens are numbered.
    """
    room = limit - len(specials)
    plain = stored(counts.where(~F.col("token").isin(*specials)), "counts")
    words = heaviest(plain, F.col("count"), room, "token")
    rank = F.row_number().over(W.orderBy(F.col("count").desc(), "token"))
    ranked = words.select("token", (rank + len(specials) - 1).cast("int").alias("id"))
    fixed = counts.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(specials)], "token string, id int"
    )
    return fixed.unionByName(ranked)


def train_wordlevel(
    items: DataFrame,
    kind: str = "CHAR",
    pattern: str | None = None,
    col: str = "item",
    specials: Sequence[str] = SPECIAL_TOKENS,
    limit: int = MAX_WORDLEVEL,
) -> DataFrame:
    """Word-level vocabulary of a corpus: its ``limit`` most frequent tokens, marks included."""
    return vocab_rank(piece_counts(items, kind, pattern, col), specials, limit)


def vocab_size_report(vocab: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    special = F.col("token").isin(*specials)
    return vocab.agg(
        F.count("*").alias("with_specials"), F.count_if(~special).alias("without_specials")
    )


def map_vocab_linear(freq: DataFrame, vocab_size: int, start: int, end: int | None = None) -> DataFrame:
    """New ids for tokens by frequency: ``(token, count, new_id)``.

    A count maps linearly onto ``[start, end)``, the largest one to ``start``; a taken id moves
    the token to the next free one. In count order that is a running maximum: the id of row i
    is ``i + max(candidate_j - j)`` over all rows up to i. Counts may number ``MAX_WORDLEVEL``.
    """
    end = vocab_size if end is None else int(end)
    freq = cut_lineage(freq)  # one row per token, read several times
    top, tokens = freq.agg(F.max("count"), F.count("*")).first()
    if start < 0:
        raise ValueError("start must not be negative")
    if tokens > vocab_size:
        raise ValueError("there are more tokens than ids")
    if not start + tokens < end < vocab_size:
        raise ValueError("end must lie between start plus the number of tokens and the vocabulary size")
    slope = (end - start) / top
    order = W.orderBy(F.col("count").desc(), "token")
    candidate = F.greatest(
        (F.lit(-slope) * F.col("count") + F.lit(end)).cast("long"), F.lit(start)
    )
    rows = freq.withColumn("rn", F.row_number().over(order)).withColumn("cand", candidate)
    shift = F.max(F.col("cand") - F.col("rn")).over(
        W.orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    )
    new_id = F.col("rn") + shift
    checked = F.when(
        new_id >= vocab_size, F.raise_error(F.lit("the tokens do not fit")).cast("long")
    ).otherwise(new_id)
    return rows.select("token", "count", checked.cast("int").alias("new_id"))


def remap_vocab(vocab: DataFrame, mapped: DataFrame, prefix: str = DELETED_PREFIX) -> DataFrame:
    """A vocabulary with new tokens put at given ids; still contiguous, ordered by id.

    Old entries of mapped tokens and old tokens at taken ids go; an id freed that way and not
    taken again is filled with a placeholder.
    """
    vocab, mapped = cut_lineage(vocab), cut_lineage(mapped)  # small, read several times
    new = mapped.select("token", F.col("new_id").alias("id"))
    kept = vocab.join(new.select("token"), "token", "left_anti").join(
        new.select("id"), "id", "left_anti"
    )
    freed = vocab.join(new.select("token"), "token", "left_semi").join(
        new.select("id"), "id", "left_anti"
    )
    fill = freed.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("token"), "id")
    return kept.select("token", "id").unionByName(new).unionByName(fill).orderBy("id")
