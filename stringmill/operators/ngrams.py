"""n-gram counts as a scorer: next-token prediction, loss, accuracy, perplexity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import perplexity
from .skew import small_or_lookup_join

_JOINER = "␟"  # between the tokens of a context


def grams(df: DataFrame, n: int = 2, tokens: str = "tokens", keep: Sequence[str] = ()) -> DataFrame:
    """One row ``(context, token)`` per n-gram occurrence with the columns named in ``keep``."""
    if n < 2:
        raise ValueError("n must be at least 2")
    length = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = [F.slice(tokens, k + 1, length).alias(f"t{k}") for k in range(n)]
    rows = df.select(*keep, F.inline(F.arrays_zip(*shifted)))
    context = [F.col(f"t{k}") for k in range(n - 1)]
    joined = context[0] if n == 2 else F.concat_ws(_JOINER, *context)
    return rows.select(*keep, joined.alias("context"), F.col(f"t{n - 1}").alias("token"))


def ngram_counts(df: DataFrame, n: int = 2, tokens: str = "tokens") -> DataFrame:
    """``(context, token, count)`` over the corpus."""
    return grams(df, n, tokens).groupBy("context", "token").count()


def predict_next(counts: DataFrame) -> DataFrame:
    """Most frequent successor per context; ties go to the smaller token."""
    best = F.min(F.struct((-F.col("count")).alias("c"), "token"))["token"]
    return counts.groupBy("context").agg(best.alias("prediction"))


def scored_grams(used: DataFrame, counts: DataFrame, vocab_size: int) -> DataFrame:
    """Adds ``nll`` (add-one smoothing) and ``hit`` to counted n-grams ``(..., context, token, n)``.

    ``used`` is aggregated before the joins, so a frequent n-gram is one row per group and not
    one row per occurrence. Both tables of the model join without a shuffle while they are
    small. ``counts`` is read several times, so it should be a stored or checkpointed table.
    """
    contexts = counts.groupBy("context").agg(
        F.sum("count").alias("total"),
        F.min(F.struct((-F.col("count")).alias("c"), "token"))["token"].alias("best"),
    )
    spread = [c for c in used.columns if c != "n"]
    rows = small_or_lookup_join(used, contexts, "context", spread_by=spread)
    rows = small_or_lookup_join(rows, counts, ["context", "token"], spread_by=spread)
    p = (F.coalesce("count", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + vocab_size)
    return rows.select(
        *used.columns,
        (-F.log(p)).alias("nll"),
        F.coalesce(F.col("best") == F.col("token"), F.lit(False)).alias("hit"),
    )


def score_sequences(
    df: DataFrame, counts: DataFrame, vocab_size: int, n: int = 2, tokens: str = "tokens", by: str = "ord"
) -> DataFrame:
    """Per item ``n_tokens``, mean ``loss`` and ``accuracy``; items shorter than n are absent."""
    used = (
        grams(df, n, tokens, [by]).groupBy(by, "context", "token").agg(F.count("*").alias("n"))
    )
    return _mean(scored_grams(used, counts, vocab_size), by)


def split_report(
    df: DataFrame, counts: DataFrame, vocab_size: int, n: int = 2, tokens: str = "tokens", by: str = "split"
) -> DataFrame:
    """Loss, accuracy and perplexity per split."""
    used = (
        grams(df, n, tokens, [by]).groupBy(by, "context", "token").agg(F.count("*").alias("n"))
    )
    return _mean(scored_grams(used, counts, vocab_size), by).withColumn(
        "perplexity", perplexity(F.col("loss"))
    )


def _mean(rows: DataFrame, by: str) -> DataFrame:
    weight = F.sum("n")
    return rows.groupBy(by).agg(
        weight.alias("n_tokens"),
        (F.sum(F.col("nll") * F.col("n")) / weight).alias("loss"),
        (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / weight).alias("accuracy"),
    )


def next_token_accuracy(
    df: DataFrame, predictions: str = "predictions", labels: str = "labels"
) -> DataFrame:
    """Share of positions where the prediction for a position equals the next label."""
    hits = F.zip_with(
        F.slice(F.col(predictions), 1, F.greatest(F.size(predictions) - 1, F.lit(0))),
        F.slice(F.col(labels), 2, F.greatest(F.size(labels) - 1, F.lit(0))),
        lambda p, t: F.when(p == t, 1).otherwise(0),
    )
    # summed inside the row: no row per token leaves the task
    per_row = df.select(
        F.aggregate(hits, F.lit(0), lambda a, x: a + x).cast("long").alias("h"),
        F.size(hits).cast("long").alias("n"),
    )
    return per_row.agg(
        F.sum("n").alias("n_tokens"), (F.sum("h") / F.sum("n")).alias("accuracy")
    )
