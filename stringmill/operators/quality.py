"""Set metrics of a generated sample against a reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest


def basic_stats(gen: DataFrame, ref: DataFrame, canonical: str = "canonical", ref_key: str = "item") -> DataFrame:
    """One row ``Validity, Uniqueness, Novelty``; shares of nothing are 0.0.

    The reference side is compared as it is; canonicalise it first where that is wanted.
    """
    key = digest(F.col(canonical)).alias("key")
    sides = gen.select(key, F.lit(1).alias("g"), F.lit(False).alias("k"))
    sides = sides.union(ref.select(digest(F.col(ref_key)), F.lit(0), F.lit(True)))
    keys = sides.groupBy("key").agg(F.sum("g").alias("n"), F.max("k").alias("known"))
    has_form = F.col("key").isNotNull()
    distinct = has_form & (F.col("n") > 0)
    sizes = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"),
        F.coalesce(F.sum(F.when(has_form, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.count_if(distinct).alias("n_unique"),
        F.count_if(distinct & ~F.col("known")).alias("n_novel"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return sizes.select(
        share("n_valid", "n_all").alias("Validity"),
        share("n_unique", "n_valid").alias("Uniqueness"),
        share("n_novel", "n_unique").alias("Novelty"),
    )
