"""Ordered counters and their fractions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: counters of the two kinds of samples, in hierarchy order
ITEM_COUNTERS = ("generated", "valid", "unique", "novel")
TEMPLATE_COUNTERS = (
    "generated",
    "valid",
    "unique",
    "feasible",
    "known",
    "known_from_valid_set",
    "known_from_test_set",
)


def tally(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """Counts rows per predicate in one pass: ``(idx, counter, count)`` plus both fractions.

    The order of the predicates is the hierarchy: fractions are taken of the first counter
    (absolute) and of the one before (relative); of nothing they are NaN.
    """
    if not counters:
        raise ValueError("at least one counter is needed")
    names = list(counters)
    row = df.agg(*[F.count_if(counters[c]).alias(f"c{i}") for i, c in enumerate(names)])
    return fractions(row, names)


def fractions(row: DataFrame, names: list[str]) -> DataFrame:
    """Long form of a one-row frame of counts ``c0, c1, ...``."""

    def share(i: int, base: int) -> Column:
        whole = F.col(f"c{base}")
        return F.when(whole == 0, F.lit(float("nan"))).otherwise(F.col(f"c{i}") / whole)

    lines = [
        F.struct(
            F.lit(i).alias("idx"),
            F.lit(name).alias("counter"),
            F.col(f"c{i}").cast("long").alias("count"),
            share(i, 0).alias("absolute_fraction"),
            share(i, max(i - 1, 0)).alias("relative_fraction"),
        )
        for i, name in enumerate(names)
    ]
    return row.select(F.inline(F.array(*lines)))
