"""Repeats, set operations and leakage between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest
from .skew import lookup_join


def drop_duplicates(
    df: DataFrame, subset: Sequence[str] | str | None = None, order_by: str = "ord"
) -> DataFrame:
    """Keeps the first row of each group of equal rows.

    An aggregate instead of a window: it combines map-side, so a group of copies never meets
    in one task.
    """
    names = [c for c in df.columns if c != order_by]
    keys = names if subset is None else [subset] if isinstance(subset, str) else list(subset)
    rest = [c for c in names if c not in keys]
    first = F.min(F.struct(order_by, *[F.col(f"`{c}`") for c in rest])).alias("__first")
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(first)
        .select(
            *[
                F.col(f"`{c}`") if c in keys else F.col(f"__first.`{c}`").alias(c)
                for c in df.columns
            ]
        )
    )


def first_seen(
    df: DataFrame, key: str = "key", batch: str = "batch", order_by: str = "ord"
) -> DataFrame:
    """First row of each key over all batches, repeats inside a batch ignored."""
    rest = [c for c in df.columns if c not in (key, batch, order_by)]
    first = F.min(F.struct(batch, order_by, *rest)).alias("__first")
    return (
        df.groupBy(key)
        .agg(first)
        .select(*[F.col(key) if c == key else F.col(f"__first.{c}").alias(c) for c in df.columns])
    )


def key_profile(gen: DataFrame, known: DataFrame | None, key: str = "key") -> DataFrame:
    """One row ``(digest, n, is_known)`` per generated key. One shuffle, of digests only."""
    sides = gen.select(digest(F.col(key)).alias("digest"), F.lit(1).alias("g"), F.lit(False).alias("k"))
    if known is not None:
        sides = sides.union(known.select(digest(F.col(key)), F.lit(0), F.lit(True)))
    return (
        sides.groupBy("digest")
        .agg(F.sum("g").alias("n"), F.max("k").alias("is_known"))
        .where(F.col("n") > 0)
    )


def flag_singleton(df: DataFrame, key: str = "key", spread_by: str = "ord") -> DataFrame:
    """Adds ``unique``: the key occurs exactly once in the whole output."""
    rows = df.withColumn("__digest", digest(F.col(key)))
    counts = rows.groupBy("__digest").agg(F.count("*").alias("__n"))
    joined = lookup_join(rows, counts, "__digest", spread_by=spread_by, row_count="__n")
    return joined.withColumn("unique", F.col("__n") == 1).drop("__digest", "__n")


def flag_novel(
    gen: DataFrame, known: DataFrame, key: str = "key", spread_by: str = "ord"
) -> DataFrame:
    """Adds ``novel``: the key is not among the known ones."""
    rows = gen.withColumn("__digest", digest(F.col(key)))
    seen = known.select(digest(F.col(key)).alias("__digest")).distinct()
    joined = lookup_join(
        rows, seen.withColumn("__seen", F.lit(True)), "__digest", spread_by=spread_by
    )
    return joined.withColumn("novel", F.col("__seen").isNull()).drop("__digest", "__seen")


def decontaminate(train: DataFrame, known: DataFrame, key: str = "item") -> DataFrame:
    """Distinct training keys that are not known. Repeats and nulls are handled as keys."""
    sides = train.select(key, F.lit(False).alias("k")).union(known.select(key, F.lit(True)))
    return (
        sides.groupBy(key)
        .agg(F.max("k").alias("known"), F.min("k").alias("only_known"))
        .where(~F.col("known") & ~F.col("only_known"))
        .select(key)
    )


def overlap(a: DataFrame, b: DataFrame, key: str = "item") -> DataFrame:
    """Distinct keys present on both sides; nulls match nulls."""
    sides = a.select(key, F.lit(1).alias("s")).union(b.select(key, F.lit(2)))
    return (
        sides.groupBy(key)
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
        .select(key)
    )


def leak_report(a: DataFrame, b: DataFrame, key: str = "item") -> DataFrame:
    """``n_shared``: number of distinct keys on both sides, counted on digests."""

    def side(df: DataFrame) -> DataFrame:
        # a null key is a key like any other
        return df.select(F.coalesce(digest(F.col(key)), F.lit(b"")).alias("d"))

    return overlap(side(a), side(b), "d").agg(F.count("*").alias("n_shared"))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str = "item") -> None:
    found = overlap(a, b, key).limit(1).collect()
    if found:
        raise ValueError(f"both sides hold {found[0][0]!r}")


def dedup_report(df: DataFrame, known: DataFrame | None = None, key: str = "item") -> DataFrame:
    """``items_total``, ``items_deduplicated`` and, with known keys, ``items_left``."""
    profile = key_profile(df, known, key)
    return profile.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items_total"),
        F.count("*").alias("items_deduplicated"),
        F.count_if(~F.col("is_known")).alias("items_left"),
    )


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, key: str = "key", spread_by: str = "ord") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; the rows keep their other columns."""
    return _membership(a, b, key, "left_anti", spread_by)


def intersection(a: DataFrame, b: DataFrame, key: str = "key", spread_by: str = "ord") -> DataFrame:
    """Rows of ``a`` whose key is in ``b``; the flags stay those of ``a``."""
    return _membership(a, b, key, "left_semi", spread_by)


def _membership(a: DataFrame, b: DataFrame, key: str, how: str, spread_by: str) -> DataFrame:
    rows = a.withColumn("__digest", digest(F.col(key)))
    keys = b.select(digest(F.col(key)).alias("__digest")).distinct()
    return lookup_join(rows, keys, "__digest", how, spread_by).drop("__digest")
