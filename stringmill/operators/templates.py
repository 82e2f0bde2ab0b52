"""Generated templates against known reactions: similarity, feasibility, known splits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity_key
from ..sources.shared import stored
from .skew import grid_join, lookup_join


def similar_known(
    gen: DataFrame, known: DataFrame, criterion: str = "canonical", template: str = "template"
) -> DataFrame:
    """Known rows with the similarity key of at least one generated template, plus that ``key``.

    The match is kept factorised: generated templates and known rows meet through the key, so
    the result is never larger than the known table, however many templates share a key.
    """
    keys = distinct_keys(gen, template, criterion).select("key").distinct()
    keyed = known.withColumn("key", similarity_key(F.col("template"), criterion))
    return lookup_join(keyed, keys, "key", "left_semi", spread_by="ord")


def matches_summary(matches: DataFrame, by: str = "key") -> DataFrame:
    """Per key: number of matching rows, number of non-null ids and the first id in file order.

    The joined id list itself has no bound, so it stays a table (the input, one row per id);
    only its length and its head are aggregated.
    """
    has_id = F.col("id").isNotNull()
    return matches.groupBy(by).agg(
        F.count("*").alias("n_similar"),
        F.count("id").alias("num_works_with"),
        F.min(F.when(has_id, F.struct("ord", "id")))["id"].alias("first_id"),
    )


def distinct_keys(
    gen: DataFrame, template: str = "template", criterion: str = "canonical"
) -> DataFrame:
    """Distinct templates with their similarity ``key``.

    The key is tied to the count of its template, so the optimizer cannot move the costly
    expression, or a filter on it, below the aggregate to every single row.
    """
    key = similarity_key(F.col(template), criterion)
    return (
        gen.groupBy(template)
        .agg(F.count("*").alias("__n"))
        .select(template, F.when(F.col("__n") > 0, key).alias("key"))
    )


def feasibility(
    gen: DataFrame,
    known: DataFrame,
    applies: Callable[[str, str], bool] | None = None,
    template: str = "template",
) -> DataFrame:
    """One row per distinct valid template: ``feasible``, ``num_works_with``, ``first_id``.

    A template is feasible when it applies to the product of a similar known row. Without
    ``applies`` an equal key counts as applicable and known rows are aggregated per key, with
    no pairs at all. With it the function runs once per distinct (template, product) of a key,
    its errors count as false, and the pairs are aggregated as they come.
    """
    templates = distinct_keys(gen, template).where("key is not null")
    keyed = known.withColumn("key", similarity_key(F.col("template"), "canonical"))
    if applies is None:
        table = matches_summary(keyed.where("key is not null"))
        joined = lookup_join(templates, table, "key", spread_by=template)
        works = joined.withColumn("feasible", F.col("n_similar").isNotNull())
    else:

        @F.pandas_udf("boolean")
        def works_with(templates: pd.Series, products: pd.Series) -> pd.Series:
            def one(t: str, p: str) -> bool:
                try:
                    return bool(applies(t, p))
                except Exception:
                    return False

            return pd.Series([one(t, p) for t, p in zip(templates, products)], dtype=bool)

        has_id = F.col("id").isNotNull()
        products = (
            keyed.where("key is not null")
            .groupBy("key", "product")
            .agg(
                F.count("id").alias("ids"),
                F.min(F.when(has_id, F.struct("ord", "id"))).alias("first"),
            )
        )
        # read for the counts of their keys and for the pairs
        templates, products = stored(templates, "templates"), stored(products, "products")
        # each template meets each product of its key once, in a cell sized from both counts
        hits = (
            grid_join(templates, products, "key", template, "product")
            .where(works_with(F.col(template), F.col("product")))
            .groupBy(template)
            .agg(F.sum("ids").alias("num_works_with"), F.min("first")["id"].alias("first_id"))
            .withColumn("hit", F.lit(True))
        )
        works = templates.join(hits, template, "left").withColumn(
            "feasible", F.col("hit").isNotNull()
        )
    first = F.when(F.col("feasible"), F.coalesce("first_id", F.lit("")))
    return works.select(
        template,
        "feasible",
        F.coalesce("num_works_with", F.lit(0)).cast("int").alias("num_works_with"),
        first.alias("first_id"),
    )


def known_by_split(
    gen: DataFrame, known: DataFrame, template: str = "template", spread_by: str = "ord"
) -> DataFrame:
    """Adds ``is_known``, ``in_val`` and ``in_test``: exact match with any known row of a split."""
    table = known.groupBy(F.col("template").alias(template)).agg(
        F.lit(True).alias("is_known"),
        F.bool_or(F.col("split") == "valid").alias("in_val"),
        F.bool_or(F.col("split") == "test").alias("in_test"),
    )
    joined = lookup_join(gen, table, template, spread_by=spread_by)
    flags = ("is_known", "in_val", "in_test")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})


def partition_check(labelled: DataFrame) -> DataFrame:
    """One row of sizes and booleans over distinct templates.

    ``valid = known + new`` need not hold: an existing template that is not feasible is
    neither. It is reported, not asserted.
    """
    known = F.col("feasible") & F.col("is_known")
    counts = (
        labelled.where("valid")
        .groupBy("template")
        .agg(F.bool_or("feasible").alias("feasible"), F.bool_or("is_known").alias("is_known"))
        .agg(
            F.count("*").alias("n_valid"),
            F.count_if("feasible").alias("n_feasible"),
            F.count_if(known).alias("n_known"),
            F.count_if(~F.col("is_known")).alias("n_new"),
        )
    )
    return counts.withColumns(
        {
            "valid_is_known_plus_new": F.col("n_valid") == F.col("n_known") + F.col("n_new"),
            "feasible_within_valid": F.col("n_feasible") <= F.col("n_valid"),
            "known_within_feasible": F.col("n_known") <= F.col("n_feasible"),
        }
    )
