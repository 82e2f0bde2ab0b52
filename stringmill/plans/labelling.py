"""Labelling generated items and templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_generated, digest, identity_key, template_key, trimmed
from ..operators.skew import lookup_join
from ..operators.tally import ITEM_COUNTERS, TEMPLATE_COUNTERS, fractions
from ..operators.templates import feasibility
from ..sources.shared import stored

Marks = tuple[str, str, str]
MARKS: Marks = ("^", " ", "_")  # fixed values: prompt, padding, end of generated text


def clean_items(
    gen: DataFrame, col: str = "item", marks: Marks = MARKS, drop_empty: bool = True
) -> DataFrame:
    rows = gen.withColumn(col, clean_generated(F.col(col), *marks))
    return rows.where(F.length(col) > 0) if drop_empty else rows


def batch_distinct(gen: DataFrame, key: str = "key") -> DataFrame:
    """One row per key and batch, the first in order."""
    rest = [c for c in gen.columns if c not in (key, "batch", "ord")]
    first = F.min(F.struct("ord", *rest)).alias("__f")
    return (
        gen.groupBy("batch", key)
        .agg(first)
        .select("batch", F.col("__f.ord").alias("ord"), key, *[F.col(f"__f.{c}").alias(c) for c in rest])
    )


def label_generated_items(
    gen: DataFrame,
    known: DataFrame,
    canonical: Callable[[Column], Column] = trimmed,
    marks: Marks = MARKS,
    canonical_known: bool = True,
) -> DataFrame:
    """``(batch, ord, item, canonical, valid, unique, novel, first)`` of generated ``(batch, ord, item)``.

    ``(batch, ord)`` identifies a row. Repeats inside a batch are one row. ``unique`` = the key
    occurs once in the whole output, ``novel`` = it is not known (also true for invalid items),
    ``first`` = first batch of a valid key.

    All flags are found on digests, over a table of row identities that is stored once. The texts are shuffled once, in the last join, on the row
    identity, which no two rows share.
    """
    rows = clean_items(gen.select("batch", "ord", "item"), "item", marks)
    form = canonical(F.col("item"))
    rows = rows.withColumn("canonical", F.when(canonical(form).eqNullSafe(form), form))
    slim = rows.select(
        "batch",
        "ord",
        digest(identity_key(F.col("item"), F.col("canonical"))).alias("key"),
        F.col("canonical").isNotNull().alias("valid"),
    )
    kept = slim.groupBy("batch", "key").agg(F.min("ord").alias("ord"), F.max("valid").alias("valid"))
    # some 50 bytes per row, read for the counts, for hot keys and for the flags
    kept = stored(kept, "kept")

    raw = F.col("item")
    known_key = digest(identity_key(raw, canonical(raw)) if canonical_known else raw)
    none = F.lit(None).cast(gen.schema["batch"].dataType)
    sides = kept.select("key", F.lit(1).alias("g"), "batch").union(
        known.select(known_key, F.lit(0), none)
    )
    profile = (
        sides.groupBy("key")
        .agg(
            F.sum("g").alias("n"),
            F.count_if(F.col("g") == 0).alias("n_known"),
            F.min("batch").alias("first_batch"),
        )
        .where(F.col("n") > 0)
    )
    flags = lookup_join(kept, profile, "key", spread_by=["batch", "ord"]).select(
        "batch",
        "ord",
        "valid",
        (F.col("n") == 1).alias("unique"),
        (F.col("n_known") == 0).alias("novel"),
        (F.col("valid") & (F.col("batch") == F.col("first_batch"))).alias("first"),
    )
    return rows.join(flags, ["batch", "ord"]).select(
        "batch", "ord", "item", "canonical", "valid", "unique", "novel", "first"
    )


def item_tally(labelled: DataFrame) -> DataFrame:
    """generated, valid, unique, novel: each a part of the one before."""
    row = labelled.agg(
        F.count("*").alias("c0"),
        F.count_if("valid").alias("c1"),
        F.count_if("first").alias("c2"),
        F.count_if(F.col("first") & F.col("novel")).alias("c3"),
    )
    return fractions(row, list(ITEM_COUNTERS))


def item_table(labelled: DataFrame) -> DataFrame:
    """The exchanged table: smiles, canonical_smiles, valid, unique, novel."""
    return labelled.select(
        F.col("item").alias("smiles"), F.col("canonical").alias("canonical_smiles"), "valid", "unique", "novel"
    )


def novel_items(labelled: DataFrame) -> DataFrame:
    """The short table: canonical forms of novel valid items, each once."""
    keep = F.col("first") & F.col("novel")
    return labelled.where(keep).select(F.col("canonical").alias("smiles"))


def label_generated_templates(
    gen: DataFrame,
    known: DataFrame,
    applies: Callable[[str, str], bool] | None = None,
    marks: Marks = MARKS,
) -> DataFrame:
    """Labels of generated ``(batch, ord, template)`` against known ``(ord, id, split, product, template)``.

    Templates are compared by their raw text; empty ones stay and are invalid. Flags of a
    repeated template are the same in all its rows.
    """
    rows = clean_items(gen.select("batch", "ord", "template"), "template", marks, drop_empty=False)
    rows = stored(batch_distinct(rows, "template"), "templates")
    profile = rows.groupBy("template").agg(
        F.count("*").alias("n"), F.min("batch").alias("first_batch")
    )
    # evaluated once per distinct template: it depends on an aggregate
    profile = profile.withColumn(
        "valid", (F.col("n") > 0) & template_key(F.col("template")).isNotNull()
    )
    profile = stored(profile, "profile")
    splits = known.groupBy("template").agg(
        F.lit(True).alias("is_known"),
        F.bool_or(F.col("split") == "valid").alias("in_val"),
        F.bool_or(F.col("split") == "test").alias("in_test"),
    )
    # all three tables have one row per distinct template, so these joins meet no hot key
    facts = profile.join(feasibility(profile, known, applies), "template", "left").join(
        splits, "template", "left"
    )
    joined = lookup_join(rows, facts, "template", spread_by=["batch", "ord"])
    valid = F.col("valid")

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    feasible = flag("feasible")
    return joined.select(
        "batch",
        "ord",
        "template",
        "valid",
        (F.col("n") == 1).alias("unique"),
        (valid & (F.col("batch") == F.col("first_batch"))).alias("first"),
        feasible.alias("feasible"),
        flag("is_known").alias("is_known"),
        (feasible & flag("in_val")).alias("in_val"),
        (feasible & flag("in_test")).alias("in_test"),
        F.coalesce("num_works_with", F.lit(0)).alias("num_works_with"),
        "first_id",
    )


def template_tally(labelled: DataFrame) -> DataFrame:
    once = F.col("first")
    known = once & F.col("feasible") & F.col("is_known")
    row = labelled.agg(
        F.count("*").alias("c0"),
        F.count_if("valid").alias("c1"),
        F.count_if(once).alias("c2"),
        F.count_if(once & F.col("feasible")).alias("c3"),
        F.count_if(known).alias("c4"),
        F.count_if(known & F.col("in_val")).alias("c5"),
        F.count_if(known & F.col("in_test")).alias("c6"),
    )
    return fractions(row, list(TEMPLATE_COUNTERS))


def template_table(labelled: DataFrame) -> DataFrame:
    """The exchanged table with its nine columns."""
    return labelled.select(
        F.col("template").alias("smarts"),
        "valid",
        "unique",
        "feasible",
        (F.col("in_val") | F.col("in_test")).alias("not_trained_on_but_known"),
        F.col("in_val").alias("known_from_valid_set"),
        F.col("in_test").alias("known_from_test_set"),
        F.col("num_works_with").alias("num_products_works_with"),
        F.col("first_id").alias("example_works_with_reaction_id"),
    )


def feasible_templates(labelled: DataFrame) -> DataFrame:
    """The short table: distinct feasible templates."""
    keep = F.col("first") & F.col("feasible")
    return labelled.where(keep).select(F.col("template").alias("smarts"))
