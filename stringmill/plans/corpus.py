"""Preparing item and reaction corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import assert_disjoint, decontaminate
from ..sources.items import read_items, read_reactions
from ..sources.sinks import write_items

TEMPLATE = "reaction_smarts_with_atom_mapping"  # fixed value: name of the template column


def prepare_item_corpus(spark: SparkSession, source: str, target: str) -> DataFrame:
    """First column of the source files, header dropped, written without one."""
    items = read_items(spark, source)
    write_items(items, target)
    return items


def split_reactions(raw: DataFrame, column: str = TEMPLATE) -> dict[str, DataFrame]:
    """``known`` (all rows of valid and test) and the distinct templates of each split.

    Training templates that are known are left out. Validation and test may share templates.
    """
    known = raw.where(F.col("split").isin("valid", "test"))
    parts = {
        s: raw.where(F.col("split") == s).select(column).distinct() for s in ("valid", "test")
    }
    train = decontaminate(raw.where(F.col("split") == "train"), known, column)
    return {"known": known, "train": train, **parts}


def prepare_reaction_corpus(
    spark: SparkSession, source: str, target: str, check: bool = True
) -> dict[str, DataFrame]:
    """Reads the raw reaction table and writes ``known``, ``train``, ``valid`` and ``test``."""
    parts = split_reactions(read_reactions(spark, source))
    if check:
        assert_disjoint(parts["train"], parts["known"], TEMPLATE)
    for name, df in parts.items():
        write_items(df, f"{target}/{name}", header=name == "known")
    return parts
