"""What the operators share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringmill.sources.shared import shared_root, stored

__all__ = ["crc_bucket", "free_names", "id_and_text", "shared_root", "stored", "text_or_empty"]


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def crc_bucket(key: str, parts: int) -> Column:
    """crc32 of a key written as text, modulo parts; a null key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def id_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names: no other name can clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as keep them apart from all taken ones (in any case)."""
    used = {c.lower() for c in taken}
    front = "__"
    while any((front + n).lower() in used for n in names):
        front += "_"
    return [front + n for n in names]
