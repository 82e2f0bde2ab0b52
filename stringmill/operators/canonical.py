"""Canonical forms through a pluggable function, computed once per distinct value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, trimmed
from .batches import sliced
from .skew import lookup_join


def with_canonical(
    df: DataFrame,
    col: str = "item",
    fn: Callable[[Column], Column] = trimmed,
    double_check: bool = True,
    strict: bool = False,
    out: str = "canonical",
) -> DataFrame:
    """Adds the canonical form of ``col`` by a Column expression; null = no form.

    ``double_check`` applies the function to its own result and keeps only stable forms.
    ``strict`` turns a missing form into an error.
    """
    form = fn(F.col(col))
    if double_check:
        form = F.when(fn(form).eqNullSafe(form), form)
    return _finish(df.withColumn(out, form), col, out, strict)


def with_canonical_udf(
    df: DataFrame,
    fn: Callable[[str], str | None],
    col: str = "item",
    double_check: bool = True,
    strict: bool = False,
    out: str = "canonical",
    spread_by: str = "ord",
) -> DataFrame:
    """As :func:`with_canonical` for a Python function, which runs on distinct values only."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        form = fn(value)
        if double_check and form is not None and fn(form) != form:
            return None
        return form

    @F.arrow_udf("string")
    def forms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in sliced(batches):
            yield pa.array([one(v) for v in values.to_pylist()], pa.string())

    key = digest(F.col(col)).alias("__digest")
    table = df.select(col, key).distinct().select("__digest", forms(F.col(col)).alias(out))
    joined = lookup_join(df.withColumn("__digest", key), table, "__digest", spread_by=spread_by)
    return _finish(joined.drop("__digest"), col, out, strict)


def _finish(df: DataFrame, col: str, out: str, strict: bool) -> DataFrame:
    if not strict:
        return df
    message = F.concat(F.lit("no canonical form: "), F.coalesce(F.col(col), F.lit("null")))
    checked = F.when(F.col(out).isNull(), F.raise_error(message).cast("string")).otherwise(F.col(out))
    return df.withColumn(out, checked)
