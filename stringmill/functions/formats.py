"""How numbers, durations and paths are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: Column) -> Column:
    """``H:MM:SS``, with ``N day(s), `` in front from one day on."""
    total = seconds.cast("long")
    days = F.floor(total / 86400)
    rest = F.pmod(total, F.lit(86400))
    clock = F.concat_ws(
        ":",
        F.floor(rest / 3600).cast("string"),
        F.lpad(F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("string"), 2, "0"),
        F.lpad(F.pmod(rest, F.lit(60)).cast("string"), 2, "0"),
    )
    prefix = F.when(days == 0, "").otherwise(
        F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "))
    )
    return F.when(total.isNotNull(), F.concat(prefix, clock))


def round_epoch(epochs: Column) -> Column:
    """Nearest whole number, half to even."""
    return F.bround(epochs).cast("int")


def path_stem(path: Column) -> Column:
    """Last part of a path without its suffix; a leading dot is no suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?/*$", 1)


def format_metric(value: Column, spec: str = "") -> Column:
    """``.4f`` and ``.2f`` (half to even on the exact value), or the plain text; null stays null."""
    if not spec:
        return value.cast("string")
    if not (spec.startswith(".") and spec.endswith("f")):
        raise ValueError(f"unknown format {spec!r}")
    number = value.cast("double")
    shown = F.call_function("format_number", number, F.lit("0." + "0" * int(spec[1:-1])))
    return F.when(F.isnan(number), "nan").otherwise(shown)


def model_size_label(n_parameters: Column) -> Column:
    return F.concat(format_metric(n_parameters / F.lit(float(2**20)), ".2f"), F.lit("M"))
