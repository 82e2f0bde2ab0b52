"""Delimited text sources: item files, tables, generated samples, split folders."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import HEADER_PATTERN
from ..operators.cuts import first_n
from .opened import cells, first_lines, line_digest

# fixed values: words in a path that say which split a file holds
SPLIT_NAMES = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "dev", "val"),
    "test": ("test", "testing", "eval", "evaluation"),
}


def file_order() -> Column:
    """Position of a row in its file set: file, block in the file, row in the block.

    A block is read by one task from front to back, so the order of these values is the file
    order however the blocks are spread over tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _paths(path: str | Sequence[str]) -> list[str]:
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if p.endswith(".xz"):
            raise ValueError(f"{p}: xz is not supported, unpack it or use gz or bz2")
    return paths


def _csv(spark: SparkSession, header: bool, multiline: bool = False):
    # A quote is escaped by doubling it; the backslash is an ordinary bond sign.
    return (
        spark.read.option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of all paths, in order of their names; nothing is read."""
    return sorted(unquote(f) for f in spark.read.text(paths).inputFiles())


def _by_first_line(
    spark: SparkSession, paths: list[str], told: Callable[[str | None], object]
) -> dict[object, list[str]]:
    """The files in groups of what ``told`` says of their first line.

    One job looks at all files, and what comes to the driver is one short word per file, like the
    listing that stands there anyway.
    """
    files = _files(spark, paths)

    def word(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: json.dumps(told(line)), na_action=None)

    tell = F.pandas_udf(word, "string")
    said = first_lines(spark, files).select("file", tell("line").alias("said")).collect()
    groups = defaultdict(list)
    for row in sorted(said):
        groups[row.said].append(row.file)
    return {_tuples(json.loads(k)): files for k, files in groups.items()}


def _tuples(value: object) -> object:
    return tuple(value) if isinstance(value, list) else value


def _reads_like_header(line: str | None) -> bool:
    return line is not None and re.search(HEADER_PATTERN, line.lstrip('"').upper()) is not None


def _places(spark: SparkSession, paths: list[str], names: Sequence[str]) -> dict[object, list[str]]:
    """The files in groups of the places of ``names`` in their header line, -1 for a missing one.

    Files without a line are under None. All headerless files are one group, whatever they hold.
    """

    def told(line: str | None) -> list[int] | None:
        header = cells(line)
        return header and [header.index(n) if n in header else -1 for n in names]

    return _by_first_line(spark, paths, told)


def _by_place(spark: SparkSession, files: list[str], places: Sequence[int]) -> DataFrame:
    """Columns ``c0, c1, ...`` of files with a header line; the scan reads those that are asked for."""
    width = max(places) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    return _csv(spark, True).option("enforceSchema", True).csv(files, schema=schema)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_items(
    spark: SparkSession,
    path: str | Sequence[str],
    header: bool | str = "auto",
    multiline: bool = False,
) -> DataFrame:
    """First column of headerless files as ``(ord, item)``.

    With ``header="auto"`` the first row of a file is dropped when it reads like a header
    (SMILES, REACTION, ...). All later rows stay, whatever they hold. Passing True or False
    saves the look at the files.
    """
    paths = _paths(path)
    if header == "auto":
        found = _by_first_line(spark, paths, _reads_like_header)
        groups = [(flag, found.get(flag, [])) for flag in (True, False)]
    else:
        groups = [(bool(header), paths)]
    parts = [
        _csv(spark, flag, multiline)
        .csv(files, schema=schemas.ITEMS)
        .select(file_order().alias("ord"), "item")
        for flag, files in groups
        if files
    ]
    return _union(parts) if parts else _empty_items(spark)


def _empty_items(spark: SparkSession) -> DataFrame:
    order = "ord struct<file string, block long, row long>"
    return spark.createDataFrame([], f"{order}, item string")


def read_known(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """First column of headerless files; nothing is taken for a header."""
    return read_items(spark, path, header=False)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Named columns of files with a header line, all as strings, plus ``ord``.

    Each file's own header names its columns, whatever their order. A file without one of the
    columns is an error; without ``columns`` the first file's are asked for.
    """
    paths = _paths(path)
    names = list(columns) if columns else _csv(spark, True).csv(_files(spark, paths)[0]).columns
    groups = _places(spark, paths, names)
    groups.pop(None, None)  # files without a line
    missing = sorted({n for places in groups for n, place in zip(names, places) if place < 0})
    if missing or not groups:
        raise ValueError(f"no column {missing or names} in {paths}")
    renames = renames or {}
    return _union([
        _by_place(spark, files, places).select(
            file_order().alias("ord"),
            *[F.col(f"c{place}").alias(renames.get(n, n)) for n, place in zip(names, places)],
        )
        for places, files in groups.items()
    ])


def read_reactions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw reaction table with its four columns under their prepared names."""
    return read_table(spark, path, list(schemas.REACTION_RENAMES), schemas.REACTION_RENAMES)


def read_known_reactions(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Prepared known reactions as ``(ord, id, split, product, template)``."""
    names = schemas.REACTIONS.fieldNames()
    short = dict(zip(names, ("id", "split", "product", "template")))
    return read_table(spark, path, names, short)


def read_generated(
    spark: SparkSession,
    path: str | Sequence[str],
    n: int | None = None,
    valid_only: bool = False,
) -> DataFrame:
    """Generated items as ``(ord, item)``: columns smiles and valid, or smiles, or the first one.

    Nulls are dropped, then the first ``n`` rows are taken; more than there are is an error.
    """
    paths = _paths(path)
    groups = _places(spark, paths, ["smiles", "valid"])
    groups.pop(None, None)  # files without a line
    if valid_only and any(-1 in places for places in groups):
        raise ValueError("valid_only needs the columns smiles and valid")
    parts = []
    bare = []
    for (smiles, valid), files in groups.items():
        if smiles < 0:
            bare += files
            continue
        raw = _by_place(spark, files, [smiles, valid] if valid_only else [smiles])
        kept = raw.where(F.lower(f"c{valid}") == "true") if valid_only else raw
        parts.append(kept.select(file_order().alias("ord"), F.col(f"c{smiles}").alias("item")))
    if bare or not parts:
        parts.append(read_items(spark, bare, header=False) if bare else _empty_items(spark))
    rows = _union(parts).dropna(subset=["item"])
    return rows if n is None else first_n(rows, n)


def split_word(words: Sequence[str]) -> str:
    """Pattern of one of the words standing by itself between ends, digits and ``-._/`` or blanks."""
    return "(?i)(?:^|[-._ 0-9/])(?:" + "|".join(words) + ")(?:[-._ 0-9/]|$)"


def read_split_dir(
    spark: SparkSession, directory: str, suffixes: Sequence[str] = ("csv", "txt")
) -> DataFrame:
    """A folder of headerless files as ``(split, ord, item)``; the path below it names the split.

    When no path holds a split's word, all files are training files. When some do, a file with
    none or with words of several splits is in doubt, which is an error: no file is left out
    unseen.
    """
    glob = "*.{" + ",".join(s + z for s in suffixes for z in ("", ".gz", ".bz2")) + "}"
    rows = (
        _csv(spark, False)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .csv(directory, schema=schemas.ITEMS)
    )
    end = directory.rstrip("/")
    named = {}
    for f in map(unquote, rows.inputFiles()):
        below = f.rpartition(end)[2]
        named[f] = [s for s, words in SPLIT_NAMES.items() if re.search(split_word(words), below)]
    split = F.lit("train")
    if any(named.values()):
        doubt = sorted(f for f, splits in named.items() if len(splits) != 1)
        if doubt:
            raise ValueError(f"no split, or more than one, in the names of {doubt[:5]}")
        below = F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), end, -1)
        split = F.coalesce(*[F.when(below.rlike(split_word(words)), F.lit(s)) for s, words in SPLIT_NAMES.items()])
    return rows.select(split.alias("split"), file_order().alias("ord"), "item")


def merge_tables(
    spark: SparkSession,
    paths: str | Sequence[str],
    check_header: bool = True,
    drop_duplicates: bool = True,
    column: int | str | None = 0,
) -> DataFrame:
    """All rows of several header files, first file first; repeated rows keep the first one.

    ``column`` (index or name) limits the comparison; an unknown one means all columns.
    """
    from ..operators.dedup import drop_duplicates as keep_first

    files = _files(spark, _paths(paths))
    if not files:
        raise ValueError("no files to merge")
    if isinstance(column, str) and column.lower() == "none":
        column = None
    if not check_header and drop_duplicates and isinstance(column, str):
        raise ValueError(f"column {column!r} cannot be used without the header check")
    first = _csv(spark, True).csv(files[0]).columns
    if check_header:
        # one short digest per file tells which headers are alike
        alike = _by_first_line(spark, files, lambda line: line_digest(cells(line)))
        own = next(said for said, group in alike.items() if files[0] in group)
        other = sorted(f for said, group in alike.items() if said != own for f in group)
        if other:
            raise ValueError(f"the header of {other[0]} differs from that of {files[0]}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in first])
    rows = _csv(spark, True).csv(files, schema=schema, enforceSchema=True)
    rows = rows.select(file_order().alias("ord"), *[F.col(f"`{c}`") for c in first])
    if not drop_duplicates:
        return rows
    subset = None
    if check_header and isinstance(column, int) and column < len(first):
        subset = [first[column]]
    elif check_header and isinstance(column, str) and column in first:
        subset = [column]
    return keep_first(rows, subset or first)
