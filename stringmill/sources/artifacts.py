"""Run artefacts: small JSON, text and binary files below a folder of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import path_stem
from . import opened

# fixed values: file names that make a folder a run
MODEL_FILE = "pytorch_model.bin"
ITEMS_FILE = "generated_smiles.csv"
TEMPLATES_FILE = "generated_smarts.csv"
CHECKPOINT_PREFIX = "checkpoint"
SCHEDULER_FILE = "scheduler.pt"
CARD_FILE = "README.md"
JSON_FILES = (
    "tokenizer.json",
    "config.json",
    "misc_training_information.json",
    "all_results.json",
    "trainer_state.json",
    "generate_args.json",
    "generate_stats.json",
    "assess_stats.json",
)

# fixed values: how the training arguments are written in a model card
CARD_PATTERNS = {
    "batch_size": r"(?m)(^\s*)-(\s*train_batch_size:\s*)(\d*)",
    "lr": r"(?m)(^\s*)-(\s*learning_rate:\s*)(\d*\.\d*)",
}

_ARTIFACTS = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("file", T.StringType()), T.StructField("content", T.StringType())]
)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]+$", "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: ``(path, folder, name, length, modified)``; nothing is read.

    Tasks list the folders, so the files do not pass through the driver. What scans pass over, files
    of no bytes and ``_metadata``, has no length and no time. A file system that Spark reaches but
    Arrow does not is listed by the driver.
    """
    roots = opened.places(spark, root)
    if not roots or not all(map(opened.in_reach, roots)):
        return _scanned_files(spark, root)
    read = (F.col("length") > 0) & (~F.col("name").startswith("_") | F.col("name").contains("="))
    return opened.walk(spark, roots).select(
        "path",
        _folder(F.col("path")).alias("folder"),
        "name",
        F.coalesce(F.when(read, F.col("length")), F.lit(0)).alias("length"),
        F.when(read, F.timestamp_millis("millis")).alias("modified"),
    )


def _scanned_files(spark: SparkSession, root: str) -> DataFrame:
    """The same files as Spark's scan finds them; their names and statuses stand on the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = pd.DataFrame({"path": pd.Series([unquote(f) for f in files.inputFiles()], dtype=str)})
    # both sides spell a path as file:/..., whatever number of slashes the listing has
    known = files.select(_one_slash(F.col("path")).alias("path"), "length", "modificationTime")
    every = spark.createDataFrame(listed, "path string").select(_one_slash(F.col("path")).alias("path"))
    return every.join(known, "path", "left").select(
        "path",
        _folder(F.col("path")).alias("folder"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.coalesce("length", F.lit(0)).alias("length"),
        F.col("modificationTime").alias("modified"),
    )


def _one_slash(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def discover_runs(files: DataFrame) -> DataFrame:
    """Folders that hold a model or generated rows, with flags per kind.

    Folders of intermediate training checkpoints are left out.
    """

    def holds(name: str) -> Column:
        return F.bool_or(F.col("name") == name)

    runs = files.groupBy(F.col("folder").alias("run")).agg(
        holds(MODEL_FILE).alias("has_model"),
        holds(ITEMS_FILE).alias("has_items"),
        holds(TEMPLATES_FILE).alias("has_templates"),
        holds(SCHEDULER_FILE).alias("has_scheduler"),
        F.max("modified").alias("created"),
    )
    intermediate = path_stem(F.col("run")).startswith(CHECKPOINT_PREFIX) & F.col("has_scheduler")
    return runs.where(
        (F.col("has_model") | F.col("has_items") | F.col("has_templates")) & ~intermediate
    ).drop("has_scheduler")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run, one row; equal times go to the greater path."""
    return runs.agg(F.max(F.struct("created", "run"))["run"].alias("run"))


def read_json_artifacts(
    spark: SparkSession, root: str, names: Sequence[str] = JSON_FILES
) -> DataFrame:
    """``(run, file, content)``: whole JSON files by name. A missing file has no row."""
    return _whole_files(spark, root, names)


def read_cards(spark: SparkSession, root: str) -> DataFrame:
    return _whole_files(spark, root, [CARD_FILE])


def _whole_files(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    texts = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(names) + "}")
        .text(root)
    )
    path = _one_slash(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    return texts.select(
        _folder(path).alias("run"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")
    )


def card_values(text: Column, patterns: Mapping[str, str] = CARD_PATTERNS) -> dict[str, Column]:
    """Values found in a model card; no match or an empty number is null."""
    return {
        name: F.nullif(F.regexp_extract(text, pattern, 3), F.lit(""))
        for name, pattern in patterns.items()
    }


def file_digests(spark: SparkSession, root: str, algorithm: str = "sha256") -> DataFrame:
    """``(name, path, digest)`` of every file below a path, of any size.

    The listing spreads the files over tasks; a task reads one file at a time, block by block.
    """
    if algorithm not in ("sha256", "md5"):
        raise ValueError("algorithm must be sha256 or md5")
    files = list_files(spark, root).select("name", "path")
    return opened.file_digests(files.repartition("path"), algorithm)


def merkle_digests(
    spark: SparkSession, root: str, leaf_bytes: int = opened.LEAF_BYTES
) -> DataFrame:
    """``(name, path, n_leaves, digest)``: one file's pieces are read by many tasks.

    The digest is the sha256 over the sha256 of the pieces, so it differs from that of the whole.
    """
    files = list_files(spark, root).select("path", "length")
    return opened.merkle_digests(files, leaf_bytes).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "n_leaves", "digest"
    )


def verify_checksums(digests: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry ``(name, expected)`` against files: ``status`` ok, mismatch, missing or unchecked."""
    joined = registry.join(digests, "name", "left")
    status = (
        F.when(F.col("digest").isNull(), "missing")
        .when(F.col("expected").isNull(), "unchecked")
        .when(F.lower(F.regexp_replace("expected", "^[a-z0-9]+:", "")) == F.col("digest"), "ok")
        .otherwise("mismatch")
    )
    return joined.select("name", "expected", "digest", status.alias("status"))


#: Digests are combined over their first four digits, then two, then all: 256 values meet on each
#: upper level, and a 65 536th of the files on the lowest.
FILESET_LEVELS = (4, 2, 0)


def fileset_digest(digests: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """One digest of a set of files, whatever their order: ``(digest, n_files)``."""
    level = digests.select(F.col("digest").alias("place"), "digest", F.lit(1).cast("long").alias("n"))
    for digits in FILESET_LEVELS:
        parts = F.sort_array(F.collect_list(F.struct("place", "digest")))
        joined = F.concat_ws("", F.transform(parts, lambda p: p["digest"]))
        combined = F.sha2(joined, 256) if algorithm == "sha256" else F.md5(joined)
        level = level.groupBy(F.substring("place", 1, digits).alias("place")).agg(
            combined.alias("digest"), F.sum("n").alias("n")
        )
    return level.select("digest", F.col("n").alias("n_files"))
