"""Files opened by path inside tasks: first lines, digests of files of any size, small named files.

A scan reads blocks or whole values. What a file starts with, and a digest that runs over all its
bytes, are read here from a stream: one task opens a path and holds one block of it at a time.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path

#: Bytes held at a time while a file is read from front to back.
READ_BYTES = 4 * 2**20
#: Bytes of one leaf of a Merkle digest, the piece that one task reads.
LEAF_BYTES = 64 * 2**20
#: Entries of a folder that a task hands over at a time.
LISTED_ROWS = 10_000
#: What a task tells of a folder's entries; ``millis`` is the time of the last change.
LISTED = "path string, name string, is_folder boolean, length long, millis long"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # Spark's paths are not encoded, an address is
    return fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@"))


def open_stream(path: str) -> io.RawIOBase:
    """The file's bytes as they stand, from the front."""
    system, inner = _place(path)
    return system.open_input_stream(inner, compression=None)


def _unpacked(path: str) -> io.BufferedIOBase:
    raw = open_stream(path)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if path.endswith(".bz2") else raw


def _first_line(path: str) -> str | None:
    with _unpacked(path) as stream, io.TextIOWrapper(stream, "utf-8", "replace", newline=None) as lines:
        return next((line.rstrip("\n") for line in lines if line.strip()), None)


def cells(line: str | None) -> list[str] | None:
    """The cells of one delimited line; a quote is escaped by doubling it."""
    return None if line is None else next(csv.reader([line]))


def line_digest(parts: list[str] | None) -> str:
    """A short name for a list of cells; equal lists have equal names."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def _tasks(spark: SparkSession, n: int) -> int:
    return max(1, min(n, 4 * spark.sparkContext.defaultParallelism))


def places(spark: SparkSession, root: str) -> list[str]:
    """What a path or pattern names, spelled as Spark does; nothing where it names nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or ()]


def in_reach(path: str) -> bool:
    """Whether Arrow's file systems see something at a path."""
    try:
        system, inner = _place(path)
        return system.get_file_info(inner).type != fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def _hidden(name: str) -> bool:
    """Whether Spark's listings pass over a file or folder of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(path: str, own: str) -> Iterator[pd.DataFrame]:
    """What lies in a folder, or the file itself, without hidden names and the name ``own``."""
    system, inner = _place(path)
    infos = [system.get_file_info(inner)]
    folder = path.rpartition("/")[0]
    if infos[0].type == fs.FileType.Directory:
        infos, folder = system.get_file_info(fs.FileSelector(inner)), path.rstrip("/")
    for start in range(0, len(infos), LISTED_ROWS):
        part = [i for i in infos[start : start + LISTED_ROWS] if not _hidden(i.base_name) and i.base_name != own]
        yield pd.DataFrame(
            {
                "path": pd.Series([f"{folder}/{i.base_name}" for i in part], dtype=str),
                "name": pd.Series([i.base_name for i in part], dtype=str),
                "is_folder": pd.Series([i.type == fs.FileType.Directory for i in part], dtype=bool),
                "length": pd.Series([i.size for i in part], dtype="Int64"),
                "millis": pd.Series([None if i.mtime_ns is None else i.mtime_ns // 10**6 for i in part], dtype="Int64"),
            }
        )


def walk(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``(path, name, length, millis)`` of every file at or below the roots, without hidden ones.

    A job for each depth lists its folders, each in one task. What they find stays in tables of the
    shared folder, which are left out here; the driver learns how many folders come next.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield from _entries(path, own)

    target = shared_path(spark, "listing")
    own = target.rpartition("/")[2]
    folders = spark.createDataFrame(pd.DataFrame({"path": pd.Series(roots, dtype=str)}), "path string")
    n, tables = len(roots), []
    while n:
        tables.append(f"{target}/{len(tables)}")
        folders.repartition(_tasks(spark, n), "path").mapInPandas(look, LISTED).write.parquet(tables[-1])
        folders = spark.read.schema(LISTED).parquet(tables[-1]).where("is_folder").select("path")
        n = folders.count()
    files = spark.read.schema(LISTED).parquet(*tables).where("not is_folder").drop("is_folder")
    # one root may lie below another
    return files.dropDuplicates(["path"]) if len(roots) > 1 else files


def first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, line)``: the first line of each file that is not blank, null without one.

    One job whatever the number of files; a task reads no more of a file than one buffer.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(line=[_first_line(f) for f in batch["file"]])

    listed = spark.createDataFrame(pd.DataFrame({"file": pd.Series(files, dtype=str)}), "file string")
    return listed.repartition(_tasks(spark, len(files)), "file").mapInPandas(look, "file string, line string")


def file_digests(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Adds ``digest`` to a table of ``path``: each file is read from front to back in blocks.

    A file may have any size; it is one task's work. :func:`merkle_digests` spreads large ones.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                state = hashlib.new(algorithm)
                with open_stream(path) as stream:
                    while block := stream.read(READ_BYTES):
                        state.update(block)
                found.append(state.hexdigest())
            yield batch.assign(digest=found)

    return files.mapInPandas(read, f"{_ddl(files)}, digest string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def merkle_digests(files: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``(path, n_leaves, digest)`` of ``(path, length)``: sha256 over the sha256 of all leaves in order.

    Leaves are ``leaf_bytes`` long (the last one shorter; an empty file has one empty leaf) and are
    read by as many tasks as there are. What meets per file is 32 bytes a leaf.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, leaf in zip(batch["path"], batch["leaf"]):
                system, inner = _place(path)
                state, left = hashlib.sha256(), leaf_bytes
                with system.open_input_file(inner) as file:
                    file.seek(leaf * leaf_bytes)
                    while left and (block := file.read(min(left, READ_BYTES))):
                        state.update(block)
                        left -= len(block)
                found.append(state.hexdigest())
            yield batch.assign(hash=found)

    last = F.greatest(F.floor((F.col("length") - 1) / leaf_bytes), F.lit(0)).cast("long")
    leaves = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("leaf"))
    hashed = leaves.repartition("path", "leaf").mapInPandas(read, "path string, leaf long, hash string")
    parts = F.sort_array(F.collect_list(F.struct("leaf", "hash")))
    joined = F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["hash"])))
    return hashed.groupBy("path").agg(
        F.count("*").alias("n_leaves"), F.sha2(joined, 256).alias("digest")
    )


def write_named(files: DataFrame, root: str) -> int:
    """Writes ``(path, content)`` as files named by ``path`` below ``root``; the number of files.

    For run artefacts, whose names are fixed. A file is replaced whole, so a task that runs again
    leaves the same files. A null content is an empty file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                system, inner = _place(f"{root}/{path}")
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inner, compression=None) as out:
                    out.write((content or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select("path", "content").mapInPandas(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
