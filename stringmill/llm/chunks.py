"""Exact duplicates by chunk recipes.

Each text is cut where its content says so, distinct chunks get verified identifiers, and texts are
equal when their ordered identifier lists are. The bytes of a chunk move once per task that holds
it, whatever the number and length of the texts that contain it; after that only 8 bytes per chunk
travel.

A chunk's identifier starts as its 64-bit hash. Distinct chunks are then grouped on hash and bytes:
a hash that stands for several byte strings is a clash, and the chunks behind it get ranks. Without
clashes, hashes are proven identifiers for this input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import id_and_text, stored, text_or_empty
from .words import list_array, mix, rolling, slices, text_bytes

WINDOW = 24
MEAN_BYTES = 1024
MAX_BYTES = 64 << 10


def cuts(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_BYTES, largest: int = MAX_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of all texts, and the number of chunks of each text.

    A chunk ends after each window of 24 bytes whose hash falls below a threshold. Stretches
    without such a window are cut every largest bytes, so a chunk's size is bounded.
    """
    n = len(data)
    stops = np.zeros(0, np.int64)
    if n >= WINDOW:
        h = rolling(3).windows(rolling(3).bytes[data], WINDOW)
        stops = np.flatnonzero(h < np.uint64(2**64 // mean)) + WINDOW
        text = np.searchsorted(offsets, stops - WINDOW, "right") - 1
        stops = stops[stops <= offsets[text + 1]]  # windows across two texts do not count
    ends = np.unique(np.concatenate([stops, offsets[1:][np.diff(offsets) > 0]]))
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    more = (ends - starts - 1) // largest
    if more.any():
        long = np.flatnonzero(more)
        ends = np.unique(np.concatenate([ends, *(np.arange(starts[i] + largest, ends[i], largest) for i in long)]))
    return ends, np.diff(np.searchsorted(ends, offsets, "right"))


def _keys(data: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    view = memoryview(np.ascontiguousarray(data))
    h = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts, ends)), np.uint64, len(ends))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def recipes(docs: DataFrame, mean: int = MEAN_BYTES, bits: int = 64) -> DataFrame:
    """doc_id, text -> doc_id, recipe array<long>, text_sha256. An empty text has an empty recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ends, counts = cuts(data, offsets, mean)
            values = pa.array(_keys(data, ends, bits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(values, np.append(0, np.cumsum(counts))), batch.column("text_sha256")], names=["doc_id", "recipe", "text_sha256"])

    with_digest = docs.select("doc_id", "text", F.sha2(text_or_empty("text").cast("binary"), 256).alias("text_sha256"))
    return with_digest.mapInArrow(run, "doc_id long, recipe array<long>, text_sha256 string")


def chunk_table(docs: DataFrame, mean: int = MEAN_BYTES, bits: int = 64) -> DataFrame:
    """Distinct chunks: chunk_key, chunk. The aggregate drops repeats map-side before any bytes move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ends, _ = cuts(data, offsets, mean)
            if len(ends):
                where = pa.py_buffer(np.append(0, ends).astype(np.int32))
                chunks = pa.Array.from_buffers(pa.binary(), len(ends), [None, where, pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([pa.array(_keys(data, ends, bits)), chunks], names=["chunk_key", "chunk"])

    return docs.select("text").mapInArrow(run, "chunk_key long, chunk binary").distinct()


def clashing_keys(chunks: DataFrame) -> DataFrame:
    """Keys that stand for several byte strings; past the distinct chunks only 16 bytes each move."""
    return chunks.groupBy("chunk_key").agg(F.count("*").alias("n")).where("n > 1").select("chunk_key")


def clashes(chunks: DataFrame, several: DataFrame) -> DataFrame:
    """Chunks behind clashing keys, with their rank under the key."""
    order = Window.partitionBy("chunk_key").orderBy("chunk")
    return chunks.join(several, "chunk_key", "left_semi").select("chunk_key", "chunk", F.row_number().over(order).alias("chunk_rank"))


def _verified(docs: DataFrame, keyed: DataFrame, clashing: DataFrame, mean: int, bits: int) -> DataFrame:
    """Recipes in which the keys of clashing chunks carry the rank of the chunk's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ends, counts = cuts(data, offsets, mean)
            starts = np.append(0, ends)[: len(ends)]
            rows = np.repeat(np.arange(batch.num_rows), counts)
            first = np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(pa.array(rows)), pa.array(np.arange(len(ends)) - first), pa.array(_keys(data, ends, bits)), pa.array([data[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                names=["row_key", "at", "chunk_key", "chunk"],
            )

    # a text with a clash is named by its digest here: only its own chunks are looked up
    touched = keyed.select("text_sha256", F.explode("recipe").alias("chunk_key")).distinct().join(clashing.select("chunk_key").distinct(), "chunk_key", "left_semi").select("text_sha256").distinct()
    texts = docs.select(F.sha2(text_or_empty("text").cast("binary"), 256).alias("row_key"), "text").join(touched.withColumnRenamed("text_sha256", "row_key"), "row_key", "left_semi").dropDuplicates(["row_key", "text"])
    parts = texts.mapInArrow(run, "row_key string, at long, chunk_key long, chunk binary")
    ranked = parts.join(clashing, ["chunk_key", "chunk"], "left").groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_key", F.coalesce("chunk_rank", F.lit(0)).alias("r")))).alias("c"))
    ranks = ranked.select(F.col("row_key").alias("text_sha256"), F.flatten(F.transform("c", lambda x: F.array(x["chunk_key"], x["r"].cast("long")))).alias("exact"))
    return keyed.join(ranks, "text_sha256", "left").select("doc_id", F.coalesce("exact", "recipe").alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", mean: int = MEAN_BYTES, bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null texts count as empty, and all empty texts are equal. Of equal texts the row with the
    largest id stays; if that id is repeated with the same text, exactly one of its rows stays. A
    null id is smaller than any other; a group of null ids alone keeps one of them, with a null
    keep_id. bits shortens the chunk hash, for tests of the clash path.
    """
    rows = id_and_text(docs, key, text)
    keyed = recipes(rows, mean, bits)
    chunks = chunk_table(rows, mean, bits)
    several = stored(clashing_keys(chunks), "clashing")
    if not several.isEmpty():
        clashing = stored(clashes(chunks, several), "clashes")
        keyed = _verified(rows, keyed, clashing, mean, bits)
    # rows that agree in id and recipe travel as one
    same = keyed.groupBy("doc_id", "recipe").agg(F.count("*").alias("copies"), F.first("text_sha256").alias("text_sha256"))
    same = stored(same, "recipes")
    groups = same.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    # a table of its own, so that the join below can split the rows of a large group
    groups = stored(groups, "groups")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    found = same.join(groups, "recipe", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return found.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks")
