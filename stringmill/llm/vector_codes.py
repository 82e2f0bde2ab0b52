"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Components are integers (floor of 1024 times the value), vectors are cut into equal parts, and each
part position has a codebook trained by rounds of assignment and componentwise means, all in exact
integers. LAESA keeps the number of exact distances small: distances of every part to a few fixed
pivots are computed once and stored beside it. A round computes only the distances from pivots to
entries; the largest difference of the two is a lower bound on a part's distance to an entry. Entries
are tried in order of their bounds, and those whose bound lies above the best distance are left out.

A round is one map over the stored parts, with sums per (part, entry) made inside tasks, and one
small aggregate: the driver sees at most parts * entries rows of it, and the codebooks travel with
the next round's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringmill.operators.skew import small_or_lookup_join

from .base import stored
from .words import list_array

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 16
BATCH = 2048
TRIED_AT_ONCE = 8
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def usable(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """vec_id, label_key, v (integers as doubles). Null and empty vectors, and those with null or non-finite components, drop out."""
    group = F.lit("n") if label is None else F.coalesce(F.concat(F.lit("v"), F.col(label).cast("string")), F.lit("n"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), group.alias("label_key"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Spark's floor would give a long; as the bound is checked first, cutting happens in the tasks
    return rows.where(F.coalesce(finite, F.lit(False))).withColumn("v", F.transform("v", lambda c: c * F.lit(float(scale))))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def table_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to the few rows of y."""
    return np.stack([distances(x, row) for row in y], axis=1)


def spread_pivots(entries: np.ndarray, most: int) -> np.ndarray:
    """Entries far from each other: each next one is the farthest from those chosen (ties: the first)."""
    chosen, gap = [0], distances(entries, entries[0])
    while len(chosen) < min(most, len(entries)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row (ties: the lowest), its squared distance, and how many distances were computed."""
    between = np.sqrt(table_of(entries, pivots)).astype(np.float32)
    bound = np.zeros((len(x), len(entries)), np.float32)
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p : p + 1] - between[None, :, p]), out=bound)
    # both distances are rounded to 24 bits: the bound gives way by more than that
    bound -= np.float32(4e-7) * (to_pivots.max(1, initial=0)[:, None] + between.max(initial=0))
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    live, step, tried = np.arange(len(x)), min(TRIED_AT_ONCE, len(entries)), 0
    while len(live):
        some = bound[live]
        near = np.argpartition(some, step - 1, axis=1)[:, :step] if step < len(entries) else np.broadcast_to(np.arange(step), some.shape)
        low = np.take_along_axis(some, near, 1)
        i, j = np.nonzero(np.isfinite(low) & ((low <= 0) | (low.astype(np.float64) ** 2 <= best[live][:, None])))
        row, entry = live[i], near[i, j]
        d = distances(x[row], entries[entry])
        tried += len(d)
        order = np.lexsort((entry, d, row))
        row, entry, d = row[order], entry[order], d[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        row, entry, d = row[first], entry[first], d[first]
        better = (d < best[row]) | ((d == best[row]) & (entry < index[row]))
        best[row[better]], index[row[better]] = d[better], entry[better]
        bound[live[:, None], near] = np.inf  # tried, or left out for good
        left = bound[live].min(1)
        live = live[np.isfinite(left) & ((left <= 0) | (left.astype(np.float64) ** 2 <= best[live]))]
        step = min(2 * step, len(entries))
    return index, best, tried


@dataclass
class Codebooks:
    """Entries and pivots of each part position, integers of shape (parts, entries or pivots, width)."""

    entries: np.ndarray
    pivots: np.ndarray
    scale: int = SCALE

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def parts(self, flat: np.ndarray) -> np.ndarray:
        """(vectors, all components) -> (parts, vectors, width)."""
        return flat.reshape(len(flat), len(self.entries), -1).transpose(1, 0, 2)


def _parts_table(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label_key, parts (integers), gaps (distances to all pivots): computed once, read by every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = whole.slice(low, BATCH)
                flat = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False)).astype(np.int64).reshape(batch.num_rows, -1)
                gaps = np.concatenate([np.sqrt(table_of(x, p)) for x, p in zip(books.parts(flat), books.pivots)], axis=1).astype(np.float32)
                lists = [list_array(pa.array(x.ravel()), np.arange(0, x.size + 1, x.shape[1])) for x in (flat.astype(np.int32), gaps)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), *lists], names=["vec_id", "label_key", "parts", "gaps"])

    return stored(rows.mapInArrow(run, "vec_id long, label_key string, parts array<int>, gaps array<float>"), "vector-parts")


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its parts, the index of each part's entry and the distances; shapes (parts, rows, ...)."""
    for whole in batches:
        for low in range(0, whole.num_rows, BATCH):
            batch = whole.slice(low, BATCH)
            flat, gaps = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("parts", "gaps"))
            parts = books.parts(flat.astype(np.int64))
            found = [nearest(x, g, e, p) for x, g, e, p in zip(parts, books.parts(gaps), books.entries, books.pivots)]
            yield batch, parts, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def _round(table: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floor of the mean of their parts; entries without parts stay."""
    many, each, width = books.entries.shape
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(many * each, np.int64), np.zeros((many * each, width), np.int64)
        for _, parts, index, _ in _assigned(batches, books):
            slot = (index + each * np.arange(many)[:, None]).ravel()
            counts += np.bincount(slot, minlength=len(counts))
            np.add.at(sums, slot, parts.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (used // each, used % each, counts[used], *sums[used].T)], names=names)

    made = table.select("parts", "gaps").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    entries = books.entries.copy()
    for r in made.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        entries[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return Codebooks(entries, books.pivots, books.scale)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> tuple[Codebooks, DataFrame] | None:
    """Codebooks trained on usable() rows, and the stored table of their parts; None without rows.

    The codebooks begin as the parts of the rows with the smallest ids (null ids last, equal ids in
    order of their vectors). Rows of several lengths, a length that parts does not divide, and values
    whose squared distances could leave 64 bits raise ValueError.
    """
    size, peak = F.size("v"), F.array_max(F.transform("v", F.abs))
    shape = rows.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.max(peak).alias("peak")).first()
    if shape["low"] is None:
        return None
    if shape["low"] != shape["high"] or shape["low"] % parts:
        raise ValueError(f"vectors need one length that {parts} divides, not {shape['low']} to {shape['high']}")
    if shape["peak"] >= (2**61 / shape["low"]) ** 0.5 or shape["peak"] >= 2**31 - 1:
        raise ValueError(f"components up to {shape['peak'] / scale:g} are too large for exact 64-bit distances")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.floor(np.array([r["v"] for r in first])).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start), np.stack([spread_pivots(e, pivots) for e in start]), scale)
    table = _parts_table(rows, books)
    for _ in range(rounds):
        books = _round(table, books)
    return books, table


def coded(table: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label_key, code (two hex digits a part, more where entries need them), error."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, index, error in _assigned(batches, books):
            codes = reduce(np.char.add, [np.array([f"{i:0{digits}x}" for i in range(books.entries.shape[1])])[row] for row in index])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), pa.array(codes.tolist(), pa.string()), pa.array(error.sum(0))], names=["vec_id", "label_key", "code", "error"])

    return table.mapInArrow(run, "vec_id long, label_key string, code string, error long")


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", into: str = "vector") -> DataFrame:
    """Adds the vector that a code stands for: its entries' integers over the scale."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
    parts = []
    for i, entries in enumerate(books.entries):
        at = F.conv(F.substring(code, digits * i + 1, digits), 16, 10).cast("int")
        parts.append(F.array(*(F.array(*map(F.lit, (e / books.scale).tolist())) for e in entries))[at])
    return codes.withColumn(into, F.concat(*parts))


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", **sizes) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    error sums the squared distances of the parts to their entries, label_error sums the errors of all
    rows of an equal label, null ones together. Rows that repeat count as often as they stand. Null and
    empty vectors and those with null or non-finite components have no row; a null id has one. Without
    usable rows the result is empty. sizes: parts, entries, rounds, pivots, scale, as in fit.
    """
    rows = usable(vectors, key, vector, label, sizes.get("scale", SCALE))
    fitted = fit(rows, **sizes)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    books, table = fitted
    codes = stored(coded(table, books), "vector-codes")
    totals = codes.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    joined = small_or_lookup_join(codes, totals, "label_key", spread_by="vec_id")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
