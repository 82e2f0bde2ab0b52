"""Lines of symbols in stored parts, with an inverted index from symbol pairs to parts.

Every part is a folder with its lines and, in rows of their own, the counts of the pairs that stand
in it. Counting all pairs reads the index, which is small beside the lines; merging pairs reads and
rewrites only the parts that hold one of them, and their old folders go. Lines are dealt to parts by
ranges of their first characters, so that similar lines, and with them rare pairs, lie together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.shared import remove, shared_path
from ..batches import sliced
from .merges import apply_merge, count_pairs, flatten

PART_SYMBOLS = 16 << 20  # symbols of a part
MAX_PARTS = 4096  # beyond this, parts grow instead of their number
GROUPS = 64  # which parts hold a pair is known by groups of parts, one bit each

Merge = tuple[int, int, int]
Block = tuple[int, int, np.ndarray]  # part, uses of each line, symbols with the end mark behind each line
_LINES = "home int, n long, symbols binary"
_STORED = _LINES + ", codes array<long>, counts array<long>"


def merged(flat: np.ndarray, merges: Sequence[Merge]) -> np.ndarray:
    """Symbols of lines after some merges (left, right, new)."""
    for left, right, new in merges:
        flat = apply_merge(flat, left, right, new)
    return flat


class _Counts:
    """Pair counts of the lines of each part that a task has seen."""

    def __init__(self, end: int) -> None:
        self.end = end
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, home: int, n: int, flat: np.ndarray) -> None:
        codes, counts = count_pairs(flat, self.end)
        counts = counts * n
        if home in self.found:
            codes, place = np.unique(np.concatenate([self.found[home][0], codes]), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, place, np.concatenate([self.found[home][1], counts]))
            counts = total
        self.found[home] = codes, counts


def _without_single(flat: np.ndarray, end: int) -> np.ndarray:
    """Lines of one symbol hold no pair."""
    lengths = np.diff(np.flatnonzero(flat == end), prepend=-1)
    return flat if (lengths > 2).all() else flat[np.repeat(lengths > 2, lengths)]


class PairIndex:
    """Stored lines ``(n, line)`` of texts; lines of one symbol are not kept.

    ``convert`` gives the ids of texts and their offsets, all below ``end``. A row holds the symbols of
    many lines with the same number of uses, in as few bytes as ``end`` needs.
    """

    def __init__(self, lines: DataFrame, convert: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], end: int, parts: int | None = None):
        self.spark = lines.sparkSession
        self.root = shared_path(self.spark, "pairs")
        self.end, self.kind = end, np.min_scalar_type(end)
        if parts is None:
            size = lines.agg(F.sum(F.length("line"))).first()[0] or 0
            parts = max(self.spark.sparkContext.defaultParallelism, min(MAX_PARTS, -(-size // PART_SYMBOLS)))
        self.parts = parts
        self.version = 0
        kind = self.kind

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            own = TaskContext.get().partitionId()
            for batch in batches:
                uses = batch.column("n").to_numpy()
                order = np.argsort(uses, kind="stable")
                texts = batch.column("line").take(pa.array(order))
                edges = [0, *(np.flatnonzero(np.diff(uses[order])) + 1).tolist(), len(order)]
                for a, b in zip(edges, edges[1:]):
                    for part in sliced([texts.slice(a, b - a)]):
                        ids, offsets = convert(part)
                        yield own, int(uses[order[a]]), flatten(ids, offsets, end, kind)

        dealt = lines.where(F.length("line") > 1).repartitionByRange(parts, F.substring("line", 1, 8))
        self._store(dealt.select("n", "line"), read, [])
        made = self.spark.read.schema("codes array<long>, part int").parquet(f"{self.root}/v0").where("codes is not null")
        self.place = {r["part"]: 0 for r in made.select("part").distinct().collect()}  # version of each part

    def _blocks(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Block]]:
        kind = self.kind

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            for batch in batches:
                for home, n, symbols in zip(*(batch.column(c) for c in ("home", "n", "symbols"))):
                    yield home.as_py(), n.as_py(), np.frombuffer(symbols.as_buffer(), kind)

        return read

    def _store(self, lines: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[Block]], merges: Sequence[Merge]) -> None:
        """Writes the lines after some merges, and their pair counts, as the parts of a new version."""
        end = self.end

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = _Counts(end)
            for home, n, flat in read(batches):
                flat = merged(flat, merges)
                counts.add(home, n, flat)
                if len(flat := _without_single(flat, end)):
                    none = pa.nulls(1, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary()), none, none], ["home", "n", "symbols", "codes", "counts"])
            for home, (codes, n) in counts.found.items():
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (codes, n)]
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists], ["home", "n", "symbols", "codes", "counts"])

        rows = lines.mapInArrow(run, _STORED)
        rows.withColumn("part", F.col("home")).write.partitionBy("part").parquet(f"{self.root}/v{self.version}")

    def _folder(self, part: int) -> str:
        return f"{self.root}/v{self.place[part]}/part={part}"

    def _read(self, parts: Sequence[int]) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(*(self._folder(p) for p in parts))

    def _lines(self, parts: Sequence[int]) -> DataFrame:
        return self._read(parts).where("symbols is not null").select("home", "n", "symbols")

    def in_groups(self, mask: int) -> set[int]:
        """Parts of the groups whose bits are set."""
        return {p for p in self.place if mask >> self._group(p) & 1}

    def _group(self, part: int) -> int:
        return part * GROUPS // self.parts if self.parts > GROUPS else part

    def counts(self, pending: Sequence[Merge], touched: set[int]) -> DataFrame:
        """``code, n, mask``: every pair, its count after the pending merges, and the groups of parts that hold it.

        touched are the parts that hold a pair of the pending merges; all others come from the index.
        """
        found, rest = [], sorted(set(self.place) - touched)
        if rest:
            pairs = self._read(rest).where("codes is not null").select("home", F.explode(F.arrays_zip("codes", "counts")).alias("p"))
            found.append(pairs.select("home", F.col("p.codes").alias("code"), F.col("p.counts").alias("n")))
        if touched:
            merges, read, end = list(pending), self._blocks(), self.end

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts = _Counts(end)
                for home, n, flat in read(batches):
                    counts.add(home, n, merged(flat, merges))
                for home, (codes, n) in counts.found.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), home, np.int32)), pa.array(codes), pa.array(n)], ["home", "code", "n"])

            found.append(self._lines(sorted(touched)).mapInArrow(run, "home int, code long, n long"))
        if not found:
            return self.spark.createDataFrame([], "code long, n long, mask long")
        rows = found[0] if len(found) == 1 else found[0].unionAll(found[1])
        group = F.floor(F.col("home") * GROUPS / self.parts).cast("int") if self.parts > GROUPS else F.col("home")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), group)
        return rows.groupBy("code").agg(F.sum("n").alias("n"), F.bit_or(bit).alias("mask"))

    def rewrite(self, merges: Sequence[Merge], touched: set[int]) -> None:
        """Applies merges to the parts that hold them; no other part is read. The old folders are removed."""
        old = [self._folder(p) for p in touched]
        self.version += 1
        self._store(self._lines(sorted(touched)), self._blocks(), merges)
        self.place |= dict.fromkeys(touched, self.version)
        for folder in old:
            remove(self.spark, folder)

    def remove(self) -> None:
        remove(self.spark, self.root)
