"""Sorted hash arrays in the shared folder, memory-mapped by the workers.

A table with a 64-bit hash column (and further fixed-width columns) is dealt by the top bits of its
hash into shards, some for each core and of a million rows at most, one task for each. A shard becomes one raw file per column, sorted by hash; tasks write under a
name of their own and rename at the end, so a repeated or doubled task leaves whole files. Workers
map the files: pages are shared between the processes of a machine and nothing passes the driver
but one number per shard. A shared folder that is no file path is fetched once per machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringmill.sources.shared import shared_path

SHARD_ROWS = 1 << 20
LEAST_ROWS = 1 << 14
SHARDS_PER_CORE = 4


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def _put(uri: str, parts: Iterator[bytes]) -> None:
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(own, path)
    else:
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
            for part in parts:
                out.write(part)
        store.move(own, path)


def _fetched(uri: str) -> str:
    """A local path of a file of the shared folder."""
    if (path := _local(uri)) is not None:
        return path
    path = os.path.join(tempfile.gettempdir(), "hash-files", *uri.split("/")[-2:])
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        pyarrow.fs.copy_files(uri, own := f"{path}.{uuid.uuid4().hex}")
        os.replace(own, path)
    return path


@dataclass
class HashFiles:
    """A stored table: its folder, the number of shards (as a power of two), rows and column types."""

    folder: str
    bits: int
    counts: dict[int, int]
    kinds: dict[str, str]
    _open: dict = field(default_factory=dict, repr=False)

    @property
    def rows(self) -> int:
        return sum(self.counts.values())

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def column(self, name: str, shard: int) -> np.ndarray:
        if (name, shard) not in self._open:
            path = _fetched(f"{self.folder}/{shard}.{name}")
            self._open[name, shard] = np.memmap(path, self.kinds[name], "r", shape=(self.counts[shard],))
        return self._open[name, shard]

    def find(self, hashes: np.ndarray, columns: list[str] | None = None, also: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which hashes are in the table, and their values of other columns (0 where absent).

        also names second hash columns that must agree, for keys of 128 bits.
        """
        order = np.argsort(hashes)
        asked = hashes[order]
        found = np.zeros(len(asked), bool)
        out = {c: np.zeros(len(asked), self.kinds[c]) for c in columns or []}
        edges = np.searchsorted(asked, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        for shard, (a, b) in enumerate(zip([0, *edges], [*edges, len(asked)])):
            if a == b or not self.counts.get(shard):
                continue
            keys = self.column("hash", shard)
            at = np.searchsorted(keys, asked[a:b])
            live = np.flatnonzero(at < len(keys))
            hit = np.zeros(b - a, bool)
            while len(live):  # more than one turn only where the first hash alone is not distinct
                live = live[keys[at[live]] == asked[a:b][live]]
                good = np.ones(len(live), bool)
                for name, values in (also or {}).items():
                    good &= self.column(name, shard)[at[live]] == values[order[a:b][live]]
                hit[live[good]] = True
                live = live[~good]
                at[live] += 1
                live = live[at[live] < len(keys)]
            found[a:b] = hit
            for c in out:
                out[c][a:b][hit] = self.column(c, shard)[at[hit]]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found[back], {c: v[back] for c, v in out.items()}


def write(table: DataFrame, name: str, rows: int | None = None, shard_rows: int = SHARD_ROWS) -> HashFiles:
    """Stores a table with a long column hash, read as unsigned; other columns are numbers.

    Smaller tables have smaller shards, so that all cores have one to sort and to write.
    """
    spark = table.sparkSession
    rows = table.count() if rows is None else rows
    shard_rows = min(shard_rows, max(LEAST_ROWS, rows // (SHARDS_PER_CORE * spark.sparkContext.defaultParallelism)))
    # two shards at least: in a shard all hashes have one sign, so the signed order is the unsigned one
    bits = max(1, (rows // shard_rows).bit_length())
    folder = shared_path(spark, name)
    kinds = {f.name: {"bigint": "i8", "int": "i4", "float": "f4", "double": "f8", "smallint": "i2", "tinyint": "i1"}[f.dataType.simpleString()] for f in table.schema} | {"hash": "u8"}
    names = table.columns
    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int")
    dealt = table.withColumn("__shard", shard).repartitionById(1 << bits, "__shard").sortWithinPartitions("__shard", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, parts in _by_shard(batches):
            held = [(c, tempfile.TemporaryFile()) for c in names]
            n = 0
            for part in parts:
                n += part.num_rows
                for c, out in held:
                    out.write(np.ascontiguousarray(part.column(c).to_numpy()))
            for c, out in held:
                out.seek(0)
                _put(f"{folder}/{own}.{c}", iter(lambda f=out: f.read(1 << 20), b""))
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([n])], names=["shard", "n"])

    made = dealt.mapInArrow(run, "shard long, n long").collect()
    return HashFiles(folder, bits, {r["shard"]: r["n"] for r in made}, kinds)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of rows of one shard, each as a stream of batches."""
    pending: list[tuple[int, pa.RecordBatch]] = []

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shards = batch.column("__shard").to_numpy()
            edges = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
            for a, b in zip(edges, [*edges[1:], len(shards)]):
                yield int(shards[a]), batch.slice(a, b - a)

    source = pieces()

    def of(shard: int, first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield first
        for other, batch in source:
            if other != shard:
                pending.append((other, batch))
                return
            yield batch

    for shard, first in source:
        yield shard, of(shard, first)
        while pending:
            shard, first = pending.pop()
            yield shard, of(shard, first)
