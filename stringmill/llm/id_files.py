"""Token ids as compressed files in ascending document order, and back.

Texts are dealt to partitions by ranges of doc_id and sorted there; each partition is tokenized and
written as one file, so files in order of their number hold the documents in order. A file is a
header, the table of its documents, and streams of the context-mixing coder (id_coder). Files are
bounded by the bytes of text in a partition, tasks by the ids of a stream.

The tokenizer drops white space and cuts at it, so a text's ids are the ids of its words, one after
the other. Each worker sends a word to the library once and then takes its ids from arrays.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringmill.sources.shared import shared_path

from . import id_coder
from .base import id_and_text, text_or_empty
from .hash_files import _put
from .words import Words, ascii_lower, ragged, slices, words_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
FILE_BYTES = 24 << 20
STREAM_IDS = 2 << 20
CACHE_WORDS = 2_000_000
LINE_WORDS = 256
MARK = " <|endoftext|> "  # a special token of the tokenizer: no match goes across it
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
_MAGIC = b"IDFILE1\0"
_HEAD = "<8sQQI"  # magic, documents, bytes of the document table, its checksum


class WordIds:
    """Ids of words, from the library at first sight and from sorted arrays afterwards.

    A word is known by two independent 64-bit hashes. At CACHE_WORDS the arrays start anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK.strip())
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _encoded(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words from the library, and the number of ids of each.

        Words go in lines with a special token between them, which ends every match on both sides.
        A line that comes back with another number of marks holds the mark itself: its words are
        then sent one by one.
        """
        raw = words.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
        lines = [texts[i : i + LINE_WORDS] for i in range(0, len(texts), LINE_WORDS)]
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for low in range(0, len(lines), 64):  # few encodings at a time are in memory
            some = lines[low : low + 64]
            for line, made in zip(some, self.tokenizer.encode_batch_fast([MARK.join(x) for x in some], add_special_tokens=False)):
                found = np.array(made.ids, np.int32)
                cuts = np.flatnonzero(found == self.mark)
                if len(cuts) == len(line) - 1:
                    ids.append(np.delete(found, cuts))
                    sizes.append(np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1)
                else:
                    alone = [e.ids for e in self.tokenizer.encode_batch_fast(line, add_special_tokens=False)]
                    ids.append(np.array([i for x in alone for i in x], np.int32))
                    sizes.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, words: Words, at: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        flat, sizes = self._encoded(words, at)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, place, keys), np.insert(self.checks, place, checks)
        self.starts, self.sizes = np.insert(self.starts, place, starts), np.insert(self.sizes, place, sizes)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each word."""
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        keys, first, place = np.unique(words.hashes(51), return_index=True, return_inverse=True)
        checks = words.hashes(52)
        if len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
            if len(new):
                self._add(words, first[new], keys[new], checks[first[new]])
                at = np.searchsorted(self.keys, keys)
            if (self.checks[at][place] != checks).any():  # two words under one first hash: no shortcut for this slice
                return self._encoded(words, np.arange(len(words.starts)))
            sizes = self.sizes[at][place]
            return self.pool[ragged(self.starts[at][place], sizes)], sizes
        return np.zeros(0, np.int32), np.zeros(0, np.int64)


@lru_cache(2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_id, ids of all texts of a slice, and the number of ids of each text."""
    source = _word_ids(path)
    for batch in slices(batches, "text"):
        # the tokenizer lower-cases all but special tokens, which all begin alike, but composes letters and marks first
        words = ascii_lower(words_of(batch.column("text")), b"<|")
        ids, sizes = source.of(words)
        counts = np.diff(np.append(0, np.cumsum(sizes))[words.first])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        yield batch.column("doc_id"), ids, counts


def _file(docs: list[pa.Array], counts: list[np.ndarray], streams: list[bytes]) -> Iterator[bytes]:
    known = pa.concat_arrays(docs) if docs else pa.array([], pa.int64())
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    table = known.fill_null(0).to_numpy().astype("<i8").tobytes() + known.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes() + n.astype("<i8").tobytes()
    table = zlib.compress(table, 1)
    yield struct.pack(_HEAD, _MAGIC, len(known), len(table), zlib.crc32(table))
    yield table
    yield struct.pack("<I", len(streams))
    for s in streams:
        yield struct.pack("<Q", len(s))
        yield s


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, end_id: int | None = END_ID, file_bytes: int = FILE_BYTES, stream_ids: int = STREAM_IDS, block: int = id_coder.BLOCK, slots: int = id_coder.SLOTS) -> DataFrame:
    """Tokenizes all texts and writes ids-<number>.idf files below folder, in ascending order of id.

    A file holds about file_bytes of text in streams of stream_ids ids; block and slots are those of
    id_coder.encode. A task keeps a stream and its context tables in memory.

    Returns one row per file: number, docs, ids. Null texts count as empty and have the end id only;
    null ids come first; rows with equal ids follow each other in order of their text's hash. A
    repeated or doubled task replaces its file by the same file.
    """
    rows = id_and_text(docs, key, text)
    size = rows.agg(F.sum(F.octet_length(text_or_empty("text"))).alias("n")).first()["n"] or 0
    files = max(1, -(-size // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        names, counts, streams, held, waiting = [], [], [], [], 0
        total = 0
        for docs_of, ids, n in tokenized(batches, path, end_id):
            names.append(docs_of)
            counts.append(n)
            held.append(ids)
            waiting += len(ids)
            total += len(ids)
            while waiting >= stream_ids:
                ids = np.concatenate(held)
                streams.append(id_coder.encode(ids[:stream_ids], block, slots))
                held, waiting = [ids[stream_ids:]], len(ids) - stream_ids
        if waiting:
            streams.append(id_coder.encode(np.concatenate(held), block, slots))
        _put(f"{folder}/ids-{number:09d}.idf", _file(names, counts, streams))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sum(map(len, names))]), pa.array([total])], names=["number", "docs", "ids"])

    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "number long, docs long, ids long")


def read(spark: SparkSession, folder: str, starts: dict[int, int] | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document of the files below folder.

    Without ids the last column stays in the task; all blocks are decoded and checked all the same.

    starts: ids before each file, from the rows that write returned; without them, start counts
    from the beginning of the file. One file is one row of the reader, so files stay of bounded size.
    """
    given = starts or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                number = int(name.rsplit("-", 1)[1].split(".")[0])
                yield from _documents(memoryview(content.as_buffer()), given.get(number, 0), ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.idf").load(folder).select("path", "content")
    return files.mapInArrow(run, _schema(ids))


def _schema(ids: bool) -> str:
    return SCHEMA if ids else SCHEMA.rsplit(",", 1)[0]


def _documents(raw: memoryview, start: int, ids: bool = True) -> Iterator[pa.RecordBatch]:
    magic, n, size, check = struct.unpack_from(_HEAD, raw)
    at = struct.calcsize(_HEAD)
    if magic != _MAGIC or zlib.crc32(raw[at : at + size]) != check:
        raise ValueError("not an id file, or its document table is damaged")
    table = zlib.decompress(raw[at : at + size])
    docs, absent, counts = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 8 * n), np.frombuffer(table, "<i8", n, 9 * n)
    at += size
    (many,) = struct.unpack_from("<I", raw, at)
    at += 4
    ready, row = np.zeros(0, np.uint32), 0
    for i in range(max(many, 1)):
        if i < many:
            (size,) = struct.unpack_from("<Q", raw, at)
            ready = np.concatenate([ready, id_coder.decode(bytes(raw[at + 8 : at + 8 + size]))])
            at += 8 + size
        while row < n:  # some hundred documents at a time, as far as they are complete
            ends = np.cumsum(counts[row : row + 512])
            high = int(np.searchsorted(ends, len(ready), "right"))
            if not high:
                break
            where = np.append(0, ends[:high])
            some = ready[: where[-1]]
            sums = [zlib.crc32(some[a:b]) for a, b in zip(where, where[1:])]
            names = pa.array(docs[row : row + high], pa.int64(), mask=absent[row : row + high].astype(bool))
            arrays = [names, pa.array(start + where[:-1]), pa.array(counts[row : row + high]), pa.array(sums, pa.int64())]
            if ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(some.view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])
            ready, row, start = ready[where[-1] :], row + high, start + int(where[-1])


def write_and_read(docs: DataFrame, folder: str | None = None, ids: bool = True, **options) -> DataFrame:
    """Writes the files and reads them back, with starts counted over all files.

    One number per file reaches the driver; files hold FILE_BYTES of text each.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "id-files")
    made = sorted((r["number"], r["ids"]) for r in write(docs, folder, **options).collect())
    if not made:  # an empty table has no file
        return spark.createDataFrame([], _schema(ids))
    starts, total = {}, 0
    for number, n in made:
        starts[number], total = total, total + n
    return read(spark, folder, starts, ids)
