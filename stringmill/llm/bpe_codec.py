"""Byte-level BPE over a local rank file: texts to ids, and ids back to bytes.

The tiktoken library applies the merges. A long text is first cut at safe boundaries: in front of
a space that follows an ASCII letter or digit every match of the pattern ends, whatever comes
later, so the parts give the ids of the whole text while each call stays short.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import give_back, list_array, part_of

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= )")


@lru_cache(4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cuts a long text at the first safe boundary after each size characters."""
    low = 0
    while len(text) - low > size:
        found = _SAFE.search(text, low + size)
        if found is None:
            break
        yield text[low : found.start()]
        low = found.start()
    yield text[low:] if low else text


def encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN, part: int = PART_CHARS) -> DataFrame:
    """Adds the ids of each whole text as array<int>, without special tokens.

    Null and empty texts give an empty array. Every other column, also repeated rows, stays as it
    is; a column that already has the name of the new one is replaced. Bytes that are not valid
    UTF-8 count as replacement characters.
    """
    rest = [c for c in docs.columns if c != into]
    schema = docs.select(*rest).withColumn(into, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoding(path, pattern)
        for batch in batches:
            ids, ends = [], [0]
            for raw in batch.column(text).cast(pa.large_binary()).to_pylist():
                size = ends[-1]
                for piece in parts((raw or b"").decode("utf-8", "replace"), part):
                    got = encoder.encode_ordinary(piece)
                    ids.append(np.array(got, np.int32))
                    size += len(got)
                ends.append(size)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), list_array(values, np.array(ends))], names=[*rest, into])

    return docs.select(*rest).mapInArrow(_rows(run), schema)


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the bytes of each id list as binary: raw bytes, never forced into valid text.

    A null list gives empty bytes. An id outside the rank file is an error.
    """
    rest = [c for c in docs.columns if c != into]
    schema = docs.select(*rest).withColumn(into, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _encoding(path, pattern)
        for batch in batches:
            column = batch.column(ids)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            values = column.values.to_numpy(zero_copy_only=False) if len(column) else []
            where = column.offsets.to_numpy()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            out = [decoder.decode_bytes(values[a:b].tolist()) if ok else b"" for a, b, ok in zip(where, where[1:], known)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, into])

    return docs.select(*rest).mapInArrow(_rows(run), schema)


def _rows(run, rows: int = 256):
    """Hands on batches of few rows, so that id lists of many long texts never meet in memory."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                yield part_of(batch, low, min(low + rows, batch.num_rows))
        batch = None
        give_back()

    return lambda batches: run(few(batches))
