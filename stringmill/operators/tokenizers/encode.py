"""Encoding and decoding: map-side, no shuffle, Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.pieces import pretokenize
from ..batches import sliced
from ..skew import lookup_join
from .lattice import Lattice, best_cut, chunks
from .merges import encode_flat, flatten, pair_code, unflatten
from .model import PREFIX, TokenModel

_IDS = T.ArrayType(T.IntegerType())
BLOCK_CHARS = 2 << 20  # characters of the rows whose pieces are looked up together


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _pieces_udf(model: TokenModel) -> Callable[[Column], Column]:
    tokens, unk = list(model.tokens), model.unk_id

    @F.arrow_udf(_IDS)
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Ids of pieces by one hash lookup over a run of rows."""
        known = pa.array(tokens, pa.string())
        for pieces in sliced(batches):
            offsets = pieces.offsets.to_numpy()
            flat = pieces.flatten().cast(pa.string())
            ids = pc.fill_null(pc.index_in(flat, value_set=known), unk)
            yield _lists(offsets - offsets[0], ids.cast(pa.int32()))

    return lookup


def _char_ids(model: TokenModel) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to (ids of all characters, offsets of the texts)."""
    single = sorted((ord(t), i) for t, i in model.ids.items() if len(t) == 1)
    codes = np.array([c for c, _ in single], dtype=np.int64)
    ids = np.array([i for _, i in single], dtype=np.int32)
    unk = model.unk_id

    def convert(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        joined = "".join(t for t in texts.to_pylist() if t is not None)
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(codes, chars), len(codes) - 1)
        found = np.where(codes[at] == chars, ids[at], unk)
        return found, np.concatenate(([0], np.cumsum(lengths)))

    return convert


def _chars_udf(model: TokenModel) -> Callable[[Column], Column]:
    """Character pieces and their ids in one step, without a string per character."""
    convert = _char_ids(model)

    @F.arrow_udf(_IDS)
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            ids, offsets = convert(texts)
            yield _lists(offsets, ids)

    return lookup


def _bpe_udf(model: TokenModel) -> Callable[[Column], Column]:
    ids, convert = model.ids, _char_ids(model)
    table = {}
    for rank, (a, b) in enumerate(model.merges):
        table.setdefault(pair_code(ids[a], ids[b]), (rank, ids[a + b]))
    codes = np.array(sorted(table), dtype=np.int64)
    ranks = np.array([table[c][0] for c in codes.tolist()], dtype=np.int64)
    order = np.argsort(np.argsort(ranks))  # dense ranks
    results = np.array([table[c][1] for c in codes.tolist()], dtype=np.int64)

    @F.arrow_udf(_IDS)
    def merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            chars, offsets = convert(texts)
            values, ends = unflatten(encode_flat(flatten(chars, offsets), codes, order, results))
            yield _lists(ends, values)

    return merge


def _line_udf(one: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    @F.arrow_udf(_IDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in sliced(batches):
            yield pa.array([one(line) for line in lines.to_pylist()], pa.list_(pa.int32()))

    return run


def _wordpiece_line(model: TokenModel) -> Callable[[str], list[int]]:
    ids, unk = model.ids, model.unk_id
    longest = max(map(len, model.tokens))

    def one(line: str) -> list[int]:
        """Longest match first; a line that cannot be covered is one unknown token."""
        if len(line) > model.max_word:
            return [unk]
        out, start = [], 0
        while start < len(line):
            mark = PREFIX if start else ""
            for end in range(min(len(line), start + longest), start, -1):
                found = ids.get(mark + line[start:end])
                if found is not None:
                    out.append(found)
                    start = end
                    break
            else:
                return [unk]
        return out

    return one


def _unigram_udf(model: TokenModel) -> Callable[[Column], Column]:
    ids, unk = model.ids, model.unk_id
    lattice = Lattice(model.logp)
    piece_ids = [ids[p] for p in lattice.pieces]
    penalty = min(model.logp.values()) - 10.0  # fixed value: cost of an unknown character

    def fused(cut: list[int]) -> list[int]:
        """Neighbouring unknown characters are one unknown token."""
        out: list[int] = []
        for piece in cut:
            if piece >= 0:
                out.append(piece_ids[piece])
            elif not out or out[-1] != unk:
                out.append(unk)
        return out

    @F.arrow_udf(_IDS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in sliced(batches):
            texts = lines.to_pylist()
            result: list[list[int] | None] = [None if t is None else [] for t in texts]
            full = [i for i, t in enumerate(texts) if t]
            for group in chunks([texts[i] for i in full]):
                rows = [full[i] for i in group]
                for row, cut in zip(rows, best_cut(lattice, [texts[i] for i in rows], penalty)):
                    result[row] = fused(cut)
            yield pa.array(result, pa.list_(pa.int32()))

    return run


def raw_ids(
    text: Column, model: TokenModel, kind: str = "CHAR", pattern: str | None = None
) -> Column:
    """Ids of a text without begin and end tokens."""
    if model.algorithm == "WORDLEVEL" and kind.upper() == "CHAR" and pattern is None:
        return _chars_udf(model)(text)
    if model.algorithm == "WORDLEVEL":
        return _pieces_udf(model)(pretokenize(text, kind, pattern))
    if model.algorithm == "BPE":
        return _bpe_udf(model)(text)
    if model.algorithm == "WORDPIECE":
        return _line_udf(_wordpiece_line(model))(text)
    return _unigram_udf(model)(text)


def with_marks(ids: Column, bos: int, eos: int, max_length: int | None = None) -> Column:
    """Begin and end token around the ids; too long ones lose tokens at the left."""
    if max_length is not None:
        room = max_length - 2
        ids = F.when(F.size(ids) > room, F.slice(ids, F.size(ids) - room + 1, room)).otherwise(ids)
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def masks(df: DataFrame, pad: int, length: Column, specials: tuple[int, ...]) -> DataFrame:
    """Pads ``input_ids`` on the right to ``length`` and adds both masks."""
    ids = F.col("input_ids")
    missing = F.greatest(length - F.size(ids), F.lit(0))
    padded = F.concat(ids, F.array_repeat(F.lit(pad), missing))
    attention = F.concat(
        F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing)
    )
    # only the outer marks and the padding are special; a mark inside the text is text
    inner = F.array_repeat(F.lit(0), F.size(ids) - 2)
    special = F.concat(
        F.array(F.lit(1)), inner, F.array(F.lit(1)), F.array_repeat(F.lit(1), missing)
    )
    return df.withColumns(
        {"attention_mask": attention, "special_tokens_mask": special, "input_ids": padded}
    )


def encode(
    items: DataFrame,
    model: TokenModel,
    kind: str = "CHAR",
    pattern: str | None = None,
    col: str = "item",
    max_length: int | None = None,
    pad_to: str | int | None = None,
    multiple: int = 1,
    spread_by: str = "ord",
    cut_into: str | None = None,
) -> DataFrame:
    """Adds ``input_ids``, ``attention_mask`` and ``special_tokens_mask``.

    Ids are whole unless ``max_length`` is given; then longer ones lose tokens at the left, and
    ``cut_into`` names a column for how many.

    ``pad_to`` is a fixed length or the name of a batch column, whose rows are padded to the
    longest of the batch; lengths are rounded up to ``multiple``. None leaves rows as they are.
    """
    rows = items.withColumn("input_ids", raw_ids(F.col(col), model, kind, pattern))
    if cut_into is not None:
        room = F.size("input_ids") if max_length is None else F.lit(max_length - 2)
        rows = rows.withColumn(cut_into, F.greatest(F.size("input_ids") - room, F.lit(0)))
    rows = rows.withColumn("input_ids", with_marks(F.col("input_ids"), model.bos_id, model.eos_id, max_length))
    return pad_rows(rows, model.pad_id, pad_to, multiple, spread_by)


def pad_rows(
    rows: DataFrame, pad: int, pad_to: str | int | None, multiple: int = 1, spread_by: str = "ord"
) -> DataFrame:
    def up(length: Column) -> Column:
        return (F.ceil(length / multiple) * multiple).cast("int")

    if isinstance(pad_to, str):
        longest = rows.groupBy(pad_to).agg(F.max(F.size("input_ids")).alias("__len"))
        rows = lookup_join(rows, longest, pad_to, spread_by=spread_by)
        return masks(rows, pad, up(F.col("__len")), ()).drop("__len")
    length = F.size("input_ids") if pad_to is None else F.lit(pad_to)
    return masks(rows, pad, up(length), ())


def encode_wordlevel_join(
    items: DataFrame,
    vocab: DataFrame,
    unk: int,
    kind: str = "CHAR",
    pattern: str | None = None,
    col: str = "item",
    row_id: str = "ord",
) -> DataFrame:
    """Word-level ids ``(row_id, ids)`` for a vocabulary too large to travel with the tasks.

    Rows are dealt to blocks of about ``BLOCK_CHARS`` characters by their id. What joins the vocabulary
    is each distinct piece of a block once; a block's rows then meet the ids of its own pieces. Rows
    of one id are one row, their pieces ordered by place; rows without pieces are left out.
    """
    pieces = pretokenize(F.col(col), kind, pattern)
    by_char = pattern is None and kind.upper() == "CHAR"
    size = items.agg(F.sum(F.length(col))).first()[0] or 0
    block = F.pmod(F.xxhash64(row_id), F.lit(max(1, -(-size // BLOCK_CHARS)))).alias("__block")
    rows = items.where(F.length(col) > 0)
    tokens = rows.select(block, F.explode(F.array_distinct(pieces)).alias("token")).distinct()
    found = lookup_join(tokens, vocab.select("token", "id"), "token", spread_by="__block")
    found = found.select("__block", "token", F.coalesce("id", F.lit(unk)).alias("id"))
    text = F.col(col) if by_char else F.array_join(pieces, "")
    sizes = F.lit(None).cast("array<int>") if by_char else F.transform(pieces, lambda p: F.length(p))
    docs = rows.select(block, F.col(row_id).alias("__row"), text.alias("__text"), sizes.alias("__sizes"))
    schema = T.StructType([T.StructField(row_id, docs.schema["__row"].dataType), T.StructField("ids", T.ArrayType(found.schema["id"].dataType))])

    def look_up(block_rows: pa.Table, known: pa.Table) -> pa.Table:
        key = block_rows.column("__row").combine_chunks()
        texts = block_rows.column("__text").to_pylist()
        names = known.column("token").combine_chunks().cast(pa.string()).dictionary_encode()
        number = known.column("id").to_numpy()
        if by_char:
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            codes = np.array([ord(t) for t in names.dictionary.to_pylist()], dtype=np.uint32)
            order = np.argsort(codes)
            slot = order[np.searchsorted(codes[order], np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32))]
        else:
            cuts = block_rows.column("__sizes").to_pylist()
            lengths = np.array([len(c) for c in cuts], dtype=np.int64)
            flat = [t[e - n : e] for t, c in zip(texts, cuts) for n, e in zip(c, accumulate(c))]
            slot = pc.index_in(pa.array(flat, pa.string()), value_set=names.dictionary.cast(pa.string())).to_numpy()
        # the ids of a token stand together; usually it has one
        entry = names.indices.to_numpy()
        by_token = np.lexsort((number, entry))
        uses = np.bincount(entry, minlength=len(names.dictionary))[slot]
        first = np.searchsorted(entry[by_token], slot)
        pos = np.arange(len(slot)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        if len(slot) and uses.max() > 1:
            inner = np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
            first, pos, row = np.repeat(first, uses) + inner, np.repeat(pos, uses), np.repeat(row, uses)
        ids = number[by_token[first]]
        same = key.dictionary_encode(null_encoding="encode")
        if len(same.dictionary) < len(key):  # rows of one id are one row
            row = same.indices.to_numpy()[row]
            order = np.lexsort((ids, pos, row))
            row, ids = row[order], ids[order]
            key = same.dictionary
        n = np.bincount(row, minlength=len(key))
        kept = np.flatnonzero(n)
        ends = pa.array(np.append(0, np.cumsum(n[kept])), pa.int32())
        return pa.table({row_id: key.take(pa.array(kept)), "ids": pa.ListArray.from_arrays(ends, pa.array(ids, known.schema.field("id").type))})

    return docs.groupBy("__block").cogroup(found.groupBy("__block")).applyInArrow(look_up, schema)


def decode(ids: Column, model: TokenModel) -> Column:
    """Text of ids without special tokens and without separators between tokens."""
    prefix = model.algorithm == "WORDPIECE"
    inner = [t[len(PREFIX) :] if prefix and t.startswith(PREFIX) else t for t in model.tokens]
    shown = ["" if t in model.specials else s for t, s in zip(model.tokens, inner)]

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pa.array(shown, pa.string())
        for lists in sliced(batches):
            offsets = lists.offsets.to_numpy()
            rows = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pieces.take(lists.flatten()))
            yield pc.binary_join(rows, "")

    return texts(ids)


def roundtrip_report(
    items: DataFrame,
    model: TokenModel,
    kind: str = "CHAR",
    pattern: str | None = None,
    col: str = "item",
) -> DataFrame:
    """All items whose decoded ids differ from the text, with what came back."""
    ids = raw_ids(F.col(col), model, kind, pattern)
    rows = items.withColumn("decoded", decode(ids, model))
    return rows.where(~F.col("decoded").eqNullSafe(F.col(col)))


def length_buckets(
    encoded: DataFrame, width: int = 8, partitions: int | None = None, col: str = "input_ids"
) -> DataFrame:
    """Adds ``bucket`` and lays rows of similar length together."""
    rows = encoded.withColumn("bucket", F.floor(F.size(col) / width).cast("int"))
    return rows.repartitionByRange(partitions, "bucket") if partitions else rows.repartitionByRange("bucket")
