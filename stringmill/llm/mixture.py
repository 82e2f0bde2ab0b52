"""Mixing sources to target weights by fixed-length blocks.

Words of each source are packed, in order of document id, into blocks of BLOCK words. Output shards
draw how many blocks of each source they hold; the slots of a source are numbered through all
shards, and a pseudorandom permutation of the source's block numbers turns slot k into block
perm(k mod blocks), another permutation for each pass over the source. Slots and blocks then meet in
a join on the block number, which has no hot keys.

Shard counts are multinomial draws on condition that each source's sum over all shards is its quota
(so a small source meets its target as well as a large one, and none is read more often than its
limit). A shard gets its counts by halving the range of shards from the root of a tree, each
half's share being a hypergeometric draw seeded by the node: every shard finds its own counts, and
the number of its first slot of each source, without seeing any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import free_names, stored
from .words import list_array, mix, slices, words_of

BLOCK = 64
SHARD_SLOTS = 4096
LIMIT = 3
CYCLE = (5.0, 2.0, 1.0)
_MANY = 10**8  # numpy draws hypergeometric counts exactly up to 1e9 in all; beyond, by their normal limit


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of the total by weight; a target stops at limit times its size, the rest shares the excess."""
    total, fixed, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest, weight = total - sum(out[i] for i in fixed), sum(weights[i] for i in free)
        for i in free:
            out[i] = rest * weights[i] / weight if weight else 0.0
        above = [i for i in free if out[i] > limit * sizes[i]]
        if not above:
            return out
        for i in above:
            out[i], fixed = float(limit * sizes[i]), fixed | {i}


def _share(rng: np.random.Generator, own: int, others: int, draws: int) -> int:
    """How many of own things are among draws out of own + others."""
    both = own + others
    if both <= _MANY:
        return int(rng.hypergeometric(own, others, draws))
    mean = draws * own / both
    spread = np.sqrt(mean * (others / both) * ((both - draws) / max(both - 1, 1)))
    return int(np.clip(round(rng.normal(mean, spread)), max(0, draws - others), min(draws, own)))


def shard_counts(quota: list[int], shard: int, slots: int = SHARD_SLOTS, seed: int = 6) -> tuple[list[int], list[int]]:
    """Blocks of each source in one shard, and the number of its first slot of each source."""
    total = sum(quota)
    low, high, counts, first = 0, -(-total // slots), list(quota), [0] * len(quota)
    while high - low > 1:
        middle = (low + high) // 2
        left = (middle - low) * slots
        rng, taken, rest, need = np.random.Generator(np.random.PCG64([seed, low, high])), [], sum(counts), left
        for c in counts:
            rest -= c
            got = _share(rng, c, rest, need) if need else 0
            taken.append(got)
            need -= got
        if shard < middle:
            high, counts = middle, taken
        else:
            low, first = middle, [f + t for f, t in zip(first, taken)]
            counts = [c - t for c, t in zip(counts, taken)]
    return counts, first


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1: a Feistel network, walked until the value is below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for r in range(4):
            a, b = b, a ^ (mix(b + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        return a << np.uint64(half) | b

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __size, the number of words of each whole text (null: 0)."""
    rest = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(words_of(batch.column(text)).first))], names=[*rest, "__size"])

    return docs.mapInArrow(run, docs.withColumn("__size", F.lit(0).cast("long")).schema)


def _utf8_order(sources: list[str | None]) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def plan(rows: DataFrame, cycle: tuple[float, ...] = CYCLE, limit: float = LIMIT, block: int = BLOCK) -> list[dict]:
    """One entry per source: size, target, blocks and quota of blocks. rows: source, size.

    One row per source reaches the driver; sources are kinds of origin, not documents.
    """
    found = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = _utf8_order(list(found))
    sizes = [found[s] or 0 for s in names]
    wanted = targets(sizes, [cycle[i % len(cycle)] for i in range(len(names))], limit)
    out = []
    for i, (name, size, target) in enumerate(zip(names, sizes, wanted)):
        blocks = -(-size // block)
        quota = min(round(target * blocks / size), int(limit * blocks)) if size else 0
        out.append({"number": i, "source": name, "source_size": size, "target": target, "n_blocks": blocks, "quota": quota})
    return out


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def positions(rows: DataFrame, span_rows: int = 20_000) -> DataFrame:
    """Adds first, the words of the source before each row in order of id. rows: row_id, doc_id, source_no, size.

    A running sum in two levels: ranges of ids are cut from the data (their number grows with the
    rows), sums per source and range are added up, and only rows of one range meet in one window.
    """
    n = rows.count()
    parts = max(1, -(-n // span_rows))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("row_id")).withColumn("span", F.spark_partition_id())
    ranged = stored(ranged, "spans")
    sums = ranged.groupBy("source_no", "span").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source_no").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inner = Window.partitionBy("source_no", "span").orderBy(F.col("doc_id").asc_nulls_first(), "row_id").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return within.join(starts, ["source_no", "span"]).withColumn("first", F.col("before") + F.col("inside")).drop("span", "before", "inside")


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Segments of blocks: source_no, block, row_id, word_from, word_to (words of the document)."""
    last = F.col("first") + F.col("size") - 1
    each = rows.where("size > 0").select("source_no", "row_id", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("first"), F.lit(0))
    stop = F.least((F.col("block") + 1) * block - F.col("first"), F.col("size"))
    return each.select("source_no", "block", "row_id", start.alias("word_from"), stop.alias("word_to"))


def slots(spark, sources: list[dict], shard_slots: int = SHARD_SLOTS, seed: int = 6) -> DataFrame:
    """One row per output slot: shard, slot, source_no, epoch (pass over the source), block."""
    quota, sizes = [s["quota"] for s in sources], [s["n_blocks"] for s in sources]
    shards = -(-sum(quota) // shard_slots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                counts, first = shard_counts(quota, int(shard), shard_slots, seed)
                rng = np.random.Generator(np.random.PCG64([seed, 1, int(shard)]))
                order, at = rng.permutation(sum(counts)), 0
                for i, (c, f) in enumerate(zip(counts, first)):
                    k = np.arange(f, f + c)
                    epochs, block = k // max(sizes[i], 1), np.zeros(c, np.int64)
                    for e in np.unique(epochs):
                        own = epochs == e
                        block[own] = permute(k[own] % sizes[i], sizes[i], seed * 1_000_003 + i * 1009 + int(e))
                    if c:
                        yield pd.DataFrame({"shard": shard, "slot": order[at : at + c], "source_no": i, "epoch": epochs, "block": block})
                    at += c

    parts = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 16)))
    return spark.range(0, shards, 1, parts).mapInPandas(run, "shard long, slot long, source_no int, epoch long, block long")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[float, ...] = CYCLE, limit: float = LIMIT, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables: rows, sources, and drawn segments.

    rows: row_id, doc_id, source_no, size. sources: source_no, source, source_size, target, n_blocks,
    quota. drawn: shard, slot, epoch, source_no, block, row_id, word_from, word_to: the words that
    fill each output slot. Sources are ordered by code point, null last, and weigh as the cycle says.
    Null and blank texts have no words and are never drawn; a source without words has target 0.
    Rows with equal ids count one by one, ordered among themselves by their text. Reruns agree.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))
    small = sized(named).select("doc_id", "source", F.xxhash64("text", "source").alias("tie"), F.col("__size").alias("size"))
    small = stored(small, "sizes")
    sources = plan(small, cycle, limit, block)
    schema = "number int, source string, source_size long, target double, n_blocks long, quota long"
    table = spark.createDataFrame([tuple(s.values()) for s in sources], schema).withColumnRenamed("number", "source_no")
    # equal rows are told apart by a count among themselves
    twin = Window.partitionBy("doc_id", "tie").orderBy("size")
    rows = small.join(F.broadcast(table.select("source_no", F.col("source").alias("name"))), _same(F.col("source"), F.col("name"))).withColumn("copy", F.row_number().over(twin))
    rows = rows.select(F.struct("doc_id", "tie", "copy").alias("row_id"), "doc_id", "source_no", "size")
    rows = stored(positions(rows), "rows")
    # both sides grow with the data; the size that Spark guesses for generated slots is far too small
    drawn = slots(spark, sources, shard_slots, seed).join(blocks_of(rows, block).hint("merge"), ["source_no", "block"])
    return rows, table, drawn.select("shard", "slot", "epoch", "source_no", "block", "row_id", "word_from", "word_to")


def taken(rows: DataFrame, sources: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken."""
    words = drawn.groupBy(F.col("row_id").alias("drawn_id")).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    found = rows.join(words, _null_safe(F.col("row_id"), F.col("drawn_id")), "left").select("doc_id", "source_no", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    return found.join(F.broadcast(sources), "source_no").select("doc_id", "size", "source", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _null_safe(a: Column, b: Column) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tie"] == b["tie"]) & (a["copy"] == b["copy"])


def mixed_texts(docs: DataFrame, rows: DataFrame, drawn: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None) -> DataFrame:
    """The mix as documents: one row per document and pass, with the words drawn in that pass.

    A pass that draws every word returns the text unchanged; else the drawn stretches of the text
    are joined by one space. Documents of which nothing was drawn are left out. Columns are those of
    docs; the length column, where named, is counted anew.
    """
    columns = docs.columns
    spans_in, epoch_in, row_in, id_in = free_names(columns, "spans", "epoch", "row", "id")
    pieces = drawn.groupBy("row_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias(spans_in)).withColumn(epoch_in, F.col("epoch"))
    digest = F.xxhash64(F.col(text).cast("string"), F.col(source).cast("string"))
    twin = Window.partitionBy(F.col(key).cast("long"), digest).orderBy(F.xxhash64(*columns))
    # only repeated rows need a number, and whole texts shouldn't move for it otherwise
    repeated = not rows.where("row_id.copy > 1").isEmpty()
    copy = F.row_number().over(twin) if repeated else F.lit(1)
    whole = docs.withColumn(row_in, F.struct(F.col(key).cast("long").alias("doc_id"), digest.alias("tie"), copy.alias("copy")))
    pieces = pieces.select(F.col("row_id").alias(id_in), epoch_in, spans_in)
    joined = whole.join(pieces, _null_safe(F.col(row_in), F.col(id_in))).select(*columns, spans_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = words_of(batch.column(text))
            out = []
            for i, spans in enumerate(batch.column(spans_in).to_pylist()):
                a, b = words.first[i], words.first[i + 1]
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["word_from"]:
                        runs[-1][1] = s["word_to"]
                    else:
                        runs.append([s["word_from"], s["word_to"]])
                if runs == [[0, b - a]]:
                    out.append(words.data[words.offsets[i] : words.offsets[i + 1]].tobytes())
                else:
                    out.append(b" ".join(words.data[words.starts[a + x] : words.ends[a + y - 1]].tobytes() for x, y in runs))
            texts = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in columns], names=columns)

    mixed = joined.mapInArrow(run, docs.schema)
    return mixed.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in columns else mixed
