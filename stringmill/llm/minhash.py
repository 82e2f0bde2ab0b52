"""Near duplicates: one-permutation MinHash with optimal densification, bands, star-shaped links.

1. One pass makes each document's shingle set and keeps its size, a 128-bit digest of the set, and
   the band hashes of its signature. Documents with equal sets become one class, represented by its
   smallest id; copies never meet in pairs.
2. Classes that share a bucket are candidates. In each bucket all members are linked with one centre
   only, and every link is confirmed on the full sets of both texts.
3. Confirmed links give components. A bucket whose members all fell into one component is settled.
   In the others, pairs whose ends lie in different components are compared too, block by block
   inside tasks, and only links that join components come out: stars save work, they lose no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, stored
from .components import components
from .words import Words, list_array, mix, rolling, slices, words_of

ROWS = 5
MISS = 1e-6
TRIES = 256
BLOCK = 512
BLOCK_SHINGLES = 1 << 22


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair of exactly this similarity shares none with probability miss."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text."""
    single = words.hashes(11)
    wide, inside = words.windows(single, n, 12)
    out = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= n:
            out.append(np.unique(wide[a : b - n + 1]))
        elif b > a:
            out.append(rolling(12).spans(single[a:b], np.zeros(1, int), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(64)
def _attempts(bins: int, block: int) -> np.ndarray:
    """Where each empty bin looks at its attempts TRIES * block, ...: a fixed hash of bin and attempt."""
    t = np.arange(TRIES, dtype=np.uint64)[:, None] + np.uint64(TRIES * block)
    return (mix(t * np.uint64(bins) + np.arange(bins, dtype=np.uint64) + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin; an empty bin borrows from the bin that its own hash draws."""
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[bin_of[first]], full[bin_of[first]] = hashes[first], True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        draws = _attempts(bins, block)[:, empty]
        hit = full[draws]
        found = hit.any(0)
        out[empty[found]] = out[draws[hit.argmax(0)[found], np.flatnonzero(found)]]
        empty, block = empty[~found], block + 1
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, set_key (null: no words), buckets array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column("text"), lower=True), n)
            some = [s for s in sets if len(s)]
            table = np.stack([signature(s, bands * rows) for s in some]) if some else np.zeros((0, bands * rows), np.uint64)
            h = np.zeros((len(some), bands), np.uint64)
            for i in range(rows):
                h = mix(h + table[:, i::rows])
            h = mix(h + np.arange(bands, dtype=np.uint64))
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            ends = np.append(0, np.cumsum((sizes > 0) * bands))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), keys, list_array(pa.array(h.ravel().view(np.int64)), ends)], names=["doc_id", "n_shingles", "set_key", "buckets"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs a, b whose full shingle sets meet the threshold; texts: rep, text of all ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in slices(slices(batches, "text_b"), "text_a"):
            ids = batch.column("a").to_numpy()
            new = np.append(True, ids[1:] != ids[:-1])  # the join delivers the pairs of an end together
            left = shingle_sets(words_of(batch.column("text_a").filter(pa.array(new)), lower=True), n)
            right = shingle_sets(words_of(batch.column("text_b"), lower=True), n)
            good = np.zeros(len(ids), bool)
            for i, (k, other) in enumerate(zip(np.cumsum(new) - 1, right)):
                own = left[k]
                if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                    both = np.sort(np.concatenate([own, other]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    good[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    of = lambda end: texts.select(F.col("rep").alias(end), F.col("text").alias(f"text_{end}"))
    return pairs.join(of("b").hint("merge"), "b").join(of("a").hint("merge"), "a").select("a", "text_a", "b", "text_b").mapInArrow(run, "a long, b long")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, rep, n and component of the members of buckets that still hold several components.

    Also block, the members' part of a large bucket, and blocks, their number. Blocks grow with the
    root of the bucket, so that the copies of a member do too, and shrink where sets are large.
    """
    rows = members.join(labels.hint("merge"), members.rep == labels.node, "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    state = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.max("n").alias("largest")).where("low < high")
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(BLOCK * 16), F.sqrt("m") * 16))
    size = F.greatest(F.lit(16), F.least(size, F.lit(BLOCK_SHINGLES) / F.col("largest")))
    blocks = F.ceil(F.col("m") / size).cast("int")
    open_ = stored(state.select("bucket", blocks.alias("blocks")), "open")
    found = rows.join(open_.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks").cast("long")).cast("int"))
    return found.select("rep", "bucket", "component", "block", "blocks")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the values that both sides hold."""
    sides = []
    for sets in (left, right):
        values = np.concatenate(sets)
        sides.append((values, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = np.flatnonzero(shared[at] == values) if len(shared) else np.zeros(0, int)
        order = hit[np.argsort(at[hit], kind="stable")]
        places.append((at[order], owner[order]))
    for low in range(0, len(shared), 4096):
        parts = []
        for (at, owner), sets in zip(places, (left, right)):
            a, b = np.searchsorted(at, [low, low + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], at[a:b] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _joins(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between components only those that join two that were apart before."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = top(x), top(y)
        if u != v:
            above[u] = v
            out.append((x, y))
    return out


def across(open_members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links a, b between components, from all pairs of a bucket that lie in different components.

    Every pair of blocks is one group of bounded size; pairs are compared inside it and only links
    that join components leave it.
    """
    with_text = open_members.join(texts.hint("merge"), "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = with_text.withColumn("other", other).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "text")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sets = []
        for batch in slices(rows.select(["text"]).to_batches(), "text"):
            sets += shingle_sets(words_of(batch.column("text"), lower=True), n)
        block, component = rows.column("block").to_numpy(), rows.column("component").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            common = _common([sets[x] for x in left], [sets[x] for x in right]).astype(np.int64)
            sizes = np.array([len(x) for x in sets])
            union = sizes[left][:, None] + sizes[right][None, :] - common
            good = (100 * common >= percent * union) & (component[left][:, None] != component[right][None, :])
            x, y = np.nonzero(good)
            links = _joins(component[left][x], component[right][y])
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of non-space bytes with A-Z in lower case; a text with fewer than n words is one
    shingle. Two documents are linked when 100 * |intersection| >= percent * |union|. component_id
    is the smallest id reachable over links, kept is doc_id = component_id. Null, empty and blank
    texts have no shingles and stay alone. A row with a null id links with nothing: it is kept, and
    its component_id is null. Repeated rows of one id all carry the same result.
    """
    rows = id_and_text(docs, key, text)
    made = stored(signatures(rows, n, band_count(percent, miss=miss)), "signatures")
    used = made.where("set_key is not null and doc_id is not null")
    classes = stored(used.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")), "classes")
    bucketed = classes.select("rep", "n", F.explode("buckets").alias("bucket")).distinct()
    shared = bucketed.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("most")).where("centre < most").select("bucket", "centre")
    members = stored(bucketed.join(shared.hint("merge"), "bucket").select("bucket", "rep", "n", "centre"), "members")
    wanted = members.select("rep").distinct()
    texts = stored(rows.join(wanted.hint("merge"), rows.doc_id == wanted.rep, "left_semi").select(F.col("doc_id").alias("rep"), "text"), "candidates")
    links = stored(confirm(members.where("centre <> rep").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), texts, n, percent), "links")
    labels = stored(components(links), "labels")
    more = stored(across(_open_members(members.select("bucket", "rep", "n"), labels), texts, n, percent), "links")
    if not more.isEmpty():
        above = components(more).select(F.col("node").alias("component"), F.col("component").alias("top"))
        found = labels.join(above.hint("merge"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        # components of one document have no label of their own yet
        alone = above.join(labels.select(F.col("component")).distinct(), "component", "left_anti")
        labels = found.unionAll(alone.select(F.col("component").alias("node"), F.col("top").alias("component")))
    by_class = classes.select("set_key", "rep").join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    found = made.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(by_class.hint("merge"), "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
