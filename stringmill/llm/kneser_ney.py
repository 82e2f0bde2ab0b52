"""Interpolated modified Kneser-Ney scoring of texts, with counts made by Spark.

The model is of order two. Spark counts words and word pairs over all training texts; each table is
stored as sorted hash arrays in the shared folder and memory-mapped by the workers, which score
whole texts from it. A word's identifier is its place in the sorted word hashes, a pair's key is
its two identifiers in 64 bits, spread by a one-to-one mixing function: pairs cannot collide.

    p(w | v) = (c(vw) - D(c(vw))) / c(v) + back(v) * q(w)
    q(w)     = (k(w) - E(k(w))) / k      + rest    * 1 / (V + 1)

c counts occurrences, k(w) distinct words in front of w, k all distinct pairs, V distinct words. D
and E take three values each (for counts 1, 2, and 3 or more), estimated from the counts of counts.
back(v) and rest hand on exactly what the discounts took, so all probabilities sum to one; an
unknown word has rest / (V + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hash_files
from .base import id_and_text, stored
from .words import Words, mix, rolling, slices, words_of

END = np.uint64(0x454E44)  # no word hashes to these two but by chance
START = np.uint64(0xFFFFFFFF)  # as an identifier: the context of a text's first token
_GATHER = 1 << 22


def token_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words followed by END, and the first token of each text."""
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hashes(31)
    return out, first


def _summed(batches: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds up (keys, counts) over some millions of keys before rows leave the task."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(counts, new)
        for low in range(0, len(new), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[new[part]].view(np.int64)), pa.array(sums[part])], names=names)

    held, size = [], 0
    for keys, counts in batches:
        if len(keys):
            held.append((keys, counts))
            size += len(keys)
        if size >= _GATHER:
            yield from flush(held)
            held, size = [], 0
    if size:
        yield from flush(held)


@dataclass
class Model:
    """words: hash -> n, cont, ones, twos, more. pairs: mixed key -> n. Totals and discounts."""

    words: hash_files.HashFiles
    pairs: hash_files.HashFiles
    tokens: int
    texts: int
    kinds: int
    pair_kinds: int
    discounts: np.ndarray
    lower: np.ndarray
    start: tuple[int, int, int]
    lower_rest: float

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of each text."""
        hashes, first = token_hashes(words)
        kinds, place = np.unique(hashes, return_inverse=True)
        known, got = self.words.find(kinds, ["id", "n", "cont", "ones", "twos", "more"])
        ids = np.where(known, got["id"].astype(np.uint64), np.uint64(0xFFFFFFFE))
        base = np.log10((got["n"] + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))
        q = self._discounted(got["cont"], self.lower) / max(self.pair_kinds, 1) + self.lower_rest / (self.kinds + 1)
        counts = np.maximum(got["n"], 1)
        back = (got["ones"] * self.discounts[1] + got["twos"] * self.discounts[2] + got["more"] * self.discounts[3]) / counts
        back[got["ones"] + got["twos"] + got["more"] == 0] = 1.0
        # the context of each token: the token before it, START for a text's first
        context = np.zeros(len(hashes), np.int64)
        context[1:] = place[:-1]
        begins = first[:-1]
        keys = np.empty(len(hashes), np.uint64)
        keys[1:] = ids[place[:-1]] << np.uint64(32)
        keys[begins] = START << np.uint64(32)
        keys |= ids[place]
        some, where = np.unique(keys, return_inverse=True)
        seen = self.pairs.find(mix(some), ["n"])[1]["n"]
        top = self._discounted(seen, self.discounts)[where]
        total, share = counts[context], back[context]
        total[begins] = max(self.texts, 1)
        share[begins] = (np.dot(self.start, self.discounts[1:]) / self.texts) if self.texts else 1.0
        p = np.log10(top / total + share * q[place])
        sums = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
        return np.diff(first), sums(known[place].astype(np.int64)), sums(base[place]), sums(p)

    @staticmethod
    def _discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - discounts[np.minimum(counts, 3).astype(np.int64)], 0.0)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0 to 3 and more, from the numbers of things counted once to four times.

    Where a number is missing (tiny corpora) the estimate falls back to a discount of one half per
    step, and it always stays between 0 and the count.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    steps = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    got = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in steps]
    return np.array([0.0, *(min(max(d, 0.01), k - 0.01) for d, k in zip(got, (1, 2, 3)))])


def _identified(counts: DataFrame, words: hash_files.HashFiles, starts: dict[int, int]) -> DataFrame:
    """The word counts with their identifiers: the place of the hash in the sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_places(words, starts, hashes)), batch.column("hash"), batch.column("n")], names=["id", "hash", "n"])

    return counts.mapInArrow(run, "id long, hash long, n long")


def _places(words: hash_files.HashFiles, starts: dict[int, int], hashes: np.ndarray) -> np.ndarray:
    """Places of hashes that are all in the table."""
    shards = (hashes >> np.uint64(64 - words.bits)).astype(np.int64)
    out = np.zeros(len(hashes), np.int64)
    for shard in np.unique(shards):
        own = shards == shard
        out[own] = starts[int(shard)] + np.searchsorted(words.column("hash", int(shard)), hashes[own])
    return out


def fit(docs: DataFrame) -> Model:
    """Counts doc_id, text rows: every row teaches, repeated rows again; null texts count as empty."""

    def words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in slices(batches, "text"):
                hashes, _ = token_hashes(words_of(batch.column("text"), lower=True))
                yield np.unique(hashes, return_counts=True)

        yield from _summed(each(), ["hash", "n"])

    texts = docs.select("text")
    counted = stored(texts.mapInArrow(words_in, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    kinds, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_texts = texts.count()
    if kinds >= 2**32 - 2:
        raise ValueError("more than 2**32 distinct words: pair keys hold 32 bits for each")
    places = hash_files.write(counted.select("hash"), "word-places", kinds)
    starts, at = {}, 0
    for shard in sorted(places.counts):
        starts[shard], at = at, at + places.counts[shard]

    def pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in slices(batches, "text"):
                hashes, first = token_hashes(words_of(batch.column("text"), lower=True))
                some, where = np.unique(hashes, return_inverse=True)
                ids = _places(places, starts, some).astype(np.uint64)[where]
                keys = ids.copy()
                keys[1:] |= ids[:-1] << np.uint64(32)
                keys[first[:-1]] = ids[first[:-1]] | START << np.uint64(32)
                yield np.unique(keys, return_counts=True)

        yield from _summed(each(), ["pair", "n"])

    pairs = stored(texts.mapInArrow(pairs_in, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    context, word = F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    one, two, more = ((F.col("n") == 1), (F.col("n") == 2), (F.col("n") >= 3))
    sums = pairs.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)), F.count("*")).first()
    # each pair counts once for its context and once for its word
    sides = F.explode(F.array(F.struct(context.alias("id"), one.cast("int").alias("ones"), two.cast("int").alias("twos"), more.cast("int").alias("more"), F.lit(0).alias("cont")), F.struct(word.alias("id"), F.lit(0).alias("ones"), F.lit(0).alias("twos"), F.lit(0).alias("more"), F.lit(1).alias("cont"))))
    sides = pairs.select(sides.alias("s")).select("s.*").groupBy("id").agg(*(F.sum(c).cast("int").alias(c) for c in ("ones", "twos", "more", "cont")))
    full = stored(_identified(counted, places, starts).join(sides, "id", "full").select("id", "hash", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cont", "ones", "twos", "more"))), "sides")
    start = full.where("hash is null").select("ones", "twos", "more").first() or (0, 0, 0)
    known = full.where("hash is not null")
    low = known.agg(*(F.count_if(F.col("cont") == k) for k in (1, 2, 3, 4)), F.count_if(F.col("cont") >= 3)).first()

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column("pair").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("n").cast(pa.int32())], names=["hash", "n"])

    lower = discounts(*low[:4])
    rest = (lower[1] * low[0] + lower[2] * low[1] + lower[3] * low[4]) / sums[4] if sums[4] else 1.0
    word_files = hash_files.write(known, "word-counts", kinds)
    pair_files = hash_files.write(pairs.mapInArrow(mixed, "hash long, n int"), "pair-counts", sums[4])
    return Model(word_files, pair_files, tokens, n_texts, kinds, sums[4], discounts(*sums[:4]), lower, tuple(start), float(rest))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of non-space bytes with A-Z in lower case; each text ends with an end token, so
    null and empty texts have one token. Scores are log10 of the whole text's probability; its
    perplexity is 10 ** (-score / n_tokens). Without training texts every token is unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, known, base, own = model.scores(words_of(batch.column("text"), lower=True))
            arrays = [batch.column("doc_id"), *map(pa.array, (n.astype(np.int64), known.astype(np.int64), np.full(len(n), model.tokens, np.int64), base, own))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return id_and_text(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
