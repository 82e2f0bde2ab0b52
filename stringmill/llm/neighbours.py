"""Approximate nearest neighbours by balanced posting lists.

A bounded sample gives centroids (balanced splitting until parts are small), about as many as the
root of the number of rows. Every vector is posted to its nearest centroid and, near a boundary, to others
nearly as near. Centroids are found by best-first search in a neighbour graph held in memory. A query
reads the lists whose centroid is not much farther than its nearest one. How many replicas a vector
has and how far a query reads are measured: PROBES rows of the sample are compared with ALL rows in
one map over the table, and of the settings that find RECALL of their true neighbours the one that
reads the fewest rows is taken (more replicas where that costs at most a quarter more).
Clustered vectors need few lists; vectors without any structure need many. Lists are dealt to tasks in
blocks of bounded size, and so are the queries that read them: a list that holds a third of all
vectors is many blocks. Vectors of each length are searched apart.

What reaches the driver or every worker is the sample (at most SAMPLE_PER rows for each of at most
MAX_CENTROIDS centroids), the centroids, their graph, the neighbours of PROBES rows, and one number
per centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stored
from .words import list_array

LISTS_PER_ROOT = 1
MAX_CENTROIDS = 16384
SAMPLE_PER = 32
REPLICAS = 4
REPLICA_RATIO = 1.2
RECALL = 0.97
PROBES = 128
BEAM = 64
LINKS = 16
BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def balanced_centroids(x: np.ndarray, leaf: int, seed: int = 2) -> np.ndarray:
    """Splits unit vectors until each part holds at most leaf of them; returns the parts' means."""
    rng, out, parts = np.random.Generator(np.random.PCG64(seed)), [], [np.arange(len(x))]
    while parts:
        own = parts.pop()
        k = min(16, -(-len(own) // leaf))
        labels = np.zeros(len(own), int)
        if k > 1:
            means = x[rng.choice(own, k, replace=False)]
            for _ in range(6):
                labels = (x[own] @ means.T - 0.5 * (means * means).sum(1)).argmax(1)
                sums = np.zeros_like(means)
                np.add.at(sums, labels, x[own])
                sizes = np.bincount(labels, minlength=k)
                means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], means)
        kinds = np.unique(labels)
        if len(kinds) == 1:  # small enough, or copies of one vector
            out.append(x[own].mean(0))
        else:
            parts += [own[labels == i] for i in kinds]
    return np.array(out, np.float32)


@dataclass
class Index:
    """Centroids with their graph, and how far beyond the nearest centroid a query reads."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    dim: int
    replicas: int = 1
    ratio: float = 1.5
    reach: int = BEAM

    @classmethod
    def build(cls, centroids: np.ndarray, seed: int = 3) -> Index:
        n = len(centroids)
        rng = np.random.Generator(np.random.PCG64(seed))
        k = min(LINKS, n - 1)
        links = np.zeros((n, k + min(4, n)), np.int64)
        norms = (centroids * centroids).sum(1)
        for low in range(0, n, 1024):
            d = norms - 2 * centroids[low : low + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
            if k:
                links[low : low + 1024, :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
        links[:, k:] = rng.integers(0, n, (n, min(4, n)))  # far links keep the graph in one piece
        return cls(centroids, links, rng.permutation(n)[: min(n, 48)], centroids.shape[1])

    def nearest(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each vector, nearest first, with squared distances (inf: none left).

        Where a good part of all centroids is asked for, all distances are computed: no search is shorter.
        """
        if 4 * beam >= len(self.centroids):
            gaps = np.maximum((self.centroids**2).sum(1) - 2 * x @ self.centroids.T + (x * x).sum(1, keepdims=True), 0)
            order = gaps.argsort(1, kind="stable")[:, :beam]
            return order, np.take_along_axis(gaps, order, 1)
        rows = max(1, (8 << 20) // max(len(self.centroids), 1))
        parts = [self._search(x[low : low + rows], beam) for low in range(0, len(x), rows)]
        return tuple(map(np.concatenate, zip(*parts)))

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, norms = len(x), (self.centroids * self.centroids).sum(1)
        beam, lines = max(beam, len(self.entries)), np.arange(n)[:, None]
        seen = np.zeros((n, len(self.centroids)), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        gaps = norms[self.entries] - 2 * x @ self.centroids[self.entries].T
        seen[lines, ids] = True
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids, gaps = np.pad(ids, ((0, 0), (0, pad))), np.pad(gaps, ((0, 0), (0, pad)), constant_values=np.inf)
        done = np.isinf(gaps)
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], np.inf, gaps[live])
            best = open_.argmin(1)
            going = np.isfinite(open_[np.arange(len(live)), best])
            live, best = live[going], best[going]
            if not len(live):
                break
            done[live, best] = True
            near = self.links[ids[live, best]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            d = norms[near] - 2 * np.einsum("qrd,qd->qr", self.centroids[near], x[live])
            # a link listed twice for one centroid counts once
            order = np.argsort(near, 1, kind="stable")
            twice = np.zeros(near.shape, bool)
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(near, order, 1)) == 0, 1)
            d[~fresh | twice] = np.inf
            all_ids, all_d = np.concatenate([ids[live], near], 1), np.concatenate([gaps[live], d], 1)
            all_done = np.concatenate([done[live], np.isinf(d)], 1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[live], gaps[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_d, all_done))
        order = gaps.argsort(1, kind="stable")
        gaps = np.take_along_axis(gaps, order, 1) + (x * x).sum(1, keepdims=True)
        return np.take_along_axis(ids, order, 1), np.maximum(gaps, 0)

    def postings(self, x: np.ndarray, replicas: int | None = None) -> list[np.ndarray]:
        """Lists of each vector: the nearest centroid, and others nearly as near."""
        replicas = replicas or self.replicas
        ids, gaps = self.nearest(x, max(16, 2 * replicas))
        ids, gaps = ids[:, :replicas], gaps[:, :replicas]
        chosen = np.isfinite(gaps) & (gaps <= REPLICA_RATIO**2 * gaps[:, :1] + 1e-9)
        chosen[:, 0] = True
        return [row[keep] for row, keep in zip(ids, chosen)]

    def probes(self, x: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists that each query reads: those within the ratio, and at least so many that they hold k rows well over."""
        ids, gaps = self.nearest(x, max(BEAM, self.reach))
        held = np.cumsum(np.where(np.isfinite(gaps), sizes[ids], 0), 1) - sizes[ids]
        keep = np.isfinite(gaps) & ((gaps <= self.ratio**2 * gaps[:, :1] + 1e-9) | (held < 20 * k + 20))
        return [row[some] for row, some in zip(ids, keep)]

    def calibrate(self, asked: np.ndarray, near: list[np.ndarray], sample: np.ndarray, recall: float = RECALL) -> None:
        """Sets replicas, ratio and reach from queries, the true neighbours of each, and a sample of the rows."""
        gaps = np.maximum((self.centroids**2).sum(1) - 2 * asked @ self.centroids.T + (asked * asked).sum(1, keepdims=True), 0)
        least = gaps.min(1, keepdims=True)
        owner = np.repeat(np.arange(len(near)), [len(v) for v in near])
        costs = []
        for replicas in range(1, REPLICAS + 1):
            need = [np.sqrt((gaps[i, lists].min() + 1e-9) / (least[i, 0] + 1e-9)) for i, lists in zip(owner, self.postings(np.concatenate(near), replicas))]
            ratio = float(np.quantile(need, recall)) * 1.001
            inside = gaps <= ratio**2 * least + 1e-9
            held = np.bincount(np.concatenate(self.postings(sample, replicas)), minlength=len(self.centroids))
            costs.append(((inside @ held).mean(), replicas, ratio, int(1.2 * inside.sum(1).max()) + 8))
        limit = 1.25 * min(costs)[0]
        _, self.replicas, self.ratio, reach = max((c for c in costs if c[0] <= limit), key=lambda c: c[1])
        self.reach = min(len(self.centroids), reach)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (floats stay floats, all else is double): rows that can be compared. Null, zero or non-finite vectors drop out."""
    kind = "array<float>" if vectors.select(vector).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def true_neighbours(rows: DataFrame, asked: tuple[np.ndarray, np.ndarray], k: int) -> list[np.ndarray]:
    """The k nearest vectors of each of some queries (ids, vectors), from all rows: one map, k rows a query from each task."""
    ids, q = asked
    dim, kind = q.shape[1], rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, best = np.zeros(0, np.int64), np.zeros((0, dim)), None
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(low, BLOCK_ROWS)
                # the best so far stand for all rows before this block
                held_ids = np.concatenate([held_ids, batch.column("vec_id").to_numpy()])
                held = np.concatenate([held, _matrix(batch.column("v"), dim)])
                held_ids, first = np.unique(held_ids, return_index=True)
                held = held[first]
                best = top_pairs(asked, (held_ids, held), k)
                keep = np.unique(np.searchsorted(held_ids, best[1]))
                held_ids, held = held_ids[keep], held[keep]
        if best is not None and len(best[0]):
            at = np.searchsorted(held_ids, best[1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size * dim + 1, dim), pa.int32()), pa.array(held[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), lists.cast(pa.list_(pa.float32() if kind == "array<float>" else pa.float64()))], names=["query_id", "vec_id", "score", "v"])

    found = rows.mapInArrow(run, f"query_id long, vec_id long, score double, v {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near: dict[int, list] = {}
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect():
        near.setdefault(r["query_id"], []).append(r["v"])
    return [_unit(np.array(near[i], float)) if i in near else np.zeros((0, dim), np.float32) for i in ids.tolist()]


def fit(rows: DataFrame, dim: int, n: int, k: int = 5, lists_per_root: float = LISTS_PER_ROOT, max_centroids: int = MAX_CENTROIDS) -> Index:
    """Index for n usable rows, all of length dim: centroids from a bounded sample, settings from true neighbours."""
    many = int(max(1, min(max_centroids, lists_per_root * n**0.5, n // 16)))
    most = many * SAMPLE_PER + PROBES
    some = rows
    if n > most:  # a hash of the id decides, a little generously; then the smallest hashes
        share = min(1.0, 1.2 * most / n + 100 / n)
        some = some.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "v").toArrow().combine_chunks()
    exact = np.concatenate([_matrix(b.column("v"), dim) for b in sample.to_batches() if b.num_rows])
    x = _unit(exact)
    # a row is nearer to a mean of which it is part: as many probes shape the centroids as of all rows do
    own = x[int(PROBES * (1 - len(x) / n)) :] if len(x) > 2 * PROBES else x
    index = Index.build(balanced_centroids(own, max(1, -(-len(own) // many))))
    if len(index.centroids) > 1:
        ids, first = np.unique(sample.column("vec_id").to_numpy()[:PROBES], return_index=True)
        near = true_neighbours(rows, (ids, exact[first]), k)
        used = [i for i, v in enumerate(near) if len(v)]
        if used:
            index.calibrate(x[first][used], [near[i] for i in used], own)
    return index


def _posted(rows: DataFrame, index: Index, lists, name: str) -> DataFrame:
    """vec_id, v, lists (the lists that lists(x) names): one row for each vector, written once."""
    dim, kind = index.dim, rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                found = lists(_unit(_matrix(batch.column("v"), dim)))
                named = list_array(pa.array(np.concatenate(found), pa.int32()), np.append(0, np.cumsum([len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), named], names=["vec_id", "v", "lists"])

    return stored(rows.mapInArrow(run, f"vec_id long, v {kind}, lists array<int>"), name)


def _sizes(posted: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for r in posted.select(F.explode("lists").alias("centroid")).groupBy("centroid").count().collect():
        out[r["centroid"]] = r["count"]
    return out


def top_pairs(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query (query, row, cosine), ties to smaller ids, own id left out.

    Products of matrices shortlist; the cosine itself is then summed pair by pair, so that equal
    vectors get equal values wherever they stand.
    """
    (q_ids, q), (r_ids, r) = queries, rows
    scale = lambda m: m / np.abs(m).max(1, keepdims=True)
    q, r = scale(q), scale(r)
    q_norm, r_norm = np.sqrt((q * q).sum(1)), np.sqrt((r * r).sum(1))
    rough = (q @ r.T) / q_norm[:, None] / r_norm[None, :]
    rough[q_ids[:, None] == r_ids[None, :]] = -np.inf
    limit = np.partition(rough, max(len(r) - k, 0), axis=1)[:, max(len(r) - k, 0)][:, None] if len(r) > k else np.full((len(q), 1), -np.inf)
    i, j = np.nonzero((rough >= limit - 1e-9) & np.isfinite(rough))
    exact = np.concatenate([(q[i[a : a + 65536]] * r[j[a : a + 65536]]).sum(1) for a in range(0, max(len(i), 1), 65536)]) / (q_norm[i] * r_norm[j])
    order = np.lexsort((r_ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return q_ids[i[keep]], r_ids[j[keep]], exact[keep]


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, index: Index | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row, by cosine.

    queries has the columns of vectors. A row whose id is the query's own is no candidate; repeated
    rows of one id count once, with the best score. Ties go to the smaller id. Rows with a null id,
    and vectors that are null, zero, empty or hold null or non-finite components, take no part.
    Vectors of other lengths than a query's are no candidates; each length has an index of its own
    (index, if given, serves its own length). Without usable rows the result is empty.
    """
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    found = [_searched(rows.where(F.size("v") == r["dim"]), asked.where(F.size("v") == r["dim"]), index if index and index.dim == r["dim"] else None, r["dim"], r["count"], k) for r in rows.groupBy(F.size("v").alias("dim")).count().collect()]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = reduce(DataFrame.unionAll, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, asked: DataFrame, index: Index | None, dim: int, count: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block for the queries that read it; all vectors of one length."""
    index = index or fit(rows, dim, count, k)
    n = len(index.centroids)
    posted = _posted(rows, index, index.postings, "postings")
    sizes = _sizes(posted, n)
    reading = _posted(asked, index, lambda x: index.probes(x, sizes, k), "readings")
    readers = _sizes(reading, n)
    spark = rows.sparkSession
    parts = spark.createDataFrame([(i, int(-(-a // BLOCK_ROWS)) or 1, int(-(-b // BLOCK_QUERIES)) or 1) for i, (a, b) in enumerate(zip(sizes, readers)) if a and b] or [(-1, 1, 1)], "centroid int, blocks int, turns int")
    parts = F.broadcast(parts)  # one row per centroid: bounded by MAX_CENTROIDS

    def dealt(table: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), F.col(own_parts).cast("long")).cast("int").alias(own)
        posts = table.select("vec_id", "v", F.explode("lists").alias("centroid"))
        return posts.join(parts, "centroid").select("centroid", "vec_id", "v", number, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)).alias(other))

    lists = dealt(posted, "block", "blocks", "turn", "turns").groupBy("centroid", "block", "turn")
    asking = dealt(reading, "turn", "turns", "block", "blocks").groupBy("centroid", "block", "turn")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            sides = [(t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks(), dim)) for t in (right, left)]
            out = top_pairs(*sides, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    return lists.cogroup(asking).applyInArrow(compare, "query_id long, vec_id long, score double")
