"""Operators on whole corpora against brute-force versions: duplicates, passages, mixture, neighbours, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from stringmill.llm import chunks, minhash, mixture, neighbours, quality, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, bucket int, label string"


def words(text):
    return WORD.findall((text or "").encode())


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, blanks, repeated rows and null ids."""
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = line(60), []
    for i in range(40):
        own = line(rng.choice([2, 20, 90, 200]))
        rows.append(" ".join(own))
        if i % 4 == 0:
            rows.append(" ".join(own))
        if i % 3 == 0:
            near = list(own)
            near[rng.randrange(len(near))] = "changed"
            rows.append("  ".join(near).upper() if i % 2 else " ".join(near))
        if i % 5 == 0:
            rows.append(" ".join(line(30) + passage + line(i)))
    rows += [None, "", " \n ", "one", "One two", "one two", " ".join(line(3000)), " ".join(passage * 3)]
    table = [(i * 7 % 1009, t, rng.choice(["a", "b", "é", None]), 1, "x") for i, t in enumerate(rows)]
    table += [table[5], table[5], (None, "no id", None, 1, "x"), (None, None, "a", 1, "x")]
    return spark.createDataFrame(table, SCHEMA)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(corpus, bits):
    groups = defaultdict(list)
    for doc_id, text in pairs_of(corpus):
        groups[text or ""].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        most = max(ids, key=lambda i: -1 if i is None else i)
        for i, n in Counter(ids).items():
            for k in range(n):
                want[i, most, len(ids), i == most and k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = chunks.exact_groups(corpus, mean=64, bits=bits).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert chunks.exact_groups(corpus.limit(0)).count() == 0


def shingles(text, n):
    own = [w.lower() for w in words(text)]
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)} if own else set()


def near_brute(rows, n, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, n))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = sorted((find(a), find(b)))
                top[v] = u
    return Counter((i, len(shingles(t, n)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in rows)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_near_groups(corpus, n, percent):
    assert Counter(map(tuple, minhash.near_groups(corpus, n=n, percent=percent).collect())) == near_brute(pairs_of(corpus), n, percent)


def test_near_groups_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert Counter(map(tuple, minhash.near_groups(docs).collect())) == near_brute(pairs_of(docs), 5, 80)
    assert minhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "mapped"), [(35, 1 << 28), (8, 1 << 28), (35, 0)])
def test_passages(corpus, n, mapped):
    rows = pairs_of(corpus)
    seen = Counter(tuple(w[i : i + n]) for _, t in rows for w in [words(t)] for i in range(len(w) - n + 1))
    want = Counter()
    for doc_id, text in rows:
        own = words(text)
        gone = {j for i in range(len(own) - n + 1) if seen[tuple(own[i : i + n])] > 1 for j in range(i, i + n)}
        want[doc_id, len(own), len(gone), b" ".join(w for j, w in enumerate(own) if j not in gone).decode()] += 1
    assert Counter(map(tuple, substrings.without_repeats(corpus, n=n, mapped_rows=mapped).collect())) == want
    assert substrings.without_repeats(corpus.limit(0), n=n).count() == 0


def test_targets_stop_at_the_limit():
    assert mixture.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75.0, 37.5])
    assert mixture.targets([10, 1000], [5, 2]) == pytest.approx([30.0, 980.0])
    assert mixture.targets([0, 8], [5, 2]) == pytest.approx([0.0, 8.0])
    assert mixture.targets([], []) == []


def test_shards_share_out_each_quota_and_permutations_are_whole():
    quota = [1000, 37, 0, 4000]
    shards = -(-sum(quota) // 64)
    made = [mixture.shard_counts(quota, s, 64) for s in range(shards)]
    assert np.sum([c for c, _ in made], 0).tolist() == quota
    assert all(sum(c) == 64 for c, _ in made[:-1])
    assert [f for _, f in made] == [list(np.sum([c for c, _ in made[:s]], 0)) if s else [0] * 4 for s in range(shards)]
    for n in (1, 2, 3, 100, 1025):
        assert sorted(mixture.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_mixture(corpus):
    rows, sources, drawn = mixture.mix_sources(corpus, block=8)
    got = mixture.taken(rows, sources, drawn).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in pairs_of(corpus))
    per = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
    names = [*sorted(s for s in per if s is not None), None]
    wanted = mixture.targets([per[s][0] for s in names], [5.0, 2.0, 1.0, 5.0])
    for name, target in zip(names, wanted):
        assert abs(per[name][1] - target) <= max(0.05 * target, 16)
        own = [r for r in got if r["source"] == name]
        assert {r["source_size"] for r in own} == {per[name][0]}
        assert all(r["target"] == pytest.approx(target) for r in own)
    again = mixture.taken(*mixture.mix_sources(corpus.repartition(5), block=8)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_texts_hold_the_drawn_words(corpus):
    rows, sources, drawn = mixture.mix_sources(corpus, block=8)
    counts = Counter()
    for r in mixture.mixed_texts(corpus, rows, drawn).collect():
        counts[r["doc_id"]] += len(words(r["text"]))
    taken = Counter()
    for r in mixture.taken(rows, sources, drawn).collect():
        taken[r["doc_id"]] += r["taken"]
    assert +counts == +taken


def test_mixture_of_nothing(corpus):
    assert mixture.taken(*mixture.mix_sources(corpus.limit(0))).count() == 0
    assert {r["taken"] for r in mixture.taken(*mixture.mix_sources(corpus.where("text is null"))).collect()} == {0}


def nearest_brute(table, asked, k):
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = x @ x[list(ids).index(i)]
        out[i] = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
    return out


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    table = [(i, (centres[rng.integers(30)] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    table += [(3000 + i, table[0][1]) for i in range(300)]  # one vector very often
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = nearest_brute(table, list(got), 5)
    assert len(got) == 66 and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in got]) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [3.0, 0.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 2, 0.0)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 4"), df).count() == 0


def test_neighbours_of_each_length_and_recall_on_given_vectors(spark):
    rng = np.random.default_rng(4)
    table = [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(400)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 50 < 2")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 16
    for parity in (0, 1):
        some = [r for r in table if r[0] % 2 == parity]
        want = nearest_brute(some, [q for q in got if q % 2 == parity], 5)
        assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = neighbours.usable(given, "vec_id", "embedding")
    index = neighbours.fit(rows, 64, rows.count())
    assert len(index.centroids) > 30
    got = defaultdict(list)
    for r in neighbours.search(given, given.where("vec_id % 50 = 0"), index=index).collect():
        got[r["query_id"]].append(r["vec_id"])
    want = nearest_brute([tuple(r) for r in given.select("vec_id", "embedding").collect()], list(got), 5)
    assert len(got) == 40 and np.mean([len(set(got[q]) & set(want[q])) / 5 for q in got]) >= 0.9


def test_near_dedup_stage_judges_texts_under_one_id_apart(spark):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long), (2, long + " end"), (2, "another text under the second id"), (3, "third text stands alone here"), (None, long), (0, long + " tail")]
    left = corpus_pipeline.unlike_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR)
    assert {tuple(r) for r in left.collect()} == {rows[i] for i in (2, 3, 4, 5)}


def test_pipeline_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    left, texts = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [i for i, s in scores.items() if s >= corpus_pipeline.LEAST_SCORE]
    last = {}
    for i in sorted(ids):
        last[texts[i] or ""] = i
    once = sorted(last.values())
    near = near_brute([(i, texts[i]) for i in once], 5, 80)
    wanted = [set(ids), set(once), {r[0] for r in near if r[3]}]
    for (_, stage), want in zip(corpus_pipeline.STAGES, wanted):
        left = stage(spark, left, SF_DIR).cache()
        assert left.columns == docs.columns
        assert sorted(r["doc_id"] for r in left.collect()) == sorted(want)
    mixed = corpus_pipeline.STAGES[3][1](spark, left, SF_DIR).cache()
    assert mixed.columns == docs.columns
    coded = {(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.STAGES[4][1](spark, mixed, SF_DIR).collect()}
    assert coded == {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in mixed.collect()}
    assert corpus_pipeline.run(spark, SF_DIR).count() == mixed.count()
