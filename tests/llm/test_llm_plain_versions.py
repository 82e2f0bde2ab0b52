"""Models, mixture and pipeline stages against versions made of plain dictionaries and loops."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stringmill.llm import hash_files, language, mixture, quality
from stringmill.llm.base import free_names
from stringmill.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").encode())


def test_quality_equals_a_plain_version(spark):
    rng = random.Random(8)
    names = ["red", "green", "blue", "stone", "Cat", "dog", "über", "x", "12", "so-so", "the", "of"]
    texts = [" ".join(rng.choice(names) for _ in range(rng.randrange(25))) for _ in range(50)] + [None, "", "never seen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {i: rng.randrange(2) for i in range(50)}
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    order = [r["doc_id"] for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]

    def counted(text):
        own = words(text)
        pairs = [("pair", a, b) if a != b else ("twice",) for a, b in zip(own, own[1:])]
        return Counter([("word", w) for w in own] + pairs + [("tail", w[-2:] if len(w) > 1 else w * 2) for w in own])

    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= 0.002:
            return 0.0
        return (math.copysign(0.002, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) / 0.3 + 0.02)

    shuffle = np.random.Generator(np.random.PCG64(8))
    for _ in range(4):
        for i in shuffle.permutation(len(order)):
            kinds = counted(texts[order[i]])
            x = {k: float(np.float32(c * (16 / kinds.total()))) for k, c in kinds.items()} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            wrong = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - labels[order[i]]
            for k, v in x.items():
                g = wrong * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.3 * w[k]
                n[k] += g * g
    for r in quality.score(docs, quality.fit(docs, marked)).collect():
        kinds = counted(r["text"])
        mean = sum(weight(k) * c for k, c in kinds.items()) / max(kinds.total(), 1)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-weight("bias") - 16 * mean)), abs=1e-4)


def test_language_equals_a_plain_version(spark):
    rng = random.Random(3)
    vocabulary = {"de": ["der", "hund", "und", "Katze", "nicht"], "en": ["the", "dog", "and", "cat", "Not"], "ru": ["кот", "и", "собака", "не", "dog"]}
    taught = [(" ".join(rng.choice(v) for _ in range(12)), k) for k, v in vocabulary.items() for _ in range(6)]
    every = [w for v in vocabulary.values() for w in v] + ["42", "unseen", "жук"]
    texts = [" ".join(rng.choice(every) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + [None, "", "42 7"]
    bits, penalty = 20, 1.5
    model = language.fit(spark.createDataFrame(taught, "text string, lang string"), bits=bits)
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, penalty=penalty).collect()

    def parts(word):
        framed = b" " + word + b" "
        return [framed] + [framed[i : i + k] for k in (2, 3, 4) for i in range(len(framed) - k + 1)]

    def script(word):
        return "Cyrillic" if max(word) >= 0xD0 else "Latin"

    names = sorted(vocabulary)
    counts, scripts = {k: Counter() for k in names}, {k: Counter() for k in names}
    for text, lang in taught:
        for w in words(text.lower()):
            counts[lang].update(parts(w))
            scripts[lang][script(w)] += 1
    totals = {k: c.total() for k, c in counts.items()}

    def scores(word):
        rates = [[math.log((counts[k][f] + 0.1) / (totals[k] + 0.1 * 2**bits)) for k in names] for f in parts(word)]
        out = [sum(r[i] - sum(r) / len(names) for r in rates) / math.sqrt(len(rates)) for i in range(len(names))]
        return [s if scripts[k][script(word)] else -50.0 for s, k in zip(out, names)]

    for r in got:
        text = texts[r["doc_id"]]
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not re.search("[a-zа-я]", (text or "").lower()):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        table = [scores(w) for w in own]
        value = lambda path: sum(t[x] for t, x in zip(table, path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(len(names)), repeat=len(own)), key=value)
        made = [names.index(s["lang"]) for s in r["spans"] for _ in range(s["word_from"], s["word_to"])]
        assert value(made) == pytest.approx(value(best), abs=1e-4)
        share = Counter()
        for w, x in zip(own, made):
            share[names[x]] += len(w)
        assert r["lang_pred"] == min(names, key=lambda k: (-share[k], k))  # noqa: B023
        assert r["score"] == pytest.approx(share[r["lang_pred"]] / share.total())


def test_mixture_equals_a_plain_version(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 101, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(["a", "b", "é", "b", None])) for i in range(60)]
    rows += [rows[3], rows[3], (None, "no id here", "a"), (7, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in docs.withColumn("tie", F.xxhash64("text", "source")).collect():
        by[r["source"]].append(r)
    names = [*sorted(s for s in by if s is not None), None]
    sizes = [sum(len(words(r["text"])) for r in by[s]) for s in names]
    wanted = mixture.targets(sizes, [5.0, 2.0, 1.0, 5.0])
    want = Counter()
    for number, (name, size, target) in enumerate(zip(names, sizes, wanted)):
        own = sorted(by[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
        owner = [i for i, r in enumerate(own) for _ in words(r["text"])]
        blocks = [owner[k : k + 8] for k in range(0, size, 8)]
        taken = Counter()
        for slot in range(min(round(target * len(blocks) / size), 3 * len(blocks))):
            epoch, at = divmod(slot, len(blocks))
            taken.update(blocks[int(mixture.permute(np.array([at]), len(blocks), 6 * 1_000_003 + number * 1009 + epoch)[0])])
        assert abs(taken.total() - target) <= 16
        want.update((r["doc_id"], len(words(r["text"])), taken[i]) for i, r in enumerate(own))
    got = mixture.taken(*mixture.mix_sources(docs, block=8)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == want


CLASHING = ["score", "key", "digest", "rank", "row", "spans", "epoch", "id", "size"]


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls, blanks, repeated rows, rows equal in id and text only, and columns named as the stages name theirs."""
    long = " ".join(f"word{i}" for i in range(300))
    texts = [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, long, "b"), (5, long, "b"), (6, long + " end", None), (7, "seven short words stand in this text", "b")]
    texts += [texts[6], (8, "eighth", "a"), (8, "eighth", "b"), (None, "no id", "a"), (None, None, None)]
    rows = [(i, t, s, None, len(t or ""), *([str(n)] * len(CLASHING))) for n, (i, t, s) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"__{c} string" for c in CLASHING))


def test_stages_on_odd_rows(spark, odd_documents):
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, odd_documents, SF_DIR)
    assert good.columns == odd_documents.columns and {tuple(r) for r in good.collect()} <= {tuple(r) for r in odd_documents.collect()}
    once = stages["exact dedup"](spark, odd_documents, SF_DIR)
    again = stages["exact dedup"](spark, odd_documents.repartition(5, "__row"), SF_DIR)
    assert once.columns == odd_documents.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    assert Counter((r["doc_id"], r["text"] and r["text"][:6]) for r in once.collect()) == Counter([(2, ""), (3, " \n"), (5, "word0 "), (6, "word0 "), (7, "seven "), (8, "eighth"), (None, "no id")])
    unlike = stages["MinHash near-dedup"](spark, once, SF_DIR)
    assert unlike.columns == odd_documents.columns
    assert sorted((r["doc_id"] or 0) for r in unlike.collect()) == [0, 2, 3, 5, 7, 8]
    mixed = stages["mixing sources to target weights"](spark, odd_documents, SF_DIR)
    assert mixed.columns == odd_documents.columns
    assert all(words(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed.collect())
    coded = stages["byte-level BPE encoding and decoding"](spark, odd_documents, SF_DIR).collect()
    assert len(coded) == odd_documents.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in coded) and sum(r["n_tokens"] == 0 for r in coded) == 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, odd_documents, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd_documents.limit(0), SF_DIR).count() == 0


def test_free_names():
    assert free_names(["a", "row"], "row", "id") == ["__row", "__id"]
    assert free_names(["__ROW", "___id"], "row", "id") == ["____row", "____id"]


def test_hash_arrays_find_all_rows_and_no_others(spark):
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 2**64, 100_000, np.uint64))
    absent = np.setdiff1d(rng.integers(0, 2**64, 1000, np.uint64), hashes)
    rows = spark.createDataFrame([(int(h), i) for i, h in enumerate(hashes.view(np.int64))], "hash long, n int")
    table = hash_files.write(rows, "numbers")
    assert table.rows == len(hashes) and len(table.counts) > 2
    assert max(table.counts.values()) < 2 * hash_files.LEAST_ROWS
    mixed = rng.permutation(np.concatenate([hashes, absent]))
    found, got = table.find(mixed, ["n"])
    place = np.searchsorted(hashes, mixed) % len(hashes)
    assert (found == (hashes[place] == mixed)).all()
    assert (got["n"][found] == place[found]).all() and not got["n"][~found].any()


def test_hash_arrays_tell_equal_first_hashes_apart(spark):
    rows = spark.createDataFrame([(5, 10, 1), (5, 11, 2), (5, 12, 3), (-4, 10, 4)], "hash long, second long, n int")
    table = hash_files.write(rows, "twins")
    asked = np.array([5, 5, 2**64 - 4, 5, 6], np.uint64)
    found, got = table.find(asked, ["n"], also={"second": np.array([12, 10, 10, 13, 10])})
    assert found.tolist() == [True, True, True, False, False]
    assert got["n"].tolist() == [3, 1, 4, 0, 0]
    assert hash_files.write(rows.limit(0), "none").find(asked)[0].tolist() == [False] * 5


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    random.Random(1).shuffle(chain)
    star = [(1000 + i, 50) for i in range(60)]
    links = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in chain] + star + star[:3] + [(7, 7), (900, 901)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {n: 50 for n in [50, *range(1000, 1060)]} | {900: 900, 901: 900}
    assert components(links.limit(0)).count() == 0
