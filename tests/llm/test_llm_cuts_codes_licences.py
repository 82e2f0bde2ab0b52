"""Fill-in-the-middle, vector codes and licence scans against brute force, with odd rows."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stringmill.llm import infill, licences, vector_codes
from stringmill.llm.queries import QUERIES
from stringmill.llm.words import text_bytes, words_of

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD_TEXTS = [None, "", " ", "word", "two words", "<P>", "a<S>b", "naïve Ünḯ \U0001f600\U0001f600x", "a\nb\r\n\x00c", "<S", "ends in <", "é" * 70, "same", "same"]


def cut_by_hand(key, text, seed=1):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ 9é\U0001f600-"), max_size=60), min_size=1, max_size=5), st.integers(1, 40))
def test_cuts_in_small_pieces(texts, piece):
    data, offsets = text_bytes(pa.array(texts))
    pieces = infill.Pieces(data, offsets, piece)
    units = [UNIT.findall(t) for t in texts]
    assert np.diff(pieces.first_unit).tolist() == [len(u) for u in units]
    assert np.diff(pieces.first_char).tolist() == [len(t) for t in texts]
    whole = [u for t in units for u in t]
    chars, size = pieces.find(np.arange(len(whole) + 1))
    assert chars.tolist() == [sum(map(len, whole[:i])) for i in range(len(whole) + 1)]
    assert size.tolist() == [len("".join(whole[:i]).encode()) for i in range(len(whole) + 1)]


def test_infill_of_odd_and_long_rows(spark):
    long = [("word " * 700_000) + "é" * 10, "x" * 2_500_000 + " y", "-" * 1_500_000]
    data = [(i, t) for i, t in enumerate(ODD_TEXTS + long)] + [(None, "no id here"), (3, "word"), (3, "word")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("output", F.lit("x")).withColumn("h1", F.lit(0))
    got = infill.restored(infill.rearranged(docs)).collect()
    key = lambda r: (str(r[0]), str(r[-1]))
    want = sorted(((k, *cut_by_hand(k, t), t or "") for k, t in data), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.rearranged(docs.limit(0)).collect() == []


def brute_codes(vectors, labels, entries=256, rounds=4, parts=4):
    x = np.array([[math.floor(1024 * c) for c in v] for v in vectors]).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        index, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[index[:, p] == e, p]
                if len(own):
                    books[p, e] = [math.floor(int(s) / len(own)) for s in own.sum(0)]
    index, d = nearest()
    error = d.sum(1)
    sums = {}
    for label, e in zip(labels, error.tolist()):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return ["".join(f"{i:02x}" for i in row) for row in index], error.tolist(), [sums[x] for x in labels], digest


@pytest.mark.parametrize("n", [3, 700])
def test_vector_codes(spark, n):
    rng = np.random.Generator(np.random.PCG64(n))
    centres = rng.normal(size=(5, 8))
    vectors = (centres[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, 8))).astype(np.float32).astype(float).tolist()
    vectors[1] = vectors[0]
    labels = [None if i % 3 == 0 else i % 2 for i in range(n)]
    bad = [None, [], [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    data = [(i * 2, v, lab) for i, (v, lab) in enumerate(zip(vectors, labels))] + [(1, v, 1) for v in bad]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).repartition(3)
    got = sorted(vector_codes.compressed(rows, entries=64).collect())
    code, error, sums, digest = brute_codes(vectors, labels, entries=64)
    assert [tuple(r) for r in got] == [(2 * i, code[i], error[i], sums[i], digest) for i in range(n)]


def test_vector_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    none = spark.createDataFrame([(1, None, "a"), (2, [], None)], schema)
    assert vector_codes.compressed(none).collect() == [] and len(vector_codes.compressed(none).columns) == 5
    assert vector_codes.compressed(none.limit(0)).collect() == []
    one = spark.createDataFrame([(None, [0.5, -0.5, 1e-4, -1e-4], "a"), (None, [0.5, -0.5, 1e-4, -1e-4], "a")], schema)
    got = vector_codes.compressed(one).collect()
    # a tie goes to the lower entry; floors go down
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got] == [(None, "00000000", 0, 0)] * 2
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(b"512,512,-512,-512,0,0,-1,-1").hexdigest()}
    for vectors in ([[1.0] * 4, [1.0] * 8], [[1.0] * 6], [[1e9] * 4]):
        with pytest.raises(ValueError):
            vector_codes.compressed(spark.createDataFrame([(i, v, "a") for i, v in enumerate(vectors)], schema))


def test_codes_decode_to_entries(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    data = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    rows = vector_codes.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding", None, 1024)
    books, table = vector_codes.fit(rows, entries=64)
    back = vector_codes.decoded(vector_codes.coded(table, books), books).collect()
    given_ = dict(data)
    for r in back:  # 64 entries for 40 rows: every vector is its own entry
        assert r["error"] == 0 and r["vector"] == [math.floor(1024 * c) / 1024 for c in given_[r["vec_id"]]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([1, 3, 1000, 2**26]))
def test_nearest_is_exact(seed, many, size):
    rng = np.random.Generator(np.random.PCG64(seed))
    x, entries = rng.integers(-size, size + 1, (50, 5)), rng.integers(-size, size + 1, (many, 5))
    pivots = vector_codes.spread_pivots(entries, 4)
    gaps = np.sqrt(vector_codes.table_of(x, pivots)).astype(np.float32)
    index, best, tried = vector_codes.nearest(x, gaps, entries, pivots)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert index.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist() and tried <= d.size


def test_pivots_spare_distances():
    rng = np.random.Generator(np.random.PCG64(5))
    centres = rng.integers(-5000, 5000, (40, 16))
    entries = centres[rng.integers(0, 40, 256)] + rng.integers(-100, 100, (256, 16))
    x = centres[rng.integers(0, 40, 1000)] + rng.integers(-100, 100, (1000, 16))
    pivots = vector_codes.spread_pivots(entries, 16)
    _, _, tried = vector_codes.nearest(x, np.sqrt(vector_codes.table_of(x, pivots)).astype(np.float32), entries, pivots)
    assert tried < 0.15 * len(x) * len(entries)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_by_hand(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_matching_statistics(sequences, text):
    automaton = licences.Automaton(sequences)
    for i, (state, n) in enumerate(automaton.stream(text)):
        runs = [k for k in range(i + 2) if any(text[i + 1 - k : i + 1] == s[j : j + k] for s in sequences for j in range(len(s) - k + 1))]
        assert n == max(runs)
        if n:
            ends = [(t, j + n) for t, s in enumerate(sequences) for j in range(len(s) - n + 1) if s[j : j + n] == text[i + 1 - n : i + 1]]
            assert automaton.places(state) == sorted(ends)


LICENCE_TEXTS = [
    None,
    "",
    "...",
    "mit",
    "MIT License",
    "mit licenseé MIT-License mit\nlicense",
    "GNU General Public License, GNU Lesser General Public License; gnu general public",
    "CC BY-NC 4.0 and cc by cc by",
    "the Apache License apache license",
    licences.TEMPLATES["isc"][0],
    "before " + licences.TEMPLATES["bsd"][0].replace("binary", "object", 1) + " after",
    " ".join(licences.TEMPLATES["mit"][0].split()[:12]),
    ("filler words here " + licences.TEMPLATES["isc"][0] + " ") * 300,
    "This work is licensed under the GNU General Public License, version 3 for all.",
    "Licensed under CC BY-NC 4.0",
]


def test_licence_scan(spark):
    data = [(i, t) for i, t in enumerate(LICENCE_TEXTS)] + [(None, "mit license"), (4, "MIT License")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("places", F.lit("x"))
    got = {r["doc_id"]: r for r in licences.scanned(docs).collect()}
    for key, text in data:
        n, places = base_by_hand(text)
        assert got[key]["n_words"] == n
        assert sorted((p["first_word"], p["label"]) for p in got[key]["places"]) == places
    isc, bsd, short, many = (got[i]["spans"] for i in (9, 10, 11, 12))
    n = len(WORD.findall(lower(licences.TEMPLATES["isc"][0])))
    assert [(s["label"], s["first_word"], s["last_word"], s["covered"]) for s in isc] == [("isc", 0, n - 1, n)]
    assert [(s["label"], s["first_word"]) for s in bsd] == [("bsd", 1)] and bsd[0]["covered"] == bsd[0]["length"] - 1
    assert short == []
    assert [(s["first_word"], s["covered"]) for s in many] == [(3 + i * (n + 3), n) for i in range(300)]
    told = {r["doc_id"]: r for r in licences.summary(licences.scanned(docs)).collect()}
    assert (told[13]["base_labels"], told[13]["labels"], told[13]["score"]) == ("gpl", "gpl,gpl-3.0", 1.0)
    assert (told[14]["labels"], told[14]["n_base"]) == ("cc-by,cc-by-nc-4.0", 1)
    assert (told[9]["base_labels"], told[9]["labels"], told[9]["n_base"], told[9]["first_word"]) == ("", "isc", 0, None)
    assert (told[0]["n_words"], told[0]["labels"], told[0]["score"]) == (0, "", 0.0)
    assert licences.scanned(docs.limit(0)).collect() == []


def test_own_templates(spark):
    scanner = licences.Scanner({"own": ["one two three four five six"]}, {"solo": "s", "two three": "t", "": "none"})
    docs = spark.createDataFrame([(1, "solo one two three four five six"), (2, "two three x solo")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scanned(docs, scanner=scanner).collect()}
    assert [p["first_word"] for p in got[1]["places"]] == [0, 2] and got[1]["spans"][0]["covered"] == 6
    assert [(p["label"], p["first_word"]) for p in got[2]["places"]] == [("t", 0), ("s", 3)]


def test_chains_join_near_anchors():
    assert max(c.covered for c in licences.chained([(6, 6, 6), (14, 13, 7)])) == 13
    assert max(c.covered for c in licences.chained([(6, 6, 6), (60, 13, 7)])) == 7  # too far apart
    assert max(c.covered for c in licences.chained([(6, 13, 6), (14, 6, 6)])) == 6  # other order


def test_queries_on_the_small_tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op13_licences"](spark, "/root/testdata/sf0.001").collect():
        n, places = base_by_hand(docs[r["doc_id"]])
        starts = [i for i, _ in places]
        base = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
