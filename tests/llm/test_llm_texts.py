"""Operators on single texts against brute-force versions: ids, files, scores, language."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stringmill.llm import bpe_codec, id_coder, id_files, kneser_ney, language, quality
from stringmill.llm.base import crc_bucket

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"
LONG = "alpha beta  gamma\n" * 9000 + "x" * 70_000
TEXTS = [None, "", "  \n\t ", "Hello, World! it's 42", "naïve Ünïcödé 漢字   ok", "a", "a", LONG, "<|endoftext|> in text", "tail  "]
SCHEMA = "doc_id long, text string, ids int, score string, hash long"


def words(text):
    return [w for w in WORD.findall((text or "").encode())]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, a null id, and columns with names the operators use."""
    rows = [(i, t, i, "kept", None) for i, t in enumerate(TEXTS)] + [(5, "a", 5, "kept", None), (None, "no id", 0, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_ids_equal_the_library_and_come_back(odd):
    encoder = bpe_codec._encoding(bpe_codec.RANK_FILE, public_tokenizers.PATTERN)
    for part in (1 << 16, 50):
        for r in bpe_codec.decode(bpe_codec.encode(odd, part=part)).collect():
            assert r["ids"] == encoder.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe_codec.decode(bpe_codec.encode(odd.limit(0))).count() == 0


def test_raw_bytes_are_decoded_as_they_are(spark):
    encoder = bpe_codec._encoding(bpe_codec.RANK_FILE, public_tokenizers.PATTERN)
    ids = encoder.encode_ordinary("漢字")
    half = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe_codec.decode(half).orderBy("doc_id").collect()] == [encoder.decode_bytes(ids[:1]), b"", b""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1024]), st.sampled_from([1, 10, 12]))
def test_coder_round_trip(ids, block, slots):
    ids = np.array(ids, np.uint32)
    assert (id_coder.decode(id_coder.encode(ids, block, slots)) == ids).all()


def test_coder_says_which_block_is_damaged():
    ids = np.arange(5000, dtype=np.uint32) % 97
    stream = bytearray(id_coder.encode(ids))
    stream[-1] ^= 255
    stream[-2] ^= 255
    stream[-9] ^= 255
    with pytest.raises(ValueError, match="block 4"):
        id_coder.decode(bytes(stream))


def test_coder_is_shorter_than_plain_ids_where_ids_repeat():
    ids = np.tile(np.random.default_rng(1).integers(0, 40_000, 60), 400).astype(np.uint32)
    assert len(id_coder.encode(ids)) < len(ids)


def expected_files(rows):
    tokenizer = Tokenizer.from_file(id_files.TOKENIZER)
    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [id_files.FILE_BYTES, 5000])
def test_id_files_equal_the_library(documents, file_bytes):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    got = id_files.write_and_read(documents, ids=False, file_bytes=file_bytes, stream_ids=3000, block=256, slots=8).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == expected_files(rows)
    got = id_files.write_and_read(documents, file_bytes=file_bytes).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == expected_files(rows)


def test_id_files_of_odd_rows(odd):
    found = sorted((tuple(r)[:4] for r in id_files.write_and_read(odd).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 0, 1, 2, 3, 4, 5, 5, *range(6, len(TEXTS))]
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    assert found == expected_files([(r[0], texts[r[0]]) for r in found])
    assert id_files.write_and_read(odd.limit(0)).count() == 0


def test_id_files_compose_letters_and_marks_before_lower_case(spark):
    """Some letters have a composed form with a mark in lower case only; '<|' elsewhere changes nothing."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [" ".join(f"{letter}{m} {letter.lower()}{m} x{letter}{m}y" for m in marks) for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    texts += ["die T\u0308ur", "<|ENDOFTEXT|> Die T\u0308ur <|endoftext|>", "A<", "|B", "Plain ASCII Words", "\u0130 \u212a \u03a3\u0391\u03a3 IT'S"]
    rows = list(enumerate(texts))
    for some in (rows, rows[:27]):  # with and without '<|' in the slice
        got = id_files.write_and_read(spark.createDataFrame(some, "doc_id long, text string")).orderBy("doc_id").collect()
        assert [tuple(r)[:4] for r in got] == expected_files(some)


def test_damaged_id_file_is_an_error():
    with pytest.raises(ValueError, match="not an id file"):
        list(id_files._documents(memoryview(b"IDFILE0\0" + bytes(64)), 0))


def kneser_ney_brute(train, asked):
    """Counts, discounts and probabilities of the same model from plain dictionaries."""
    def tokens(text):
        return [w.lower() for w in words(text)] + ["</s>"]

    uni, bi = Counter(), Counter()
    for t in train:
        own = tokens(t)
        uni.update(own)
        bi.update(zip(["<s>", *own], own))
    total, kinds = sum(uni.values()), len(uni)
    cont, follow = Counter(), defaultdict(Counter)
    for (v, w), n in bi.items():
        cont[w] += 1
        follow[v][min(n, 3)] += 1

    def estimate(counts):
        have = Counter(counts)
        return kneser_ney.discounts(*(have[k] for k in (1, 2, 3, 4)))

    d, e = estimate(bi.values()), estimate(cont.values())
    rest = sum(e[min(k, 3)] for k in cont.values()) / len(bi) if bi else 1.0
    seen = Counter()
    for (v, _), n in bi.items():
        seen[v] += n

    def p(v, w):
        q = max(cont[w] - e[min(cont[w], 3)], 0) / max(len(bi), 1) + rest / (kinds + 1)
        if not seen[v]:
            return q
        back = sum(d[k] * n for k, n in follow[v].items()) / seen[v]
        n = bi[v, w]
        return max(n - d[min(n, 3)], 0) / seen[v] + back * q

    out = []
    for t in asked:
        own = tokens(t)
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        model = sum(math.log10(p(v, w)) for v, w in zip(["<s>", *own], own))
        out.append((len(own), sum(uni[w] > 0 for w in own), total, base, model))
    return out, p, uni


def test_kneser_ney_equals_brute_force(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    train = docs.where(crc_bucket("doc_id", 10) != 0)
    model = kneser_ney.fit(train)
    got = kneser_ney.score(docs.withColumn("n", crc_bucket("doc_id", 10)), model).collect()
    asked = [r["text"] for r in docs.collect()]
    want, p, uni = kneser_ney_brute([r["text"] for r in train.collect()], asked)
    key = lambda r: (r[0], r[3], r[4])
    rows = sorted((tuple(r)[1:] for r in got), key=key)
    for a, b in zip(rows, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3]
        assert a[3:] == pytest.approx(b[3:], rel=1e-9)
    unknown = p("</s>", b"never seen at all")
    for context in ("<s>", b"the", next(iter(uni))):
        assert sum(p(context, w) for w in uni) + p(context, b"never seen at all") == pytest.approx(1.0)
    assert unknown > 0


def test_kneser_ney_without_training_texts(odd):
    model = kneser_ney.fit(odd.select("doc_id", "text").limit(0))
    for r in kneser_ney.score(odd, model).collect():
        assert r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"])


def test_language_of_held_out_texts(documents):
    learn = documents.where(crc_bucket("doc_id", 3) != 1)
    model = language.fit(learn)
    asked = documents.where("lang is not null").where(crc_bucket("doc_id", 3) == 1)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, model).collect()}
    right = [got[r["doc_id"]] == r["lang"] for r in asked.collect() if re.search(r"[A-Za-z]{3}", r["text"] or "")]
    assert sum(right) >= 0.95 * len(right)


def test_language_spans_and_odd_texts(spark, odd):
    learn = spark.createDataFrame([("der hund und die katze schlafen nicht " * 5, "de"), ("the dog and the cat do not sleep " * 5, "en"), ("кот и собака не спят " * 5, "ru"), ("no label", None)], "text string, lang string")
    model = language.fit(learn)
    mixed = spark.createDataFrame([(1, "the dog and the cat do not sleep der hund und die katze schlafen nicht кот и собака")], "doc_id long, text string")
    spans = language.predict(mixed, model).first()["spans"]
    assert [(s["lang"], s["word_from"], s["word_to"]) for s in spans] == [("en", 0, 8), ("de", 8, 15), ("ru", 15, 18)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language.fit(learn.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    first = np.array([0, 4, 4, 9])
    got = language.viterbi(scores, first, 0.7)
    for a, b in zip(first, first[1:]):
        def value(path):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))

        paths = [[]]
        for _ in range(b - a):
            paths = [p + [x] for p in paths for x in range(3)]
        assert value(got[a:b].tolist()) == pytest.approx(max(map(value, paths)), abs=1e-5)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(crc_bucket("doc_id", 5) != 0))
    scored = quality.score(docs, model).where(crc_bucket("doc_id", 5) == 0).join(labels, "doc_id").select("score", "quality").collect()
    good = [r["score"] for r in scored if r["quality"] == 1]
    bad = [r["score"] for r in scored if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.9


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 1), (6, 0), (7, None), (8, 7), (None, 1)], "doc_id long, quality int")
    scored = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if not words(r["text"])}) == 1
    blank = quality.score(odd, quality.fit(odd, labels.limit(0))).collect()
    assert {r["score"] for r in blank} == {0.5}
    assert quality.score(odd.limit(0), quality.fit(odd, labels)).count() == 0


def test_decoded_digest_is_that_of_the_text(spark):
    from stringmill.llm.queries import op1_byte_bpe

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in op1_byte_bpe(spark, SF_DIR).collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
