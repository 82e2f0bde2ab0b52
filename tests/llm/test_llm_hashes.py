"""Hashes of words and windows: words built to defeat polynomial hashes stay apart, in the operators too."""

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stringmill.llm import id_files, kneser_ney, minhash, substrings
from stringmill.llm.words import rolling, words_of


def alternating(steps: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """The two strings of 2**steps letters in the pattern of Thue and Morse."""
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


ONE, OTHER = alternating(10)


def test_alternating_words_differ():
    words = words_of(pa.array([f"{ONE} {OTHER} {ONE}"]))
    for seed in (1, 11, 21, 23, 31, 51, 52):
        h = words.hashes(seed)
        assert h[0] != h[1] and h[0] == h[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4096), min_size=1, max_size=20))
def test_words_of_two_letters(texts):
    words = words_of(pa.array([" ".join(texts)]))
    for seed in (1, 2):
        assert len(set(words.hashes(seed).tolist())) == len(set(texts))
    # neither place nor neighbours of a word change its hash
    alone = np.concatenate([words_of(pa.array([t])).hashes(1) for t in texts])
    assert (alone == words.hashes(1)).all()


def test_windows_are_those_of_the_values():
    rng = np.random.Generator(np.random.PCG64(1))
    values = rng.integers(0, 3, 400_000).astype(np.uint64)
    for n in (1, 3, 35, 64, 65, 200):
        h = rolling(2).windows(values, n)
        assert len(h) == len(values) - n + 1
        for i in (0, 5, 131_000, 131_072, 262_100, len(h) - 1):
            assert h[i] == rolling(2).windows(values[i : i + n].copy(), n)[0]
    a, b = (np.array([ord(c) for c in x], np.uint64) for x in (ONE, OTHER))
    assert rolling(2).windows(a, 1024)[0] != rolling(2).windows(b, 1024)[0]


def test_operators_tell_alternating_words_apart(spark):
    docs = spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in id_files.write_and_read(docs).collect()}
    library = id_files.WordIds(id_files.TOKENIZER).tokenizer
    for i, text in ((1, ONE), (2, OTHER)):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert all(r["kept"] for r in minhash.near_groups(docs, n=3, percent=85).collect())
    filler = [f"w{i}" for i in range(17)]
    texts = [" ".join([*filler, x, *filler]) for x in (ONE, OTHER)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.without_repeats(docs, n=35).collect()] == [0, 0]
    model = kneser_ney.fit(docs)
    scored = kneser_ney.score(spark.createDataFrame([(1, ONE)], "doc_id long, text string"), model).first()
    assert scored["n_known"] == 2
    model = kneser_ney.fit(docs.where("doc_id = 2"))
    assert kneser_ney.score(spark.createDataFrame([(1, ONE)], "doc_id long, text string"), model).first()["n_known"] == 1
