import json
import random
from dataclasses import replace

import pytest
import tokenizers as lib
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers.models import BPE, Unigram, WordLevel, WordPiece
from tokenizers.pre_tokenizers import Split
from tokenizers.trainers import BpeTrainer, WordLevelTrainer

from stringmill.functions.pieces import PATTERNS
from stringmill.operators import ngrams, vocab
from stringmill.operators.tokenizers import encode as enc
from stringmill.operators.tokenizers.bpe import shrink, train_bpe, train_wordpiece
from stringmill.operators.tokenizers.grid import (
    check_combination,
    combinations,
    tokenizer_grid,
    train_tokenizer,
)
from stringmill.operators.tokenizers.model import (
    TokenModel,
    from_tokenizer_json,
    model_vocab_size,
    to_tokenizer_json,
    wordlevel_model,
)
from stringmill.operators.tokenizers.unigram import train_unigram, train_unigrams
from stringmill.plans.tokenized import build_tokenized_dataset, with_splits

SPECIALS = ["^", "_", " ", "§", "°"]


def corpus(seed, alphabet="CNOc1()=[]+-#", longest=30):
    rng = random.Random(seed)
    lines = [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
        for _ in range(rng.randint(5, 60))
    ]
    return lines + lines[: rng.randint(0, 5)]


def frame(rows, lines):
    return rows("ord long, item string", *enumerate(lines))


def ids_of(df, model, kind="CHAR"):
    got = df.select("ord", enc.raw_ids(F.col("item"), model, kind).alias("ids"))
    return [r.ids for r in got.orderBy("ord").collect()]


@pytest.mark.parametrize("kind", ["CHAR", "ATOM", "SMARTS"])
def test_wordlevel_equals_the_library(rows, kind):
    lines = corpus(1) + ["[Na+].[Cl-]", "C[C@@H](N)C(=O)O", "Clc1ccccc1"]
    tok = lib.Tokenizer(WordLevel(unk_token="§"))
    tok.pre_tokenizer = Split(lib.Regex(PATTERNS[kind]), behavior="isolated")
    tok.train_from_iterator(lines, WordLevelTrainer(special_tokens=SPECIALS, min_frequency=1, show_progress=False))
    df = frame(rows, lines)
    model = wordlevel_model(vocab.train_wordlevel(df, kind))
    if kind == "CHAR":  # the library cuts only by a pattern; every character is its own piece
        assert set(model.tokens) == set(SPECIALS) | set("".join(lines))
        return
    assert model.ids == tok.get_vocab()
    assert ids_of(df, model, kind) == [tok.encode(x, add_special_tokens=False).ids for x in lines]


@pytest.mark.parametrize("seed,size", [(0, 25), (1, 40), (2, 70)])
def test_bpe_equals_the_library(rows, seed, size):
    lines = corpus(seed, "CNOc1()=ab" if seed else "ab")
    tok = lib.Tokenizer(BPE(unk_token="§"))
    tok.train_from_iterator(
        lines, BpeTrainer(vocab_size=size + 5, special_tokens=SPECIALS, min_frequency=1, show_progress=False)
    )
    df = frame(rows, lines)
    model = train_bpe(df, size)
    assert model.ids == tok.get_vocab()
    merges = [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]
    assert list(model.merges) == merges
    more = frame(rows, lines + ["CxN", "zz", "aaaaaaa"])
    assert ids_of(more, model) == [
        tok.encode(x, add_special_tokens=False).ids for x in lines + ["CxN", "zz", "aaaaaaa"]
    ]
    smaller = train_bpe(df, size - 8)
    assert shrink(model, size - 8) == smaller


def test_bpe_on_words_with_checkpoints(rows, monkeypatch):
    """Text with blanks (a special token here) and few merges per checkpoint."""
    monkeypatch.setattr("stringmill.operators.tokenizers.bpe.MERGES_PER_CHECKPOINT", 3)
    monkeypatch.setattr("stringmill.operators.tokenizers.bpe.TOP_PAIRS", 7)
    lines = [" ".join(random.Random(i).choices(["the", "then", "hat", "that", "a"], k=9)) for i in range(40)]
    tok = lib.Tokenizer(BPE(unk_token="§"))
    tok.train_from_iterator(
        lines, BpeTrainer(vocab_size=35, special_tokens=SPECIALS, min_frequency=1, show_progress=False)
    )
    assert train_bpe(frame(rows, lines), 30).ids == tok.get_vocab()


@pytest.mark.parametrize("algorithm", ["WORDLEVEL", "BPE", "WORDPIECE", "UNIGRAM"])
def test_stored_models_open_in_the_library(rows, algorithm):
    lines = [x for x in corpus(11) if not set(x) & set("^_ §°")]
    df = frame(rows, lines)
    kind = "SMARTS" if algorithm == "WORDLEVEL" else "CHAR"
    model = train_tokenizer(df, kind, algorithm, 0 if algorithm == "WORDLEVEL" else 45)
    text = to_tokenizer_json(model, kind)
    tok = lib.Tokenizer.from_str(text)
    probes = lines + ["CZ", "C" * 40]
    got = enc.encode(frame(rows, probes), model, kind).orderBy("ord").collect()
    assert [r.input_ids for r in got] == [tok.encode(x).ids for x in probes]
    # the WordPiece form of the file holds no merges
    stored = replace(model, merges=()) if algorithm == "WORDPIECE" else model
    assert from_tokenizer_json(text) == stored
    assert from_tokenizer_json(tok.to_str()).ids == model.ids


def test_min_frequency_and_small_goal(rows):
    df = frame(rows, ["abab", "abc", "x"])
    assert train_bpe(df, 50, min_frequency=4).merges == ()
    assert train_bpe(df, 50, min_frequency=3).merges == (("a", "b"),)
    # the alphabet is never cut
    assert model_vocab_size(train_bpe(df, 1)) == (9, 4)


def test_wordpiece_training_properties(rows):
    lines = corpus(5)
    df = frame(rows, lines)
    model = train_wordpiece(df, 70)
    assert model_vocab_size(model)[1] == 70
    assert train_wordpiece(df, 70).tokens == model.tokens
    assert enc.roundtrip_report(df, model).count() == 0
    tok = lib.Tokenizer(WordPiece(model.ids, unk_token="§", max_input_chars_per_word=1024))
    probes = lines + ["CZ", "N" * 50, "c1" * 520]
    assert ids_of(frame(rows, probes), model) == [
        tok.encode(x, add_special_tokens=False).ids for x in probes
    ]


def test_unigram_training_properties(rows):
    lines = corpus(6)
    df = frame(rows, lines)
    model = train_unigram(df, 60)
    assert model_vocab_size(model) == (65, 60)
    assert sum(pow(2.718281828459045, p) for p in model.logp.values()) == pytest.approx(1.0, abs=1e-3)
    assert enc.roundtrip_report(df, model).count() == 0
    assert len(train_unigram(df, 3).tokens) == 44
    pieces = [(t, model.logp.get(t, 0.0)) for t in model.tokens]
    tok = lib.Tokenizer(Unigram(pieces, unk_id=3))
    clean = [x for x in lines if not set(x) & set("^_ §°")]
    assert ids_of(frame(rows, clean), model) == [tok.encode(x, add_special_tokens=False).ids for x in clean]
    unknown = ids_of(frame(rows, ["CQQN"]), model)[0]
    assert unknown.count(3) == 1


def test_unigram_sizes_trained_together(rows):
    df = frame(rows, corpus(9))
    together = train_unigrams(df, [50, 80, 3])
    for size, model in together.items():
        alone = train_unigram(df, size)
        # sums over tasks may differ in the last digits
        assert set(model.tokens) == set(alone.tokens)
        assert model.logp == pytest.approx(alone.logp, rel=1e-6)


def test_unigram_seeds_against_all_substrings(rows):
    from stringmill.operators.tokenizers.model import line_counts
    from stringmill.operators.tokenizers.unigram import seed_pieces

    lines = corpus(4, "abc", 25) + ["xabcdefghijklmnopqrstuvwx", "yabcdefghijklmnopqrstuvwz"]
    counts = {}
    for line in lines:
        for i in range(len(line)):
            for j in range(i + 1, min(i + 16, len(line)) + 1):
                counts[line[i:j]] = counts.get(line[i:j], 0) + 1
    frequent = {p: n for p, n in counts.items() if n > 1 or len(p) == 1}
    inner = {(q, n) for p, n in frequent.items() if len(p) > 2 for q in (p[1:], p[:-1])}
    want = {p: n for p, n in frequent.items() if len(p) == 1 or (p, n) not in inner}
    assert max(map(len, want)) == 16
    left_out = {"rare": len(counts) - len(frequent), "dominated": len(frequent) - len(want), "beyond": 0}
    items = line_counts(frame(rows, lines))
    assert seed_pieces(items, 16, 10**6, 2) == (want, left_out)
    few, left_out = seed_pieces(items, 16, 5, 2)
    longer = {p: n for p, n in want.items() if len(p) > 1}
    heavy = sorted(longer, key=lambda p: (-longer[p] * len(p), p))[:5]
    assert few == {p: n for p, n in want.items() if len(p) == 1 or p in heavy}
    assert left_out["beyond"] == len(longer) - 5


def test_unigram_seeds_across_partitions(rows, monkeypatch):
    """Windows of one prefix in several partitions, characters that sort apart, and the zero character."""
    from stringmill.operators.tokenizers import unigram

    monkeypatch.setattr(unigram, "PART_WINDOWS", 3)
    lines = [("ab" * 9, 2), ("a\x00b\U0001f600" * 3, 1), ("é" * 30, 3)]
    counts = {}
    for line, n in lines:
        for i in range(len(line)):
            for j in range(i + 1, min(i + 5, len(line)) + 1):
                counts[line[i:j]] = counts.get(line[i:j], 0) + n
    frequent = {p: n for p, n in counts.items() if n > 1 or len(p) == 1}
    inner = {(q, n) for p, n in frequent.items() if len(p) > 2 for q in (p[1:], p[:-1])}
    want = {p: n for p, n in frequent.items() if len(p) == 1 or (p, n) not in inner}
    got, left_out = unigram.seed_pieces(rows("line string, n long", *lines), 5, 10**6, 2)
    assert got == want
    assert left_out == {"rare": len(counts) - len(frequent), "dominated": len(frequent) - len(want), "beyond": 0}


def test_unigram_learns_pieces_of_any_given_length(rows):
    rng = random.Random(3)
    lines = ["".join(rng.choice("mnopq") for _ in range(rng.randint(1, 9))) + "abcdefghijkl" + rng.choice("mnopq") for _ in range(80)]
    model = train_unigram(frame(rows, lines), 60)
    assert any("abcdefghijkl" in t for t in model.tokens)
    assert max(map(len, train_unigram(frame(rows, lines), 60, max_piece_length=4).tokens)) <= 4


def test_unigram_expected_counts_against_all_splits(rows):
    from stringmill.operators.tokenizers.unigram import expected_counts

    logp = {"a": -1.0, "b": -1.5, "ab": -1.2, "aba": -3.0, "bab": -0.5}

    def splits(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in logp:
                for rest in splits(text[k:]):
                    yield [text[:k], *rest]

    want = {}
    lines = [("ababab", 3), ("ba", 1), ("aab" * 3, 2)]
    for line, n in lines:
        ways = [(w, pow(2.718281828459045, sum(logp[p] for p in w))) for w in splits(line)]
        total = sum(p for _, p in ways)
        for way, p in ways:
            for piece in way:
                want[piece] = want.get(piece, 0.0) + n * p / total
    got = expected_counts(rows("line string, n long", *lines), logp)
    assert got == pytest.approx(want)


def test_encoding_marks_padding_and_masks(rows):
    df = rows("ord long, batch string, item string", (0, "x", "CCO"), (1, "x", "C"), (2, "y", "Cz"))
    model = TokenModel("WORDLEVEL", (*SPECIALS, "C", "O"))
    got = enc.encode(df, model, pad_to="batch").orderBy("ord").collect()
    assert [r.input_ids for r in got] == [[0, 5, 5, 6, 1], [0, 5, 1, 2, 2], [0, 5, 3, 1]]
    assert [r.attention_mask for r in got][1] == [1, 1, 1, 0, 0]
    assert [r.special_tokens_mask for r in got][:2] == [[1, 0, 0, 0, 1], [1, 0, 1, 1, 1]]
    fixed = enc.encode(df, model, pad_to=5, multiple=8).orderBy("ord").first()
    assert len(fixed.input_ids) == 8
    # too long rows lose tokens at the left
    cut = enc.encode(df, model, max_length=4).orderBy("ord").first()
    assert cut.input_ids == [0, 5, 6, 1]
    joined = enc.encode_wordlevel_join(df, vocab_frame(rows, model), 3)
    assert sorted((r.ord, r.ids) for r in joined.collect()) == [(0, [5, 5, 6]), (1, [5]), (2, [5, 3])]
    back = df.select(enc.decode(enc.with_marks(enc.raw_ids(F.col("item"), model), 0, 1), model))
    assert [r[0] for r in back.collect()] == ["CCO", "C", "C"]
    assert [r.item for r in enc.roundtrip_report(df, model).collect()] == ["Cz"]
    lanes = enc.length_buckets(enc.encode(df, model), 2)
    assert {(r.ord, r.bucket) for r in lanes.collect()} == {(0, 2), (1, 1), (2, 2)}


def vocab_frame(rows, model):
    return rows("token string, id int", *[(t, i) for t, i in model.ids.items()])


def probed(counts, start, end):
    """Ids by walking to the next free one."""
    top, used, out = max(c for _, c in counts), set(), {}
    slope = (end - start) / top
    for token, count in sorted(counts, key=lambda x: (-x[1], x[0])):
        to = max(int(-slope * count + end), start)
        while to in used:
            to += 1
        used.add(to)
        out[token] = to
    return out


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.integers(0, 60), min_size=1, max_size=80).filter(lambda c: max(c) > 0),
    st.integers(0, 300),
)
def test_linear_mapping_equals_probing(spark, counts, start):
    pairs = [(f"t{i:03d}", c) for i, c in enumerate(counts)]
    end = start + len(counts) + 50
    freq = spark.createDataFrame(pairs, "token string, count long")
    got = vocab.map_vocab_linear(freq, end + 200, start, end)
    assert {r.token: r.new_id for r in got.collect()} == probed(pairs, start, end)


def test_remap_keeps_ids_contiguous(rows):
    old = rows("token string, id int", *[(f"w{i}", i) for i in range(20)])
    new = rows("token string, new_id int", ("w3", 7), ("x", 3), ("w19", 0), ("y", 12))
    got = vocab.remap_vocab(old, new).collect()
    assert [r.id for r in got] == list(range(20))
    names = [r.token for r in got]
    assert (names[7], names[3], names[0], names[12], names[19]) == ("w3", "x", "w19", "y", "§§§_19")
    assert "w7" not in names and "w0" not in names


def test_vocabulary_reports(rows):
    df = frame(rows, ["CCO", "CN", ""])
    counts = vocab.token_frequencies(df)
    assert {r.token: r["count"] for r in counts.collect()} == {"C": 3, "O": 1, "N": 1, "^": 3, "_": 3}
    words = vocab.train_wordlevel(df)
    assert tuple(vocab.vocab_size_report(words).first()) == (8, 3)
    filled = vocab.zero_fill(words, vocab.piece_counts(frame(rows, ["CC"])))
    assert {r.token: r["count"] for r in filled.collect() if r["count"]} == {"C": 2}
    assert [r.token for r in vocab.top_frequent(counts, 1).collect()] == ["C"]
    with pytest.raises(ValueError):
        vocab.map_vocab_linear(counts, 100, 90, 94)


def test_grid(rows):
    assert len(combinations()) == 12
    for bad in (("ATOM", "BPE", 44), ("CHAR", "WORDLEVEL", 44), ("CHAR", "BPE", 0), ("WORD", "BPE", 1)):
        with pytest.raises(ValueError):
            check_combination(*bad)
    df = frame(rows, corpus(8)[:12])
    cells = [("SMARTS", "WORDLEVEL", 0), ("CHAR", "BPE", 20), ("CHAR", "BPE", 30)]
    models = tokenizer_grid(df, cells)
    assert models[cells[1]] == train_bpe(df, 20) and models[cells[2]] == train_bpe(df, 30)
    assert model_vocab_size(models[cells[2]])[1] == 30


def test_tokenized_dataset(rows):
    df = rows("split string, ord long, item string", *[("train", i, f"C{i % 10}N") for i in range(50)])
    encoded, model = build_tokenized_dataset(df, enclosed=("<", ">"))
    assert {"<", ">", "C"} <= set(model.tokens)
    sizes = {r.split: r["count"] for r in encoded.groupBy("split").count().collect()}
    assert sizes == {"train": 40, "validation": 5, "test": 5}
    assert {len(r.input_ids) % 8 for r in encoded.collect()} == {0}
    given_splits = df.unionByName(rows("split string, ord long, item string", ("validation", 99, "C")))
    assert with_splits(given_splits).count() == 51
    with pytest.raises(ValueError):
        with_splits(df.withColumn("split", F.lit("test")))


def test_ngram_scores_against_brute_force(rows):
    import math
    from collections import Counter

    texts = ["abab", "abc", "b", "cab"]
    df = rows("ord long, tokens array<string>", *[(i, list(t)) for i, t in enumerate(texts)])
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    totals = Counter()
    for (a, _), n in pairs.items():
        totals[a] += n
    counts = ngrams.ngram_counts(df)
    assert {(r.context, r.token): r["count"] for r in counts.collect()} == dict(pairs)
    best = {a: min((-n, b) for (x, b), n in pairs.items() if x == a)[1] for a in totals}
    assert {r.context: r.prediction for r in ngrams.predict_next(counts).collect()} == best
    got = {r.ord: r for r in ngrams.score_sequences(df, counts, 3).collect()}
    assert set(got) == {0, 1, 3}
    for i, r in got.items():
        grams = list(zip(texts[i], texts[i][1:]))
        loss = sum(-math.log((pairs[g] + 1) / (totals[g[0]] + 3)) for g in grams) / len(grams)
        assert r.loss == pytest.approx(loss)
        assert r.accuracy == pytest.approx(sum(best[a] == b for a, b in grams) / len(grams))
    trigrams = ngrams.ngram_counts(df, 3)
    assert {(r.context, r.token) for r in trigrams.collect()} == {
        ("a␟b", "a"), ("b␟a", "b"), ("a␟b", "c"), ("c␟a", "b"),
    }
    report = ngrams.split_report(df.withColumn("split", F.lit("x")), counts, 3).first()
    assert report.perplexity == pytest.approx(math.exp(report.loss))


def test_next_token_accuracy(rows):
    df = rows("predictions array<int>, labels array<int>", ([1, 2, 3], [9, 1, 5]), ([4], [4]), ([7, 7], [0, 7]))
    r = ngrams.next_token_accuracy(df).first()
    assert (r.n_tokens, r.accuracy) == (3, pytest.approx(2 / 3))


def test_wordpiece_limit_is_kept(spark):
    model = TokenModel("WORDPIECE", (*SPECIALS, "a", "##a"), max_word=1100)
    stored = from_tokenizer_json(to_tokenizer_json(model))
    assert stored == model
    df = spark.createDataFrame([(0, "a" * 1100), (1, "a" * 1101)], "ord long, item string")
    sizes = [len(r.ids) for r in df.select(enc.raw_ids(F.col("item"), stored).alias("ids"), "ord").orderBy("ord").collect()]
    assert sizes == [1100, 1]
    assert lib.Tokenizer.from_str(to_tokenizer_json(model)).encode("a" * 1100, add_special_tokens=False).ids == [len(SPECIALS)] + [len(SPECIALS) + 1] * 1099


def test_wordlevel_limit(spark):
    df = spark.createDataFrame([("aab",), ("ac",)], "item string")
    model = train_tokenizer(df, wordlevel_limit=len(SPECIALS) + 1)
    assert model.tokens == (*SPECIALS, "a")


def test_bpe_reads_only_parts_that_hold_its_merges(rows, monkeypatch, tmp_path, spark):
    """Two languages in many parts: same vocabulary as the library, few parts a round, nothing left behind."""
    import os

    from stringmill.operators.tokenizers import bpe, pair_index

    folders = []
    made = pair_index.shared_path
    monkeypatch.setattr(pair_index, "shared_path", lambda s, name: folders.append(made(s, name)) or folders[-1])
    # each letter has lines of its own
    lines = [c + "".join(random.Random(i).choices([c + "x", c + "y", c + "z" + c, c + "-"], k=20)) for i, c in enumerate("abcdefgh" * 6)]
    tok = lib.Tokenizer(BPE(unk_token="§"))
    tok.train_from_iterator(lines, BpeTrainer(vocab_size=65, special_tokens=SPECIALS, min_frequency=1, show_progress=False))
    for parts in (16, 100):
        model = bpe.train_merges(frame(rows, lines), 60, parts=parts)
        assert model.ids == tok.get_vocab()
        assert all(0 < read <= total == parts for _, read, total in model.reads) and sum(m for m, _, _ in model.reads) == len(model.merges)
        if parts == 16:
            assert sum(read for _, read, _ in model.reads) < 0.5 * sum(total for _, _, total in model.reads)
    assert folders and not any(os.path.exists(f) for f in folders)


def test_bpe_mapped_into_another_vocabulary(rows, spark):
    """Mapped ids stand for the same pieces; a token that never occurs is mapped as well."""
    from stringmill.operators.tokenizers.bpe import train_bpe
    from stringmill.plans.tokenized import build_tokenized_dataset, mapped_model

    lines = [x for x in corpus(3) if not set(x) & set("^_ §°")]
    into = rows("token string, id int", *[(f"old{i}", i) for i in range(600)])
    model = train_bpe(frame(rows, lines), 40)
    mapped = mapped_model(model, frame(rows, lines), into)
    assert len(mapped.tokens) == 600 and mapped.merges == model.merges
    assert {t for t in model.tokens if t not in SPECIALS[2:]} <= set(mapped.tokens[256:])
    assert mapped.pad_id == mapped.eos_id and mapped.tokens[:256] == tuple(f"old{i}" for i in range(256))
    old, new = ids_of(frame(rows, lines), model), ids_of(frame(rows, lines), mapped)
    assert [[mapped.tokens[i] for i in row] for row in new] == [[model.tokens[i] for i in row] for row in old]
    data = rows("split string, ord long, item string", *[(s, i, t) for i, t in enumerate(lines) for s in ("train", "validation")])
    encoded, built = build_tokenized_dataset(data, algorithm="BPE", vocab_size=40, into=into, max_length=6, multiple=1, cut_into="lost")
    assert built.tokens == mapped.tokens
    for r in encoded.collect():
        whole = new[r.ord]
        assert r.lost == max(0, len(whole) - 4) and r.input_ids == [mapped.bos_id, *whole[r.lost :], mapped.eos_id]
