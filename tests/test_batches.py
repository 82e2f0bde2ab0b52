"""What the Python side holds at once follows the bytes of a run of rows, whatever a batch has."""

import pyarrow as pa
import pytest

from stringmill.functions.text import SPECIAL_TOKENS
from stringmill.operators import batches, canonical
from stringmill.operators.tokenizers import encode as enc
from stringmill.operators.tokenizers.model import PREFIX, TokenModel

LONG = "ab" * (batches.SLICE_SIZE // 2 + 5)
TEXTS = ["abc" * 500, None, "", "xé"] * 1500 + [LONG, "a", None]
MODELS = {
    "WORDLEVEL": TokenModel("WORDLEVEL", (*SPECIAL_TOKENS, "a", "b", "c")),
    "BPE": TokenModel("BPE", (*SPECIAL_TOKENS, "a", "b", "c", "ab"), merges=(("a", "b"),)),
    "WORDPIECE": TokenModel("WORDPIECE", (*SPECIAL_TOKENS, "a", *(PREFIX + c for c in "abc")), max_word=2_000_000),
}


def runs(monkeypatch, make, column):
    """What a function for columns of batches makes of one batch."""
    made = []
    monkeypatch.setattr(enc.F, "arrow_udf", lambda kind: lambda f: made.append(f) or f)
    make()
    return list(made[0](iter([column])))


@pytest.mark.parametrize("algorithm", ["WORDLEVEL", "BPE"])
def test_encoding_and_decoding_hold_runs_of_rows(monkeypatch, algorithm):
    model = MODELS[algorithm]
    make = {"WORDLEVEL": enc._chars_udf, "BPE": enc._bpe_udf}[algorithm]
    column = pa.array(TEXTS, pa.string())
    found = runs(monkeypatch, lambda: make(model), column)
    assert len(found) > 3 and sum(map(len, found)) == len(TEXTS)
    assert max(len(x.values) for x in found) <= batches.SLICE_SIZE + len(LONG)
    ids = [i for x in found for i in x.to_pylist()]
    unk = model.unk_id
    plain = [[model.ids.get(c, unk) for c in t or ""] for t in TEXTS]
    if algorithm == "WORDLEVEL":
        assert ids == plain
    assert ids[-2] == [model.ids["a"]] and ids[1] == ids[2] == [] and ids[3] == [unk, unk]
    monkeypatch.setattr(enc.F, "arrow_udf", lambda kind: lambda f: lambda column: list(f(iter([column]))))
    shown = enc.decode(pa.array(ids, pa.list_(pa.int32())), model)
    assert sum(map(len, shown)) == len(TEXTS) and len(shown) > 1
    assert [t for x in shown for t in x.to_pylist()] == [(t or "").replace("xé", "") for t in TEXTS]


def test_lines_are_encoded_in_runs(monkeypatch):
    found = runs(monkeypatch, lambda: enc._line_udf(enc._wordpiece_line(MODELS["WORDPIECE"])), pa.array(["aab"] * 10 + [LONG] * 3))
    assert [len(x) for x in found] == [11, 1, 1]


def test_canonical_forms_are_made_in_runs(monkeypatch, rows):
    texts = [f"{i} " + "a" * 100_000 for i in range(30)] + [None, "b"]
    made = []
    kept = canonical.F.arrow_udf
    monkeypatch.setattr(canonical.F, "arrow_udf", lambda kind: lambda f: made.append(f) or kept(kind)(f))
    got = canonical.with_canonical_udf(rows("ord long, item string", *enumerate(texts)), str.strip).orderBy("ord").collect()
    assert [r.canonical for r in got] == texts
    found = list(made[0](iter([pa.array([f" {t}" if t else t for t in texts])])))
    assert len(found) > 2 and [t for x in found for t in x.to_pylist()] == texts


def test_join_encoding_moves_distinct_pieces_only(monkeypatch, rows):
    """Any kind of pieces, repeated and null row ids, tokens that the vocabulary lacks, in many blocks."""
    from pyspark.sql import functions as F

    from stringmill.functions.pieces import pretokenize

    data = [(i, t) for i, t in enumerate(["CCOc1ccccc1" * 20, "N[C@@H](C)C", "", None, "xéz" * 50, "C"] * 5)]
    data += [(3, "CN"), (4, "OO"), (None, "CC"), (None, "N"), (70, "")]
    df = rows("ord long, item string", *data)
    moved = []
    join = enc.lookup_join
    monkeypatch.setattr(enc, "lookup_join", lambda left, *a, **b: moved.append(left.count()) or join(left, *a, **b))
    vocab = rows("token string, id int", ("C", 5), ("c", 6), ("O", 7), ("N", 8), ("é", 9), ("[C@@H]", 10), ("x", None))
    for size in (500, enc.BLOCK_CHARS):
        monkeypatch.setattr(enc, "BLOCK_CHARS", size)
        for kind in ("CHAR", "SMARTS"):
            got = {r.ord: r.ids for r in enc.encode_wordlevel_join(df, vocab, 3, kind).collect()}
            ids = {r.token: 3 if r.id is None else r.id for r in vocab.collect()}
            want = {}
            for r in df.select("ord", F.posexplode(pretokenize(F.col("item"), kind)).alias("pos", "token")).collect():
                want.setdefault(r.ord, []).append((r.pos, ids.get(r.token, 3)))
            assert got == {k: [i for _, i in sorted(v)] for k, v in want.items()}
    assert all(n <= 12 * 30 for n in moved) and moved[2] <= 14  # over 1,800 pieces


def test_join_encoding_of_a_vocabulary_with_repeated_tokens(rows):
    df = rows("ord long, item string", (1, "abca"), (2, "b"))
    vocab = rows("token string, id long", ("a", 9), ("a", 4), ("b", 1))
    got = {r.ord: r.ids for r in enc.encode_wordlevel_join(df, vocab, 0).collect()}
    assert got == {1: [4, 9, 1, 0, 4, 9], 2: [1]}


def test_pairs_are_counted_on_packed_lines(monkeypatch):
    """The same counts from a table of all pairs and from sorted pairs, on as few bytes as the ids need."""
    import random
    from collections import Counter

    import numpy as np

    from stringmill.operators.tokenizers import merges

    for end in (7, 300, 70_000):
        lines = [[random.Random(f"{end} {i}").randrange(end) for i in range(a, a + 1 + a % 9)] for a in range(200)]
        flat = merges.flatten(np.concatenate(lines), np.cumsum([0, *map(len, lines)]), end, np.min_scalar_type(end))
        assert flat.itemsize == {7: 1, 300: 2, 70_000: 4}[end]
        want = Counter(merges.pair_code(a, b) for x in lines for a, b in zip(x, x[1:]))
        for most in (0, merges.MAX_SQUARE):
            monkeypatch.setattr(merges, "MAX_SQUARE", most)
            codes, counts = merges.count_pairs(flat, end)
            assert dict(zip(codes.tolist(), counts.tolist())) == want
        monkeypatch.undo()


def test_training_stores_a_byte_a_symbol(monkeypatch, rows):
    """Lines with several uses, of one symbol, blank, null and with marks: packed and pruned without loss."""
    from stringmill.operators.tokenizers import bpe, pair_index

    sizes = []
    made = pair_index.PairIndex._store
    monkeypatch.setattr(pair_index.PairIndex, "_store", lambda self, *a: made(self, *a) or sizes.append(self.spark.read.schema("symbols binary").parquet(f"{self.root}/v{self.version}").selectExpr("sum(length(symbols))").first()[0]))
    lines = ["ab", "ab", "aab", "a", "", None, "abé", "éé"] * 3
    df = rows("ord long, item string", *enumerate(lines))
    model = bpe.train_bpe(df, 6)
    assert model.merges == (("a", "b"), ("a", "ab"), ("é", "é"))
    assert sizes[0] == 2 + 3 + 3 + 2 + 4  # symbols and ends of the distinct lines with a pair
    piece = bpe.train_wordpiece(df, 9)
    assert piece.merges[0] == ("a", "##b") and set(piece.tokens) >= {"a", "b", "é", "##a", "##b", "##é"}
