import random

import pytest
from pyspark.sql import functions as F

from stringmill.functions.text import trimmed
from stringmill.operators import cuts, dedup
from stringmill.operators.canonical import with_canonical, with_canonical_udf
from stringmill.operators.quality import basic_stats
from stringmill.operators.skew import grid_join, grid_shape, hot_hashes, is_small, lookup_join
from stringmill.operators.tally import tally
from stringmill.plans.labelling import (
    item_table,
    item_tally,
    label_generated_items,
    novel_items,
)
from stringmill.sources.sinks import tally_json


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_keys_are_salted_without_changing_the_result(rows, how):
    data = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(900, None), (901, "none")]
    left = rows("ord long, key string", *data)
    right = rows("key string, v int", ("hot", 1), ("k0", 2), ("k3", 3), (None, 4))
    plain = left.alias("l").join(
        right.alias("r"), F.col("l.key").eqNullSafe(F.col("r.key")), how
    )
    cols = ["l.ord", "l.key"] + (["r.v"] if how in ("left", "inner") else [])
    names = ["ord", "key"] + (["v"] if how in ("left", "inner") else [])
    key = lambda r: (r[0], str(r))
    want = sorted((tuple(r) for r in plain.select(*cols).collect()), key=key)
    got = lookup_join(left, right, "key", how, hot_rows=20)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == want
    assert hot_hashes(left, ["key"], 20).count() == 1
    counted = right.join(left.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    again = lookup_join(left, counted, "key", how, hot_rows=20, row_count="n")
    assert sorted((tuple(r) for r in again.select(*names).collect()), key=key) == want


@pytest.mark.parametrize("small", [True, False])
def test_grid_join_cuts_keys_hot_on_either_side(spark, rows, monkeypatch, small):
    if not small:
        monkeypatch.setattr("stringmill.operators.skew.SMALL_ROWS", -1)
    sides = {"both": (200, 300), "left": (900, 2), "right": (1, 700), "few": (3, 4), "no right": (5, 0), None: (2, 2)}
    left = [(k, f"{k} {i}") for k, (n, _) in sides.items() for i in range(n)]
    right = [(k, f"{k} {i}") for k, (_, n) in sides.items() for i in range(n)]
    a, b = rows("k string, a string", *left), rows("k string, b string", *right)
    got = [(r.k, r.a, r.b) for r in grid_join(a, b, "k", "a", "b", cell_pairs=400).collect()]
    want = [(k, x, y) for k, x in left for j, y in right if k is not None and j == k]
    assert len(got) == len(want) and set(got) == set(want)
    shape = {r["k"]: (r["__rows"], r["__cols"]) for r in grid_shape(a, b, "k", 400).collect()}
    assert shape == {"both": (10, 15), "left": (5, 1), "right": (1, 2)} | {k: v for k, v in shape.items() if k is None}


def test_grid_join_with_many_hot_keys(spark):
    a = spark.range(2000 * 12).select((F.col("id") % 2000).alias("k"), F.col("id").alias("a"))
    b = spark.range(2000 * 9).select((F.col("id") % 2000).alias("k"), F.col("id").alias("b"))
    assert grid_shape(a, b, "k", 16).count() == 2000
    pairs = grid_join(a, b, "k", "a", "b", cell_pairs=16)
    assert pairs.agg(F.count("*"), F.count_distinct("a", "b"), F.count_if(F.col("a") % 2000 != F.col("b") % 2000)).first() == (216000, 216000, 0)


def test_small_tables_are_recognised(rows, monkeypatch):
    df = rows("a string", ("x" * 100,), ("y",))
    assert is_small(df)
    monkeypatch.setattr("stringmill.operators.skew.SMALL_BYTES", 50)
    assert not is_small(df)
    monkeypatch.setattr("stringmill.operators.skew.SMALL_ROWS", 1)
    assert not is_small(df)


def test_keep_first(rows):
    df = rows("ord long, a string, b int", (3, "x", 1), (1, "x", 2), (2, "y", 3), (4, None, 4), (5, None, 5))
    got = dedup.drop_duplicates(df, "a")
    assert got.columns == ["ord", "a", "b"]
    assert sorted(r.b for r in got.collect()) == [2, 3, 4]
    assert dedup.drop_duplicates(df).count() == 5


def test_first_seen_and_singletons(rows):
    df = rows("batch int, ord long, key string", (2, 1, "a"), (1, 9, "a"), (1, 8, "b"), (1, 7, "a"))
    assert collected(dedup.first_seen(df), "batch", "ord", "key") == [(1, 7, "a"), (1, 8, "b")]
    assert collected(dedup.flag_singleton(df), "key", "unique") == [
        ("a", False),
        ("a", False),
        ("a", False),
        ("b", True),
    ]


def test_decontaminate_with_nulls(rows):
    train = rows("item string", ("a",), ("a",), ("b",), (None,), ("c",))
    known = rows("item string", ("b",), (None,), ("z",))
    assert collected(dedup.decontaminate(train, known), "item") == [("a",), ("c",)]
    with_null = dedup.decontaminate(train, rows("item string", ("b",)))
    assert {r.item for r in with_null.collect()} == {"a", "c", None}
    assert dedup.leak_report(train, known).first()[0] == 2
    dedup.assert_disjoint(train, rows("item string", ("q",)))
    with pytest.raises(ValueError):
        dedup.assert_disjoint(train, known)


def test_reports_and_set_operations(rows):
    gen = rows("ord long, key string", (1, "a"), (2, "a"), (3, "b"), (4, "c"))
    known = rows("key string", ("a",), ("z",))
    assert tuple(dedup.dedup_report(gen, known, "key").first()) == (4, 3, 2)
    assert tuple(dedup.dedup_report(gen.limit(0), known, "key").first()) == (0, 0, 0)
    assert collected(dedup.difference(gen, known), "ord") == [(3,), (4,)]
    assert collected(dedup.intersection(gen, known), "ord") == [(1,), (2,)]
    assert dedup.union_sets(gen.select("key"), known).count() == 4
    assert collected(dedup.flag_novel(gen, known), "ord", "novel") == [
        (1, False),
        (2, False),
        (3, True),
        (4, True),
    ]


def test_exact_split_sizes_and_repeatability(rows):
    df = rows("ord long, item string", *[(i, f"t{i % 17}") for i in range(203)])
    split = cuts.random_split(df, 10, 15, seed=1)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"validation": 20, "test": 30, "train": 153}
    again = cuts.random_split(df.repartition(5), 10, 15, seed=1)
    assert collected(split, "ord", "split") == collected(again, "ord", "split")
    other = cuts.random_split(df, 10, 15, seed=2)
    assert collected(split, "ord", "split") != collected(other, "ord", "split")
    only_train = cuts.random_split(df, 0, 0)
    assert {r.split for r in only_train.collect()} == {"train"}


def test_first_rows(rows, monkeypatch):
    order = random.Random(5).sample(range(-5000, 5000), 3000)
    df = rows("ord long, v int", *[(o, 1) for o in order])
    want = sorted(order)
    monkeypatch.setattr(cuts, "TOP_ROWS", 50)
    monkeypatch.setattr(cuts, "RANKED_ROWS", 60)
    for n in (1, 49, 51, 500, 2999, 3000):
        assert sorted(r.ord for r in cuts.first_n(df, n).collect()) == want[:n]
    assert cuts.cap_rows(df, 10_000).count() == 3000
    with pytest.raises(ValueError):
        cuts.first_n(df, 3001)


def test_heaviest_rows(rows):
    rng = random.Random(2)
    data = [(f"t{i}", rng.choice([1, 2, 3, 4, 7, 8, 9, 1000, 2**40])) for i in range(200)]
    df = rows("token string, w long", *data)
    want = sorted(data, key=lambda r: (-r[1], r[0]))
    for n in (1, 5, 60, 199, 500):
        got = [tuple(r) for r in cuts.heaviest(df, F.col("w"), n, "token").collect()]
        assert got == want[:n]


def test_canonical_forms(rows):
    df = rows("ord long, item string", (1, " a "), (2, "  "), (3, "grow"), (4, " a "))
    assert [r.canonical for r in with_canonical(df).orderBy("ord").collect()] == ["a", None, "grow", "a"]
    # a function that changes its own result has no stable form
    unstable = with_canonical(df, fn=lambda c: F.concat(c, F.lit("x")))
    assert unstable.where("canonical is not null").count() == 0

    def upper(s):
        return s.strip().upper() if s.strip() else None

    got = with_canonical_udf(df, upper)
    assert [r.canonical for r in got.orderBy("ord").collect()] == ["A", None, "GROW", "A"]
    grown = with_canonical_udf(df, lambda s: s + "x")
    assert grown.where("canonical is not null").count() == 0
    assert with_canonical_udf(df, lambda s: s + "x", double_check=False).where("canonical is null").count() == 0
    with pytest.raises(Exception, match="no canonical form"):
        with_canonical(df, strict=True).collect()


def test_tally_and_fractions(rows):
    df = rows("v int", *[(i,) for i in range(10)])
    v = F.col("v")
    t = tally(df, {"all": v >= 0, "big": v > 4, "none": v > 99, "after": v > 99})
    got = [(r.counter, r["count"], r.absolute_fraction, r.relative_fraction) for r in t.collect()]
    assert got[:3] == [("all", 10, 1.0, 1.0), ("big", 5, 0.5, 0.5), ("none", 0, 0.0, 0.0)]
    assert got[3][3] != got[3][3]  # nothing of nothing is NaN
    text = tally_json(t).first().value
    assert text.startswith('{"counts":{"all":10,"big":5,"none":0,"after":0},"absolute_fractions":{"all":1.0')
    with pytest.raises(ValueError):
        tally(df, {})


def test_basic_stats(rows):
    gen = rows("canonical string", ("a",), ("a",), ("b",), (None,))
    ref = rows("item string", ("b",), ("b",), ("q",), (None,))
    assert tuple(basic_stats(gen, ref).first()) == (0.75, pytest.approx(2 / 3), 0.5)
    assert tuple(basic_stats(gen.limit(0), ref).first()) == (0.0, 0.0, 0.0)
    invalid = gen.where("canonical is null")
    assert tuple(basic_stats(invalid, ref).first()) == (0.0, 0.0, 0.0)


def brute_labels(gen, known):
    """Batch after batch with Python sets."""
    seen, out, counters = set(), [], [0, 0, 0, 0]
    for batch in sorted({b for b, _, _ in gen}):
        texts = {}
        for b, o, t in sorted(gen):
            t = t.replace("^", "").replace(" ", "").replace("_", "")
            if b == batch and t:
                texts.setdefault(t, o)
        valid = {t for t in texts if "!" not in t}
        fresh = valid - seen
        seen |= valid
        counters = [c + len(x) for c, x in zip(counters, (texts, valid, fresh, fresh - known))]
        out += [(batch, o, t) for t, o in texts.items()]
    keys = [t for _, _, t in out]
    rows = {(b, o, t, "!" not in t, keys.count(t) == 1, t not in known) for b, o, t in out}
    return rows, counters


def test_labels_equal_brute_force(rows):
    rng = random.Random(3)
    gen = [
        (i % 6, i, rng.choice(["^C", "C_", "CO ", "N!", "N", "!", "", " _", "Cl", "^Br_", f"X{i}"]))
        for i in range(120)
    ]
    known = {"CO", "X3", "N!"}

    def form(c):
        return F.when(~c.contains("!"), c)

    labelled = label_generated_items(
        rows("batch int, ord long, item string", *gen), rows("item string", *[(k,) for k in known]), form
    )
    want, counters = brute_labels(gen, known)
    got = collected(labelled, "batch", "ord", "item", "valid", "unique", "novel")
    assert got == sorted(want)
    assert [r["count"] for r in item_tally(labelled).orderBy("idx").collect()] == counters
    assert item_table(labelled).columns == ["smiles", "canonical_smiles", "valid", "unique", "novel"]
    assert novel_items(labelled).count() == counters[3]


def test_default_form_trims(rows):
    df = rows("t string", (" x ",), ("",), (None,))
    assert [r[0] for r in df.select(trimmed(F.col("t"))).collect()] == ["x", None, None]


@pytest.mark.parametrize("kind", ["long", "string", "double", "timestamp", "struct<a: string, b: bigint>"])
def test_rank_of_any_type(spark, kind):
    """Repeated values, extremes and a value that fills most of the range."""
    rng = random.Random(len(kind))
    numbers = [rng.choice([5, 5, 5, rng.randint(-(2**40), 2**40), rng.randint(0, 50)]) for _ in range(2000)]
    if kind.startswith("struct"):
        column, values = F.struct((F.col("x") % 7).cast("string").alias("a"), F.col("x").alias("b")), None
    elif kind == "timestamp":
        column, values = F.timestamp_seconds(F.abs("x") % 10**9), None
    else:
        column, values = F.col("x").cast(kind), None
    df = spark.createDataFrame([(x,) for x in numbers], "x long").select(column.alias("v")).repartition(5)
    values = [r["v"] for r in df.orderBy("v").collect()]
    for rank in (1, 2, 700, 1001, 1999, 2000):
        assert cuts.rank_value(df, rank, ranked_rows=10) == values[rank - 1]
    with pytest.raises(ValueError):
        cuts.rank_value(df, 2001)


def test_cap_with_nulls_and_by_any_order(spark):
    df = spark.createDataFrame([(None, 0), *((f"k{i:04d}", i) for i in range(300))], "ord string, i int").repartition(4)
    for n in (1, 2, 150, 300, 301, 400):
        got = sorted(r["i"] for r in cuts.cap_rows(df, n, top_rows=0, ranked_rows=16).collect())
        assert got == sorted([0, *range(300)])[: min(n, 301)] or n < 301 and len(got) == n
