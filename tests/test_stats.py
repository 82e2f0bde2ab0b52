import numpy as np
import pytest
from pyspark.sql import functions as F

from stringmill.operators import stats as ops
from stringmill.operators.frechet import embedding_stats, frechet_distance, with_embedding
from stringmill.plans.evaluation import evaluate_items, precompute_stats
from stringmill.plans.experiments import compare_groups
from stringmill.sources.sinks import load_stats, save_stats


def samples(rows, **groups):
    return rows("group string, value double", *[(g, v) for g, vs in groups.items() for v in vs])


def test_one_sample_example(rows):
    s = ops.sample_stats(samples(rows, a=[10.0, 11.0, 12.0, 13.0, 14.0]))
    want = {"two_sided": 0.0474207, "less": 0.0237103, "greater": 0.9762897}
    for alternative, p in want.items():
        r = ops.t_test_1samp(s, 14.0, alternative).first()
        assert r.t == pytest.approx(-2.8284271)
        assert r.p == pytest.approx(p, abs=1e-6)
        assert r.reject == (p < 0.05)


def test_two_sample_example(rows):
    s = ops.sample_stats(samples(rows, a=[10.0, 11.0, 12.0], b=[12.0, 13.0, 14.0]))
    base = s.where("group = 'a'")
    r = ops.t_test_against(s, base, "two-sided").where("group = 'b'").first()
    assert (r.test, r.df) == ("pooled", 4.0)
    assert r.t == pytest.approx(-2.4494897)
    assert r.p == pytest.approx(0.0704836, abs=1e-6)


def test_welch_when_spreads_differ(rows):
    a, b = [1.0, 2.0, 3.0, 4.0], [10.0, 20.0, 35.0, 70.0, 90.0]
    s = ops.sample_stats(samples(rows, a=a, b=b))
    r = ops.t_test_against(s, s.where("group = 'a'"), "auto").where("group = 'b'").first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    assert (r.test, r.alternative) == ("welch", "less")
    assert r.t == pytest.approx((np.mean(a) - np.mean(b)) / np.sqrt(va + vb))
    assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 4))


def test_groups_with_one_value(rows):
    df = samples(rows, a=[1.0, 2.0, 3.0], b=[9.0], c=[4.0, 5.0, 6.5])
    s = ops.sample_stats(df)
    assert ops.best_group(s, "higher").first().group == "c"
    assert ops.best_group(s, "higher", with_sample=False).first().group == "b"
    assert ops.best_group(s, "lower").first().group == "a"
    assert [r.group for r in ops.rank_groups(s).collect()] == ["a", "c", "b"]
    got = {r.group: r for r in compare_groups(df).collect()}
    assert got["b"].test == "one-sample" and got["b"].alternative == "less"
    assert got["c"].t == 0.0 and got["c"].baseline == "c"
    with pytest.raises(ValueError):
        ops.best_group(s, "upwards")


def test_normality(rows):
    rng = np.random.default_rng(1)
    normal, skewed = rng.normal(size=2000).tolist(), rng.exponential(size=2000).tolist()
    got = {r.group: r for r in ops.normality_check(samples(rows, n=normal, e=skewed)).collect()}
    assert got["n"].normal and not got["e"].normal
    x = np.array(skewed) - np.mean(skewed)
    skew, kurt = (x**3).mean() / (x**2).mean() ** 1.5, (x**4).mean() / (x**2).mean() ** 2 - 3
    assert got["e"].jb == pytest.approx(2000 / 6 * (skew**2 + kurt**2 / 4))


def vectors(rows, array):
    return rows("embedding array<double>", *[(v.tolist(),) for v in array])


def test_frechet_closed_forms(spark, rows, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 3))
    s = embedding_stats(vectors(rows, a))
    row = s.first()
    assert np.allclose(row.mu, a.mean(0)) and np.allclose(row.sigma, np.cov(a.T))
    assert frechet_distance(s, s) == pytest.approx(0.0, abs=1e-9)
    shifted = embedding_stats(vectors(rows, a + [1.0, 2.0, 0.0]))
    assert frechet_distance(s, shifted) == pytest.approx(5.0)
    scaled = embedding_stats(vectors(rows, 2 * a))
    want = (a.mean(0) ** 2).sum() + np.trace(np.cov(a.T))
    assert frechet_distance(s, scaled) == pytest.approx(want)
    save_stats(s, str(tmp_path / "s"))
    assert frechet_distance(load_stats(spark, str(tmp_path / "s")), scaled) == pytest.approx(want)
    with pytest.raises(ValueError):
        embedding_stats(vectors(rows, a[:1]))


def test_frechet_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    low, high = embedding_stats(rows.where("label < 5")), embedding_stats(rows.where("label >= 5"))
    assert frechet_distance(low, high) == pytest.approx(0.1377677, abs=1e-6)


def load_lengths():
    return lambda texts: np.stack([texts.str.len(), texts.str.count("C")], axis=1)


def test_evaluation(rows, tmp_path):
    gen = rows(
        "ord long, item string, valid boolean",
        *[(i, "" if i % 5 == 0 else "C" * (i % 7 + 1) + "N" * (i % 3), i % 5 != 0) for i in range(60)],
    )
    ref = rows("item string", *[("C" * (i % 9 + 1),) for i in range(40)])
    g, r = with_embedding(gen, load_lengths), with_embedding(ref, load_lengths)
    result = evaluate_items(g, r, n=20).first().asDict()
    first = [x for x in gen.orderBy("ord").limit(20).collect()]
    valid = [x.item for x in first if x.valid]
    assert result["Validity"] == len(valid) / 20
    assert result["Uniqueness"] == pytest.approx(len(set(valid)) / len(valid))
    seen = {x.item for x in ref.collect()}
    assert result["Novelty"] == pytest.approx(len(set(valid) - seen) / len(set(valid)))
    assert result["FCD GuacaMol"] == pytest.approx(np.exp(-0.2 * result["FCD"]))
    # the distance is taken of the first 20 valid rows, another population
    sample = [x.item for x in gen.orderBy("ord").collect() if x.valid][:20]
    own = embedding_stats(with_embedding(rows("item string", *[(t,) for t in sample]), load_lengths))
    assert result["FCD"] == pytest.approx(frechet_distance(own, embedding_stats(r)))
    stats = precompute_stats(r, str(tmp_path / "stats"))
    only = evaluate_items(g, stats=stats, n=20).first().asDict()
    assert set(only) == {"FCD", "FCD GuacaMol"} and only["FCD"] == pytest.approx(result["FCD"])
    with pytest.raises(ValueError):
        evaluate_items(g)
    with pytest.raises(ValueError, match="no canonical form"):
        precompute_stats(r.withColumn("item", F.lit(" ")), str(tmp_path / "x"))


def test_ragged_vectors_are_refused(spark):
    for parts in (1, 4):
        df = spark.createDataFrame([([1.0, 2.0],), ([3.0],), ([4.0, 5.0, 6.0],), ([7.0, 8.0],)], "embedding array<double>")
        with pytest.raises(Exception, match="different lengths"):
            embedding_stats(df.repartition(parts)).collect()
