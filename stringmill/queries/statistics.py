"""Group statistics, significance tests, moments of vectors, scalar formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, scores
from ..operators import stats as ops
from ..operators.frechet import (
    covariance_entries,
    embedding_stats as moments,
    frechet_distance,
    with_embedding,
)
from ..plans.evaluation import evaluate_items as evaluate
from ..plans.evaluation import precompute_stats
from ..plans.experiments import compare_groups as compare
from ..sources.shared import shared_path
from ..sources.sinks import load_stats
from .registry import query, table

_SAMPLES = """
WITH s AS (
  SELECT concat('line ', l_returnflag) AS "group", l_extendedprice AS value FROM lineitem
  UNION ALL SELECT concat('order ', o_orderpriority), o_totalprice FROM orders
  UNION ALL SELECT 'mean balance', avg(c_acctbal) FROM customer
), st AS (
  SELECT "group", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS var
  FROM s GROUP BY "group"
)"""


def _p(t: str, df: str, side: str) -> str:
    """Tail probability by Simpson's rule on the density."""
    x = f"(abs({t}) * i / 2000.0)"
    density = (
        f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
        f" * pow(1 + {x} * {x} / {df}, -({df} + 1) / 2)"
    )
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = (
        f"(list_sum(list_transform(range(0, 2001), lambda i: ({weight}) * {density})) * abs({t}) / 2000.0 / 3)"
    )
    above = f"(0.5 - sign({t}) * {area})"
    return (
        f"CASE WHEN {side} = 'greater' THEN {above} WHEN {side} = 'less' THEN 1 - {above}"
        f" ELSE 2 * least({above}, 1 - {above}) END"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("line "), F.col("l_returnflag")).alias("group"), F.col("l_extendedprice").alias("value")
    )
    order = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderpriority")), "o_totalprice"
    )
    single = table(spark, sf_dir, "customer").agg(F.avg("c_acctbal").alias("value"))
    return line.union(order).union(single.select(F.lit("mean balance"), "value"))


def _rounded(rows: DataFrame, /, **digits: int) -> DataFrame:
    return rows.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    _SAMPLES
    + ' SELECT "group", n, round(mean, 4) AS mean, round(std, 4) AS std, round(var, 0) AS var FROM st'
)
def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.sample_stats(samples(spark, sf_dir)), mean=4, std=4, var=0)


_ONE = """, tt AS (SELECT *, (mean - 60000.0) / (std / sqrt(n)) AS t, CAST(n - 1 AS DOUBLE) AS df FROM st WHERE n > 1)"""


@query(
    _SAMPLES
    + _ONE
    + f""" SELECT "group", n, round(t, 6) AS t, df, round({_p('t', 'df', "'two-sided'")}, 6) AS p,
  {_p('t', 'df', "'two-sided'")} < 0.05 AS reject FROM tt"""
)
def t_test_one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ops.sample_stats(samples(spark, sf_dir)).where("n > 1")
    tested = ops.t_test_1samp(stats, 60_000.0, "two_sided")
    return _rounded(tested.select("group", "n", "t", "df", "p", "reject"), t=6, p=6)


def _compare_sql(best: str, alternative: str, rows: str) -> str:
    return (
        _SAMPLES
        + f""", b AS (SELECT "group" AS baseline, n AS bn, mean AS bm, var AS bv, std AS bs FROM st WHERE n > 1 ORDER BY {best} LIMIT 1),
w AS (SELECT *, n > 1 AND (bs > 2 * std OR std > 2 * bs) AS welch FROM st, b),
e AS (SELECT *, CASE WHEN n = 1 THEN (bm - mean) / (bs / sqrt(bn))
    WHEN welch THEN (bm - mean) / sqrt(bv / bn + var / n)
    ELSE (bm - mean) / sqrt(((bn - 1) * bv + (n - 1) * var) / (bn + n - 2) * (1.0 / bn + 1.0 / n)) END AS t,
  CASE WHEN n = 1 THEN bn - 1.0
    WHEN welch THEN pow(bv / bn + var / n, 2) / (pow(bv / bn, 2) / (bn - 1) + pow(var / n, 2) / (n - 1))
    ELSE bn + n - 2.0 END AS df,
  {alternative} AS alternative FROM w)
SELECT "group", baseline, n, CASE WHEN n = 1 THEN 'one-sample' WHEN welch THEN 'welch' ELSE 'pooled' END AS test,
  alternative, round(t, 6) AS t, round(df, 4) AS df, round({_p('t', 'df', 'alternative')}, 6) AS p,
  {_p('t', 'df', 'alternative')} < 0.05 AS reject FROM e {rows}"""
    )


_AUTO = "CASE WHEN bm < mean THEN 'less' ELSE 'greater' END"


def _test_columns(df: DataFrame) -> DataFrame:
    names = ("group", "baseline", "n", "test", "alternative", "t", "df", "p", "reject")
    return _rounded(df.select(*names), t=6, df=4, p=6)


@query(_compare_sql('mean DESC, "group"', _AUTO, ""))
def compare_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_columns(compare(samples(spark, sf_dir)))


@query(_compare_sql('mean, "group"', "'less'", "WHERE n > 1"))
def t_test_two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ops.sample_stats(samples(spark, sf_dir))
    best = ops.best_group(stats, "lower")
    return _test_columns(ops.t_test_against(stats.where("n > 1"), best, "less"))


@query(
    _SAMPLES
    + """ SELECT * FROM (SELECT 'higher' AS direction, "group", n FROM st WHERE n > 1 ORDER BY mean DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'lower', "group", n FROM st ORDER BY mean LIMIT 1)"""
)
def best_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of the samples, and lowest of all groups, single values included."""
    stats = ops.sample_stats(samples(spark, sf_dir))
    high = ops.best_group(stats, "higher").select(F.lit("higher").alias("direction"), "group", "n")
    low = ops.best_group(stats, "lower", with_sample=False)
    return high.unionByName(low.select(F.lit("lower").alias("direction"), "group", "n"))


@query(_SAMPLES + ' SELECT "group", n FROM st ORDER BY mean DESC, "group"')
def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ops.sample_stats(samples(spark, sf_dir))
    return ops.rank_groups(stats, descending=True).select("group", "n")


@query(
    """
WITH s AS (SELECT event_type AS "group", value FROM events),
m AS (SELECT "group", avg(value) AS mu FROM s GROUP BY "group"),
c AS (SELECT "group", count(*) AS n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3,
             avg(pow(value - mu, 4)) AS m4 FROM s JOIN m USING ("group") GROUP BY "group"),
j AS (SELECT "group", n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM c),
k AS (SELECT *, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jb FROM j)
SELECT "group", n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(jb, 3) AS jb,
       round(exp(-jb / 2), 6) AS p, exp(-jb / 2) > 0.05 AS normal FROM k"""
)
def normality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), "value")
    return _rounded(ops.normality_check(rows), skew=6, kurt=6, jb=3, p=6)


_COV = """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
mu AS (SELECT i, avg(v) AS mu_i FROM e GROUP BY i),
p AS (SELECT a.i AS i, b.i AS j, covar_samp(a.v, b.v) AS cov FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i)
SELECT CAST(p.i AS INT) AS i, CAST(p.j AS INT) AS j, round(mu_i, 8) AS mu_i, round(cov, 8) AS cov FROM p JOIN mu ON p.i = mu.i"""


@query(_COV)
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = moments(table(spark, sf_dir, "embeddings"))
    return _rounded(covariance_entries(stats), mu_i=8, cov=8).select("i", "j", "mu_i", "cov")


@query(_COV)
def stored_embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments precomputed, written, and read back."""
    path = shared_path(spark, "moments")
    rows = table(spark, sf_dir, "embeddings").withColumn("item", F.col("label").cast("string"))
    precompute_stats(rows, path)
    entries = covariance_entries(load_stats(spark, path))
    return _rounded(entries, mu_i=8, cov=8).select("i", "j", "mu_i", "cov")


@query()
def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the vectors of low and of high labels, and its score."""
    rows = table(spark, sf_dir, "embeddings")
    a, b = moments(rows.where("label < 5")), moments(rows.where("label >= 5"))
    distance = F.lit(frechet_distance(a, b))
    return spark.range(1).select(
        F.round(distance, 7).alias("distance"),
        F.round(scores.score_from_distance(distance), 7).alias("score"),
        F.round(scores.distance_from_score(scores.score_from_distance(distance)), 7).alias("back"),
    )


def _plane(a: str, b: str) -> str:
    """Moments of two sides in two dimensions, and their distance: the root of a 2 x 2 matrix has a closed form."""
    return f"""
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT 1 AS side, * FROM e WHERE {a} UNION ALL SELECT 2, * FROM e WHERE {b}),
m AS (SELECT side, avg(x) AS x, avg(y) AS y, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM s GROUP BY side),
t AS (SELECT (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + p.a + p.c + q.a + q.c AS sums, p.a * q.a + 2 * p.b * q.b + p.c * q.c AS trace,
             (p.a * p.c - p.b ** 2) * (q.a * q.c - q.b ** 2) AS det
      FROM m p, m q WHERE p.side = 1 AND q.side = 2),
d AS (SELECT sums - 2 * sqrt(trace + 2 * sqrt(det)) AS distance FROM t)"""


def _in_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("label "), "label"))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("ord"), item.alias("item"), F.slice("embedding", 1, 2).alias("embedding"), "label")


@query(_plane("label < 5", "label >= 5") + " SELECT round(distance, 9) AS distance, round(exp(-0.2 * distance), 9) AS score FROM d")
def frechet_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance on the first two components."""
    rows = _in_plane(spark, sf_dir)
    distance = F.lit(frechet_distance(moments(rows.where("label < 5")), moments(rows.where("label >= 5"))))
    return spark.range(1).select(F.round(distance, 9).alias("distance"), F.round(scores.score_from_distance(distance), 9).alias("score"))


@query(
    _plane("label BETWEEN 1 AND 5", "label >= 3")
    + """, g AS (SELECT count(*) AS n, count_if(label > 0) AS valid, count(DISTINCT label) FILTER (label > 0) AS uniq,
              count(DISTINCT label) FILTER (label > 0 AND label NOT IN (SELECT label FROM e WHERE label >= 3)) AS novel FROM e WHERE label < 6)
SELECT round(distance, 9) AS "FCD", round(exp(-0.2 * distance), 9) AS "FCD GuacaMol", round(valid / n, 9) AS "Validity",
       round(uniq / valid, 9) AS "Uniqueness", round(novel / uniq, 9) AS "Novelty" FROM d, g"""
)
def evaluate_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set metrics, and the distance of the valid rows on two components."""
    rows = _in_plane(spark, sf_dir)
    gen = rows.where("label < 6").withColumn("valid", F.col("item") != "")
    result = evaluate(gen, rows.where("label >= 3"))
    return result.select(*[F.round(f"`{c}`", 9).alias(c) for c in result.columns])


@query(
    _plane("vec_id IN (SELECT vec_id FROM embeddings WHERE label BETWEEN 1 AND 5 ORDER BY vec_id LIMIT 60)", "label >= 3")
    + """, g AS (SELECT count_if(label > 0) AS valid, count(DISTINCT label) FILTER (label > 0) AS uniq,
              count(DISTINCT label) FILTER (label > 0 AND label < 3) AS novel, count(*) AS n
       FROM (SELECT label FROM embeddings WHERE label < 6 ORDER BY vec_id LIMIT 60))
SELECT round(distance, 9) AS "FCD", round(exp(-0.2 * distance), 9) AS "FCD GuacaMol", round(valid / n, 9) AS "Validity",
       round(uniq / valid, 9) AS "Uniqueness", round(novel / uniq, 9) AS "Novelty" FROM d, g"""
)
def evaluate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the first rows, and against stored reference rows."""
    rows = _in_plane(spark, sf_dir)
    gen = rows.where("label < 6").withColumn("valid", F.col("item") != "")
    result = evaluate(gen, rows.where("label >= 3"), n=60)
    return result.select(*[F.round(f"`{c}`", 9).alias(c) for c in result.columns])


def _text_lengths():
    import numpy as np

    return lambda texts: np.stack(
        [texts.str.len(), texts.str.count(" "), texts.str.count("e")], axis=1
    ).astype("float32")


@query(
    """
WITH e AS (SELECT CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS b,
                  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS c FROM documents)
SELECT round(avg(a), 4) AS mean_0, round(avg(b), 4) AS mean_1, round(avg(c), 4) AS mean_2,
       round(covar_samp(a, b) / 1e6, 6) AS cov_01, round(var_samp(c) / 1e6, 6) AS cov_22 FROM e"""
)
def text_embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable embedding function on texts, then its moments."""
    rows = with_embedding(table(spark, sf_dir, "documents"), _text_lengths, "text")
    s = moments(rows)
    sigma = F.col("sigma")
    return s.select(
        *[F.round(F.col("mu")[i], 4).alias(f"mean_{i}") for i in range(3)],
        F.round(sigma[0][1] / 1e6, 6).alias("cov_01"),
        F.round(sigma[2][2] / 1e6, 6).alias("cov_22"),
    )


@query()
def evaluate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set metrics and distance of one half of the vectors against the other."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"),
        F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("label "), "label")).alias("item"),
        "embedding",
        "label",
    )
    gen = rows.where("label < 6").withColumn("valid", F.col("item") != "")
    result = evaluate(gen, rows.where("label >= 3"))
    return result.select(*[F.round(f"`{c}`", 7).alias(c) for c in result.columns])


@query(
    """
SELECT o_orderkey,
  CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, ' ELSE concat(s // 86400, ' days, ') END
    || printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS duration,
  CAST(round_even(o_totalprice / 1000, 0) AS INT) AS epochs,
  printf('%.4f', o_totalprice / 7) AS four, printf('%.2f', o_totalprice / 7) AS two,
  printf('%.2f', o_totalprice * 100 / 1048576.0) || 'M' AS size,
  o_orderpriority AS stem
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)"""
)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, epochs, metric formats, size labels and path stems."""
    price = F.col("o_totalprice")
    path = F.concat(F.lit("out/run.1/"), "o_orderpriority", F.lit(".tar/"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        formats.format_duration(F.floor(price)).alias("duration"),
        formats.round_epoch(price / 1000).alias("epochs"),
        formats.format_metric(price / 7, ".4f").alias("four"),
        formats.format_metric(price / 7, ".2f").alias("two"),
        formats.model_size_label(price * 100).alias("size"),
        formats.path_stem(path).alias("stem"),
    )


@query(
    """
SELECT event_id, round(exp(-0.2 * value), 8) AS score, round(-5 * ln(exp(-0.2 * value)), 6) AS distance,
       round(exp(value / 100), 8) AS perplexity FROM events"""
)
def score_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    score = scores.score_from_distance(value)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(score, 8).alias("score"),
        F.round(scores.distance_from_score(score), 6).alias("distance"),
        F.round(scores.perplexity(value / 100), 8).alias("perplexity"),
    )
