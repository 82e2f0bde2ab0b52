"""Documents as a stream of generated items that arrives in quarters; the stream is started anew for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.labelling import clean_items
from ..sources.shared import shared_path
from ..streaming import samples as ops
from . import samples
from .registry import query, table

_FORM = samples._FORM
_CLEAN = samples._CLEAN
_STREAM = f"""
WITH c AS (SELECT doc_id, {_CLEAN.format('text')} AS item FROM documents),
f AS (SELECT *, {_FORM.format('item')} AS canonical FROM c WHERE length(item) > 0),
kn AS (SELECT DISTINCT coalesce({_FORM.format('item')}, item) AS key
       FROM (SELECT {_CLEAN.format('text')} AS item FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))),
s AS (SELECT doc_id, coalesce(canonical, item) AS key, canonical IS NOT NULL AS valid,
             coalesce(canonical, item) NOT IN (SELECT key FROM kn) AS novel FROM f)"""


ARRIVALS = 4
STOP_AT = 300


def _known(spark: SparkSession, sf_dir: str) -> ops.KnownKeys:
    known = clean_items(samples.known(spark, sf_dir), "item", samples.MARKS, drop_empty=False)
    return ops.known_keys(known.select(F.coalesce(samples.sentence(F.col("item")), "item").alias("key")))


def arrivals(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The labelled stream after each quarter of the documents (by id) has arrived in its folder."""
    folder, known = shared_path(spark, "arrivals"), _known(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("item"))
    for i in range(ARRIVALS):
        docs.where(F.pmod("doc_id", F.lit(ARRIVALS)) == i).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("doc_id bigint, item string").parquet(folder)
        yield ops.stream_label(stream, known, samples.sentence, marks=samples.MARKS)


def _run(spark: SparkSession, sf_dir: str, name: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path, out = shared_path(spark, name), None
    for stream in arrivals(spark, sf_dir):
        out = ops.run_available(step(stream), name, path=path)
    return out


@query(_STREAM + " SELECT doc_id, key, valid, novel FROM s")
def stream_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "stream-label", lambda rows: rows.select("doc_id", "key", "valid", "novel"))


@query(_STREAM + " SELECT DISTINCT key FROM s WHERE valid")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "stream-first", lambda rows: ops.stream_first_seen(rows.where("valid").select("key")))


_BATCHES = _STREAM + f""", k AS (SELECT doc_id % {ARRIVALS} AS batch_id, key, bool_or(valid) AS valid, bool_or(novel) AS novel FROM s GROUP BY ALL),
m AS (SELECT *, valid AND batch_id = min(batch_id) FILTER (valid) OVER (PARTITION BY key) AS fresh FROM k),
r AS (SELECT batch_id, count(*) AS generated, count(*) FILTER (valid) AS valid, count(*) FILTER (fresh) AS "unique",
             count(*) FILTER (fresh AND novel) AS novel FROM m GROUP BY batch_id)"""
_TOTALS = (
    _BATCHES
    + """, t(idx, counter, "count") AS (
  SELECT 0, 'generated', sum(generated)::BIGINT FROM r UNION ALL
  SELECT 1, 'valid', sum(valid)::BIGINT FROM r UNION ALL
  SELECT 2, 'unique', sum("unique")::BIGINT FROM r UNION ALL
  SELECT 3, 'novel', sum(novel)::BIGINT FROM r)"""
    + samples.FRACTIONS
)


def _tallied(spark: SparkSession, sf_dir: str, **limits) -> ops.StreamTally:
    """The tally goes on with each arrival until it ends."""
    path, result = shared_path(spark, "tally"), None
    for stream in arrivals(spark, sf_dir):
        result = ops.stream_tally(stream, path=path, **limits)
        if result.stopped:
            break
    return result


@query(_TOTALS)
def stream_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.rounded(_tallied(spark, sf_dir).totals(spark))


@query(
    _BATCHES
    + f""", w AS (SELECT *, sum(novel) OVER (ORDER BY batch_id)::BIGINT AS found, count_if(novel = 0) OVER (ORDER BY batch_id)::BIGINT AS fruitless FROM r)
SELECT batch_id, generated, valid, "unique", novel, found, fruitless,
       CASE WHEN found >= {STOP_AT} THEN 'target' WHEN fruitless >= 3 THEN 'aborted' END AS stopped
FROM w WHERE found - novel < {STOP_AT}"""
)
def stream_stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the batches until enough novel items were found."""
    return _tallied(spark, sf_dir, target=STOP_AT, max_tries=3).records(spark)
