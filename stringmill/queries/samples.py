"""Documents as generated items; labelled documents are the known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_generated, enclose, identity_key
from ..operators import dedup
from ..operators.canonical import with_canonical
from ..operators.cuts import cap_rows, first_n, random_split
from ..operators.quality import basic_stats as set_metrics
from ..operators.tally import tally
from ..plans.labelling import (
    clean_items,
    item_table,
    item_tally,
    label_generated_items,
    novel_items,
)
from ..sources.shared import shared_path
from ..sources.sinks import tally_json
from .registry import query, table

MARKS = ("The ", "\n", "_")  # what cleaning removes from prose


def sentence(text: Column) -> Column:
    """Canonical form of prose: trimmed, only when it ends a sentence."""
    form = F.trim(text)
    return F.when(form.endswith("."), form)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch"), F.col("doc_id").alias("ord"), F.col("text").alias("item")
    )


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return documents(spark, sf_dir).join(labels, "ord", "left_anti").select("batch", "ord", "item")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return documents(spark, sf_dir).join(labels, "ord", "left_semi").select("batch", "ord", "item")


def with_split(spark: SparkSession, sf_dir: str, read=lambda df: df) -> DataFrame:
    """Documents with a split: toxic ones test, bad ones validation, all others train."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "ord")
    split = (
        F.when(F.col("toxic") == 1, "test").when(F.col("quality") == 0, "validation").otherwise("train")
    )
    return read(documents(spark, sf_dir)).join(labels, "ord", "left").select(
        split.alias("split"), "batch", "ord", "item"
    )


_CLEAN = "replace(replace(replace({}, 'The ', ''), chr(10), ''), '_', '')"
_FORM = "CASE WHEN trim({0}) LIKE '%.' THEN trim({0}) END"
_GEN = "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
_KNOWN = "documents WHERE doc_id IN (SELECT doc_id FROM labels)"

_LABELLED = f"""
WITH c AS (
  SELECT source AS batch, doc_id AS ord, {_CLEAN.format('text')} AS item FROM {_GEN}
), f AS (
  SELECT *, {_FORM.format('item')} AS canonical FROM c WHERE length(item) > 0
), k AS (
  SELECT *, coalesce(canonical, item) AS key FROM f
), d AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY batch, key ORDER BY ord) = 1
), kn AS (
  SELECT DISTINCT coalesce({_FORM.format('item')}, item) AS key
  FROM (SELECT {_CLEAN.format('text')} AS item FROM {_KNOWN})
), labelled AS (
  SELECT d.*, canonical IS NOT NULL AS valid,
         count(*) OVER (PARTITION BY key) = 1 AS "unique",
         key NOT IN (SELECT key FROM kn) AS novel,
         canonical IS NOT NULL AND batch = min(batch) OVER (PARTITION BY key) AS "first"
  FROM d
)"""

_SPLIT = """
WITH s AS (
  SELECT d.doc_id AS ord, d.source AS batch, d.text AS item,
         CASE WHEN l.toxic = 1 THEN 'test' WHEN l.quality = 0 THEN 'validation' ELSE 'train' END AS split
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

_TALLY_ROWS = """
, t(idx, counter, "count") AS (
  SELECT 0, 'generated', count(*) FROM labelled UNION ALL
  SELECT 1, 'valid', count(*) FILTER (valid) FROM labelled UNION ALL
  SELECT 2, 'unique', count(*) FILTER ("first") FROM labelled UNION ALL
  SELECT 3, 'novel', count(*) FILTER ("first" AND novel) FROM labelled
)
"""
FRACTIONS = """
SELECT CAST(idx AS INT) AS idx, counter, "count",
       round("count" / first("count") OVER (ORDER BY idx), 9) AS absolute_fraction,
       round("count" / coalesce(lag("count") OVER (ORDER BY idx), "count"), 9) AS relative_fraction
FROM t"""


def rounded(tally_rows: DataFrame) -> DataFrame:
    return tally_rows.withColumns(
        {c: F.round(c, 9) for c in ("absolute_fraction", "relative_fraction")}
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    known_items = clean_items(known(spark, sf_dir), "item", MARKS, drop_empty=False)
    return label_generated_items(generated(spark, sf_dir), known_items, sentence, MARKS)


@query(_LABELLED + ' SELECT batch, ord, item, canonical, valid, "unique", novel, "first" FROM labelled')
def label_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query(_LABELLED + _TALLY_ROWS + FRACTIONS)
def tally_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(item_tally(_labelled(spark, sf_dir)))


@query(
    _LABELLED
    + """ SELECT item AS smiles, canonical AS canonical_smiles, valid, "unique", novel FROM labelled"""
)
def item_output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_table(_labelled(spark, sf_dir))


@query(_LABELLED + """ SELECT canonical AS smiles FROM labelled WHERE "first" AND novel""")
def novel_item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novel_items(_labelled(spark, sf_dir))


@query(_LABELLED + _TALLY_ROWS + ' SELECT counter, CAST("count" AS BIGINT) AS n FROM t')
def tally_json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written tally read back from its JSON."""
    path = shared_path(spark, "tally-json")
    tally_json(item_tally(_labelled(spark, sf_dir))).write.text(path)
    counts = F.from_json(F.get_json_object("value", "$.counts"), "map<string,bigint>")
    return spark.read.text(path).select(F.explode(counts).alias("counter", "n"))


@query(
    f"""
SELECT doc_id AS ord, {_CLEAN.format('text')} AS item,
       concat('<s>', {_CLEAN.format('text')}, '</s>') AS enclosed
FROM documents WHERE length({_CLEAN.format('text')}) > 0"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("ord", clean_generated(F.col("item"), *MARKS).alias("item"))
    return rows.where(F.length("item") > 0).withColumn(
        "enclosed", enclose(F.col("item"), "<s>", "</s>")
    )


@query(
    f"""
WITH g AS (SELECT text, {_FORM.format('text')} AS form FROM {_GEN}),
u AS (SELECT DISTINCT form FROM g WHERE form IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT count(form) FROM g) AS v, (SELECT count(*) FROM u) AS u,
      (SELECT count(*) FROM u WHERE form NOT IN (SELECT text FROM {_KNOWN})) AS w)
SELECT round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 9) AS "Validity",
       round(CASE WHEN v > 0 THEN u / v ELSE 0 END, 9) AS "Uniqueness",
       round(CASE WHEN u > 0 THEN w / u ELSE 0 END, 9) AS "Novelty" FROM c"""
)
def basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = with_canonical(generated(spark, sf_dir), "item", sentence)
    stats = set_metrics(gen, known(spark, sf_dir))
    return stats.select(*[F.round(c, 9).alias(c) for c in stats.columns])


@query(
    f"""
SELECT doc_id AS ord, text NOT IN (SELECT text FROM {_KNOWN}) AS novel FROM {_GEN}"""
)
def flag_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = dedup.flag_novel(generated(spark, sf_dir), known(spark, sf_dir), "item")
    return gen.select("ord", "novel")


@query('SELECT doc_id AS ord, count(*) OVER (PARTITION BY text) = 1 AS "unique" FROM documents')
def flag_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flag_singleton(documents(spark, sf_dir), "item").select("ord", "unique")


@query(
    """
SELECT batch, ord, item FROM (SELECT source AS batch, doc_id AS ord, text AS item FROM documents)
QUALIFY row_number() OVER (PARTITION BY item ORDER BY batch, ord) = 1"""
)
def first_seen_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_seen(documents(spark, sf_dir), "item")


@query(
    """
SELECT doc_id AS ord, lang, n_chars, source FROM documents
QUALIFY row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) = 1"""
)
def keep_first_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), "lang", "n_chars", "source"
    )
    return dedup.drop_duplicates(rows, ["lang", "n_chars"])


@query(_SPLIT + " SELECT DISTINCT item FROM s WHERE split = 'train' AND item NOT IN (SELECT item FROM s WHERE split <> 'train')")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_split(spark, sf_dir)
    train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    return dedup.decontaminate(train, held_out)


@query(
    _SPLIT
    + """ SELECT CAST(count(DISTINCT item) AS BIGINT) AS n_shared FROM s
WHERE split = 'train' AND item IN (SELECT item FROM s WHERE split <> 'train')"""
)
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_split(spark, sf_dir)
    train, held_out = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    return dedup.leak_report(train, held_out)


@query(
    f"""
SELECT CAST(count(*) AS BIGINT) AS items_total, CAST(count(DISTINCT text) AS BIGINT) AS items_deduplicated,
       CAST(count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM {_KNOWN})) AS BIGINT) AS items_left
FROM {_GEN}"""
)
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_report(generated(spark, sf_dir), known(spark, sf_dir))


@query(
    f"""
SELECT * FROM (SELECT 'union' AS op, text AS item FROM documents
UNION SELECT 'difference', text FROM {_GEN} AND text NOT IN (SELECT text FROM {_KNOWN})
UNION SELECT 'intersection', text FROM {_GEN} AND text IN (SELECT text FROM {_KNOWN})
UNION SELECT 'distinct', text FROM {_GEN})"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference, intersection and distinct of generated and known items."""
    gen, seen = generated(spark, sf_dir), known(spark, sf_dir)
    parts = {
        "union": dedup.union_sets(gen.select("item"), seen.select("item")),
        "difference": dedup.difference(gen, seen, "item").select("item").distinct(),
        "intersection": dedup.intersection(gen, seen, "item").select("item").distinct(),
        "distinct": gen.select("item").distinct(),
    }
    result = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("op"), "item")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    """
WITH o AS (SELECT doc_id AS ord, row_number() OVER (ORDER BY md5(concat('42-', doc_id, '-', doc_id))) AS rn,
                  count(*) OVER () AS n FROM documents)
SELECT ord, CASE WHEN rn <= n * 10 // 100 THEN 'validation'
                 WHEN rn <= n * 10 // 100 + n * 15 // 100 THEN 'test' ELSE 'train' END AS split FROM o"""
)
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("ord")
    return random_split(rows, 10, 15, seed=42, key="ord", tie="ord")


# No query takes the short way of a small top-k: ranges are halved until they hold few rows.
_ROUNDS = {"top_rows": 0, "ranked_rows": 64}


@query("SELECT o_orderkey AS ord, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1200")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First n rows in order: the operator under test is the limit itself."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), "o_custkey")
    return first_n(rows, 1200, **_ROUNDS)


@query("SELECT md5(concat(text, '-', doc_id)) AS ord, lang FROM documents ORDER BY ord LIMIT 150")
def capped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by a string; no error if there are fewer."""
    order = F.md5(F.concat(F.col("text"), F.lit("-"), F.col("doc_id").cast("string")))
    return cap_rows(table(spark, sf_dir, "documents").select(order.alias("ord"), "lang"), 150, **_ROUNDS)


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 700")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows by a struct of time and number."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.struct("ts", "event_id").alias("ord"))
    return first_n(rows, 700, **_ROUNDS).drop("ord")


@query("SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= 1100")
def cheapest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows by a double, equal ones by a number."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return first_n(rows.withColumn("ord", F.struct("o_totalprice", "o_orderkey")), 1100, **_ROUNDS).drop("ord")


@query(
    """
WITH t(idx, counter, "count") AS (
  SELECT 0, 'all', count(*) FROM documents UNION ALL
  SELECT 1, 'english', count(*) FILTER (lang = 'en') FROM documents UNION ALL
  SELECT 2, 'long english', count(*) FILTER (lang = 'en' AND n_chars > 1000) FROM documents)"""
    + FRACTIONS
)
def tally_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = F.col("lang") == "en"
    counters = {
        "all": F.lit(True),
        "english": english,
        "long english": english & (F.col("n_chars") > 1000),
    }
    return rounded(tally(table(spark, sf_dir, "documents"), counters))


@query(
    f"""
SELECT doc_id AS ord, {_FORM.format('text')} AS canonical, coalesce({_FORM.format('text')}, text) AS key
FROM documents"""
)
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Column function as canonicaliser, applied twice."""
    rows = with_canonical(documents(spark, sf_dir), "item", sentence)
    return rows.select(
        "ord", "canonical", identity_key(F.col("item"), F.col("canonical")).alias("key")
    )


def _python_sentence(text: str) -> str | None:
    form = text.strip(" ")
    return form if form.endswith(".") else None


@query(f"SELECT doc_id AS ord, {_FORM.format('text')} AS canonical FROM documents")
def canonical_forms_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function as canonicaliser, run on distinct texts only."""
    from ..operators.canonical import with_canonical_udf

    return with_canonical_udf(documents(spark, sf_dir), _python_sentence).select("ord", "canonical")
