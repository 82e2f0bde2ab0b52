"""Template strings built by expression: lineitem gives generated ones, part the known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pieces import lexical_check
from ..functions.text import similarity_key, strip_atom_mapping
from ..functions.text import template_key as key_of
from ..operators import templates as ops
from ..plans.labelling import (
    feasible_templates,
    label_generated_templates,
    template_table,
    template_tally,
)
from ..sources.shared import spread
from .registry import query, table
from .samples import FRACTIONS, rounded

_C = "concat('[C;H', l_linenumber, ':', CAST(l_quantity AS INT) % 3, ']')"
_O = "concat('[O;D', l_suppkey % 20, ':2]')"
GENERATED = f"""concat(
  CASE WHEN l_returnflag = 'A' THEN concat({_O}, '.', {_C}) ELSE concat({_C}, '.', {_O}) END,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN '.' ELSE '' END, '>>', {_C}, {_O})"""
_GENERATED_FROM = (
    "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
)
_KC = "concat('[C;H', p_size % 10, ':', p_size % 3, ']')"
_KO = "concat('[O;D', p_partkey % 15, ':2]')"
KNOWN = f"concat({_KC}, '.', {_KO}, '>>', {_KC}, {_KO})"
_KNOWN_ID = "CASE WHEN p_brand <> 'Brand#1' THEN concat('K', p_partkey) END"
_KNOWN_SPLIT = "CASE WHEN p_retailprice < 940 THEN 'train' WHEN p_retailprice < 970 THEN 'valid' ELSE 'test' END"


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem").select(*_GENERATED_FROM)).select(
        F.expr("CAST(l_quantity AS INT)").alias("batch"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("ord"),
        F.expr(GENERATED).alias("template"),
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.expr(_KNOWN_ID).alias("id"),
        F.expr(_KNOWN_SPLIT).alias("split"),
        F.col("p_name").alias("product"),
        F.expr(KNOWN).alias("template"),
    )


_STRIP = r"regexp_replace(template, ':\d+', '', 'g')"
_KEY = f"""CASE WHEN len(list_filter(string_split(replace({_STRIP}, '>>', '.'), '.'), lambda p: p = '')) = 0
  THEN array_to_string(list_transform(string_split({_STRIP}, '>>'),
    lambda s: array_to_string(list_sort(string_split(s, '.')), '.')), '>>') END"""
_TABLES = f"""
WITH g0 AS (SELECT CAST(l_quantity AS INT) AS batch, l_orderkey * 8 + l_linenumber AS ord, {GENERATED} AS template FROM lineitem),
k0 AS (SELECT p_partkey AS ord, {_KNOWN_ID} AS id, {_KNOWN_SPLIT} AS split, p_name AS product, {KNOWN} AS template FROM part),
gk AS (SELECT template, {_KEY} AS key FROM (SELECT DISTINCT template FROM g0)),
kk AS (SELECT *, {_KEY} AS key FROM k0),
g AS (SELECT g0.*, gk.key FROM g0 JOIN gk USING (template)),
m AS (SELECT key, count(*) AS n_similar, count(id) AS num_works_with,
             arg_min(id, ord) FILTER (id IS NOT NULL) AS first_id FROM kk GROUP BY key),
sp AS (SELECT template, bool_or(split = 'valid') AS in_val, bool_or(split = 'test') AS in_test FROM k0 GROUP BY template)"""

_LABELLED = (
    _TABLES
    + """
, d AS (SELECT batch, min(ord) AS ord, template, key FROM g GROUP BY batch, template, key),
labelled AS (
  SELECT d.batch, d.ord, d.template, d.key IS NOT NULL AS valid,
         count(*) OVER (PARTITION BY d.template) = 1 AS "unique",
         d.key IS NOT NULL AND d.batch = min(d.batch) OVER (PARTITION BY d.template) AS "first",
         m.key IS NOT NULL AS feasible, sp.template IS NOT NULL AS is_known,
         m.key IS NOT NULL AND coalesce(sp.in_val, false) AS in_val,
         m.key IS NOT NULL AND coalesce(sp.in_test, false) AS in_test,
         CAST(coalesce(m.num_works_with, 0) AS INT) AS num_works_with,
         CASE WHEN m.key IS NOT NULL THEN coalesce(m.first_id, '') END AS first_id
  FROM d LEFT JOIN m ON d.key = m.key LEFT JOIN sp ON d.template = sp.template
)"""
)


@query(
    _TABLES
    + f""" SELECT template, key, {_STRIP} AS without_mapping FROM gk"""
)
def template_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("template")
    return (
        generated(spark, sf_dir)
        .select("template")
        .distinct()
        .select("template", key_of(t).alias("key"), strip_atom_mapping(t).alias("without_mapping"))
    )


@query(_TABLES + " SELECT key, ord, id, split, product FROM kk WHERE key IN (SELECT key FROM gk)")
def similar_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.similar_known(generated(spark, sf_dir), known(spark, sf_dir), "canonical")
    return found.select("key", "ord", "id", "split", "product")


@query(
    _TABLES
    + f""", a AS (SELECT DISTINCT {_STRIP} AS key FROM g0), b AS (SELECT *, {_STRIP} AS bare FROM k0)
SELECT bare AS key, ord, id FROM b WHERE bare IN (SELECT key FROM a)"""
)
def similar_by_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.similar_known(generated(spark, sf_dir), known(spark, sf_dir), "atom_mapping")
    return found.select("key", "ord", "id")


@query(_TABLES + " SELECT key, n_similar, num_works_with, first_id FROM m WHERE key IN (SELECT key FROM gk)")
def matches_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.similar_known(generated(spark, sf_dir), known(spark, sf_dir), "canonical")
    return ops.matches_summary(found)


@query(
    _TABLES
    + """ SELECT gk.template, m.key IS NOT NULL AS feasible,
  CAST(coalesce(num_works_with, 0) AS INT) AS num_works_with,
  CASE WHEN m.key IS NOT NULL THEN coalesce(first_id, '') END AS first_id
FROM gk LEFT JOIN m USING (key) WHERE gk.key IS NOT NULL"""
)
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.feasibility(generated(spark, sf_dir), known(spark, sf_dir))


def _applies(template: str, product: str) -> bool:
    if product.startswith("hot"):
        raise ValueError("a failing rule counts as not applicable")
    return len(template) % 2 == 0 or "gear" in product


@query(
    _TABLES
    + """, p AS (SELECT gk.template, kk.id, kk.ord FROM gk JOIN kk USING (key)
  WHERE NOT starts_with(kk.product, 'hot') AND (length(gk.template) % 2 = 0 OR contains(kk.product, 'gear'))),
h AS (SELECT template, count(id) AS n, arg_min(id, ord) FILTER (id IS NOT NULL) AS first_id FROM p GROUP BY template)
SELECT gk.template, h.template IS NOT NULL AS feasible, CAST(coalesce(n, 0) AS INT) AS num_works_with,
       CASE WHEN h.template IS NOT NULL THEN coalesce(first_id, '') END AS first_id
FROM gk LEFT JOIN h USING (template) WHERE gk.key IS NOT NULL"""
)
def feasibility_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasibility by a pluggable Python rule on (template, product)."""
    return ops.feasibility(generated(spark, sf_dir), known(spark, sf_dir), _applies)


@query(
    _TABLES
    + """ SELECT gk.template, sp.template IS NOT NULL AS is_known, coalesce(in_val, false) AS in_val,
coalesce(in_test, false) AS in_test FROM gk LEFT JOIN sp ON gk.template = sp.template"""
)
def known_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    gen = generated(spark, sf_dir).select("template").distinct()
    flagged = ops.known_by_split(gen, known(spark, sf_dir), spread_by="template")
    return flagged.select("template", "is_known", "in_val", "in_test")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_generated_templates(generated(spark, sf_dir), known(spark, sf_dir))


@query(
    _LABELLED
    + """ SELECT batch, ord, template, valid, "unique", "first", feasible, is_known, in_val, in_test,
num_works_with, first_id FROM labelled"""
)
def label_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query(
    _LABELLED
    + """ SELECT template AS smarts, valid, "unique", feasible, in_val OR in_test AS not_trained_on_but_known,
in_val AS known_from_valid_set, in_test AS known_from_test_set, num_works_with AS num_products_works_with,
first_id AS example_works_with_reaction_id FROM labelled"""
)
def template_output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_table(_labelled(spark, sf_dir))


@query(_LABELLED + """ SELECT template AS smarts FROM labelled WHERE "first" AND feasible""")
def feasible_template_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feasible_templates(_labelled(spark, sf_dir))


@query(
    _LABELLED
    + """, t(idx, counter, "count") AS (
  SELECT 0, 'generated', count(*) FROM labelled UNION ALL
  SELECT 1, 'valid', count(*) FILTER (valid) FROM labelled UNION ALL
  SELECT 2, 'unique', count(*) FILTER ("first") FROM labelled UNION ALL
  SELECT 3, 'feasible', count(*) FILTER ("first" AND feasible) FROM labelled UNION ALL
  SELECT 4, 'known', count(*) FILTER ("first" AND feasible AND is_known) FROM labelled UNION ALL
  SELECT 5, 'known_from_valid_set', count(*) FILTER ("first" AND feasible AND is_known AND in_val) FROM labelled UNION ALL
  SELECT 6, 'known_from_test_set', count(*) FILTER ("first" AND feasible AND is_known AND in_test) FROM labelled)"""
    + FRACTIONS
)
def tally_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(template_tally(_labelled(spark, sf_dir)))


@query(
    _LABELLED
    + """, u AS (SELECT template, bool_or(feasible) AS f, bool_or(is_known) AS k FROM labelled WHERE valid GROUP BY template),
c AS (SELECT count(*) AS n_valid, count(*) FILTER (f) AS n_feasible, count(*) FILTER (f AND k) AS n_known,
             count(*) FILTER (NOT k) AS n_new FROM u)
SELECT *, n_valid = n_known + n_new AS valid_is_known_plus_new, n_feasible <= n_valid AS feasible_within_valid,
       n_known <= n_feasible AS known_within_feasible FROM c"""
)
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.partition_check(_labelled(spark, sf_dir))


@query(
    _TABLES
    + r""", c AS (SELECT template, string_split(regexp_replace(template, '\[[^\]]+]', '', 'g'), '') AS ch FROM gk)
SELECT template, len(list_filter(string_split(replace(template, '>>', '.'), '.'), lambda p: p = '')) = 0 AS lexical
FROM c"""
)
def lexical_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These templates have no rings or branches, so only empty parts can break their shape."""
    rows = generated(spark, sf_dir).select("template").distinct()
    return rows.select("template", lexical_check(F.col("template")).alias("lexical"))


@query(
    _TABLES
    + f""", a AS (SELECT {_STRIP} AS bare, {_KEY} AS key FROM (SELECT DISTINCT template FROM g0))
SELECT bare AS mapping_key, key AS canonical_key, count(*) AS n FROM a GROUP BY bare, key"""
)
def similarity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("template")
    rows = generated(spark, sf_dir).select("template").distinct()
    return rows.groupBy(
        similarity_key(t, "atom_mapping").alias("mapping_key"),
        similarity_key(t, "canonical").alias("canonical_key"),
    ).agg(F.count("*").alias("n"))
