"""Delimited files: each query writes a table as files of the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import dedup_report
from ..plans.corpus import prepare_item_corpus, prepare_reaction_corpus
from ..sources import artifacts, items, opened
from ..sources.shared import shared_path, stored
from ..sources.sinks import write_eval_json, write_items, write_metrics
from . import templates
from .registry import query, table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("smiles"))


@query("SELECT concat(p_name, ', \"', p_brand, '\"') AS item FROM part")
def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a header line: it is found and dropped."""
    path = shared_path(spark, "items")
    write_items(_names(spark, sf_dir), path, header=True)
    return items.read_items(spark, path).select("item")


@query("SELECT concat(p_name, ', \"', p_brand, '\"') AS item FROM part")
def item_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared copy of an item file."""
    path = shared_path(spark, "corpus")
    write_items(_names(spark, sf_dir), f"{path}/raw", header=True)
    prepare_item_corpus(spark, f"{path}/raw", f"{path}/prepared")
    return items.read_known(spark, f"{path}/prepared").select("item")


@query("SELECT concat('SMILES ', c_name) AS item FROM customer")
def read_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that read like a header stay when nothing is to be taken for one."""
    path = shared_path(spark, "known")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("SMILES "), "c_name").alias("x"))
    write_items(rows, path)
    return items.read_known(spark, path).select("item")


_RAW = f"""
WITH raw AS (SELECT CAST(p_partkey AS VARCHAR) AS id,
  CASE WHEN p_retailprice < 940 THEN 'train' WHEN p_retailprice < 970 THEN 'valid' ELSE 'test' END AS split,
  p_name AS product, {templates.KNOWN} AS template FROM part)"""


def _raw_reactions(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = templates.known(spark, sf_dir).select(
        F.col("ord").cast("string").alias("id"),
        "split",
        F.lit("unused").alias("class"),
        F.col("product").alias("prod_smiles"),
        F.col("template").alias("reaction_smarts"),
    )
    write_items(rows, path, header=True)


@query(_RAW + " SELECT id, split, product, template FROM raw WHERE split IN ('valid', 'test')")
def read_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns of a header file, renamed, filtered by split."""
    path = shared_path(spark, "reactions")
    _raw_reactions(spark, sf_dir, path)
    rows = items.read_reactions(spark, path).where(F.col("split").isin("valid", "test"))
    return rows.select(
        F.col("`USPTO-50k_id`").alias("id"),
        "split",
        F.col("product_smiles").alias("product"),
        F.col("reaction_smarts_with_atom_mapping").alias("template"),
    )


@query(
    _RAW
    + """ SELECT 'known' AS part, template FROM raw WHERE split <> 'train'
UNION ALL SELECT DISTINCT 'train', template FROM raw WHERE split = 'train' AND template NOT IN (SELECT template FROM raw WHERE split <> 'train')
UNION ALL SELECT DISTINCT split, template FROM raw WHERE split <> 'train'"""
)
def reaction_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four prepared files, read back."""
    path = shared_path(spark, "reaction-corpus")
    _raw_reactions(spark, sf_dir, f"{path}/raw")
    prepare_reaction_corpus(spark, f"{path}/raw", f"{path}/out")
    known = items.read_known_reactions(spark, f"{path}/out/known")
    result = known.select(F.lit("known").alias("part"), "template")
    for name in ("train", "valid", "test"):
        part = items.read_known(spark, f"{path}/out/{name}")
        result = result.unionByName(part.select(F.lit(name).alias("part"), F.col("item").alias("template")))
    return result


@query("SELECT c_name AS item FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'")
def read_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of a generated file without missing texts."""
    path = shared_path(spark, "generated")
    rows = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("smiles"),
        (F.col("c_acctbal") > 0).alias("valid"),
        F.col("c_nationkey").alias("other"),
    )
    write_items(rows, path, header=True)
    return items.read_generated(spark, path, valid_only=True).select("item")


@query(
    """
SELECT CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'P' THEN 'validation' ELSE 'test' END AS split,
       concat(o_orderkey, ' ', o_orderpriority) AS item FROM orders"""
)
def read_split_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "splits")
    orders = table(spark, sf_dir, "orders")
    for status, name in (("F", "train"), ("P", "val"), ("O", "test")):
        rows = orders.where(F.col("o_orderstatus") == status)
        write_items(rows.select(F.concat("o_orderkey", F.lit(" "), "o_orderpriority")), f"{path}/{name}")
    return items.read_split_dir(spark, path).select("split", "item")


@query(
    """
SELECT CAST(c_nationkey AS VARCHAR) AS nation FROM customer
UNION SELECT CAST(s_nationkey AS VARCHAR) FROM supplier"""
)
def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header files merged; of repeated nations the first row stays."""
    path = shared_path(spark, "merge")
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name").toDF("nation", "name")
    write_items(customer, f"{path}/a", header=True)
    write_items(supplier, f"{path}/b", header=True)
    return items.merge_tables(spark, [f"{path}/a", f"{path}/b"], column="nation").select("nation")


@query("SELECT concat('| ', c_custkey, ' | ', c_name, ' | ', c_nationkey, ' |') AS line FROM customer")
def metrics_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table written in all formats; the lines of its Markdown form."""
    path = shared_path(spark, "metrics")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("run"), "c_name", "c_nationkey"
    )
    write_metrics(rows, path)
    lines = spark.read.text(f"{path}/md").select(F.col("value").alias("line"))
    return lines.where(~F.col("line").startswith("| run |") & ~F.col("line").startswith("|:--"))


_TEXTS = """
WITH t AS (SELECT doc_id, concat(doc_id, '.txt') AS name, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest FROM documents)"""
_LEVEL = "SELECT left(place, {0}) AS place, sha256(string_agg(digest, '' ORDER BY place, digest)) AS digest FROM {1} GROUP BY 1"


@query(
    _TEXTS
    + f""", l0 AS (SELECT digest AS place, digest FROM t), l1 AS ({_LEVEL.format(4, "l0")}), l2 AS ({_LEVEL.format(2, "l1")})
SELECT name, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unchecked' ELSE 'ok' END AS status, digest FROM t
UNION ALL SELECT concat('lost-', name), 'missing', NULL FROM t WHERE doc_id % 10 = 3
UNION ALL SELECT 'all files', 'ok', digest FROM ({_LEVEL.format(0, "l2")})"""
)
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files, their checksums against a registry that errs, and one for the whole set."""
    path = shared_path(spark, "texts")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat("doc_id", F.lit(".txt"))
    folder = F.concat(F.pmod("doc_id", F.lit(256)).cast("string"), F.lit("/"))
    opened.write_named(docs.select(F.concat(folder, name).alias("path"), F.col("text").alias("content")), path)
    right = F.sha2("text", 256)
    kind = F.col("doc_id") % 4
    expected = (
        F.when(kind == 0, F.concat(F.lit("sha256:"), right))
        .when(kind == 1, F.sha2(F.concat("text", F.lit("x")), 256))
        .when(kind == 3, F.upper(right))
    )
    registry = docs.select(name.alias("name"), expected.alias("expected")).unionByName(
        docs.where("doc_id % 10 = 3").select(F.concat(F.lit("lost-"), name).alias("name"), right.alias("expected"))
    )
    digests = stored(artifacts.file_digests(spark, path), "digests")
    checked = artifacts.verify_checksums(digests, registry).select("name", "status", "digest")
    whole = artifacts.fileset_digest(digests)
    return checked.unionByName(
        whole.select(F.lit("all files").alias("name"), F.lit("ok").alias("status"), "digest")
    )


@query(
    _TEXTS
    + """, p AS (SELECT name, doc_id, text, unnest(range(greatest((octet_length(encode(text)) - 1) // 1000 + 1, 1))) AS leaf FROM t),
h AS (SELECT name, leaf, sha256(encode(text)[leaf * 1000 + 1 : (leaf + 1) * 1000]) AS hash FROM p)
SELECT name, count(*) AS n_leaves, sha256(unhex(string_agg(hash, '' ORDER BY leaf))) AS digest FROM h GROUP BY name"""
)
def merkle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums over the pieces of 1 000 bytes of each text, written as files."""
    path = shared_path(spark, "pieces")
    docs = table(spark, sf_dir, "documents")
    folder = F.concat(F.pmod("doc_id", F.lit(256)).cast("string"), F.lit("/"))
    opened.write_named(docs.select(F.concat(folder, "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")), path)
    return artifacts.merkle_digests(spark, path, 1000).select("name", "n_leaves", "digest")


@query("SELECT c_name AS item FROM customer UNION ALL SELECT s_name FROM supplier")
def read_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item files packed by gzip and by bzip2, with and without a header line."""
    path = shared_path(spark, "packed")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("smiles")).write.csv(
        f"{path}/a", header=True, compression="gzip"
    )
    table(spark, sf_dir, "supplier").select("s_name").write.csv(f"{path}/b", header=False, compression="bzip2")
    return items.read_items(spark, [f"{path}/a", f"{path}/b"]).select("item")


@query(_RAW + " SELECT id, split, product, template FROM raw")
def read_two_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers name the same columns in two orders."""
    path = shared_path(spark, "two-headers")
    _raw_reactions(spark, sf_dir, f"{path}/all")
    rows = items.read_table(spark, f"{path}/all", ["id", "split", "class", "prod_smiles", "reaction_smarts"]).drop("ord")
    valid = F.col("split") == "valid"
    write_items(rows.where(valid), f"{path}/a", header=True)
    write_items(rows.where(~valid).select(*reversed(rows.columns)), f"{path}/b", header=True)
    read = items.read_reactions(spark, [f"{path}/a", f"{path}/b"]).drop("ord")
    return read.toDF("id", "split", "product", "template")


@query("SELECT c_name AS item FROM customer UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 0")
def read_generated_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files without a header, and others that name the column second."""
    path = shared_path(spark, "generated-mixed")
    write_items(table(spark, sf_dir, "customer").select("c_name", "c_nationkey"), f"{path}/a")
    named = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_name").alias("smiles"))
    write_items(named, f"{path}/b", header=True)
    return items.read_generated(spark, [f"{path}/a", f"{path}/b"]).select("item")


@query(
    """
SELECT count(*) AS items_total, count(DISTINCT text) + CAST(bool_or(text IS NULL) AS INT) AS items_deduplicated,
       count(DISTINCT text) + CAST(bool_or(text IS NULL) AS INT) AS items_left FROM documents"""
)
def evaluation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row written as the evaluation file and read back."""
    path = shared_path(spark, "evaluation")
    report = dedup_report(table(spark, sf_dir, "documents"), key="text")
    write_eval_json(report, path)
    return spark.read.schema(report.schema).json(path)
