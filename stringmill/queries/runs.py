"""Run metrics: customers and users stand for runs, orders for a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pieces import PATTERNS
from ..operators import runs as ops
from ..plans.experiments import collect_run_metrics, short_directories
from ..sources.artifacts import card_values, discover_runs, list_files
from ..sources.artifacts import latest_run as newest
from ..sources.opened import write_named
from ..sources.shared import shared_path
from .registry import query, table

_REGISTRY = """
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, concat('order ', o_orderkey) AS run_name,
                  concat('cust_', o_custkey) AS stem FROM orders),
a AS (SELECT stem, CASE WHEN count(*) > 1 THEN 'Multiple' ELSE min(run_id) END AS run_id,
             CASE WHEN count(*) > 1 THEN 'Multiple' ELSE min(run_name) END AS run_name FROM r GROUP BY stem),
att AS (SELECT c.c_custkey, concat('cust_', c.c_custkey) AS stem, a.run_id, a.run_name
       FROM customer c LEFT JOIN a ON a.stem = concat('cust_', c.c_custkey))"""


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("runs/cust_"), "c_custkey").alias("output_dir")
    )
    registry = (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").cast("string").alias("run_id"),
            F.concat(F.lit("order "), "o_orderkey").alias("run_name"),
            F.concat(F.lit("exp/cust_"), "o_custkey", F.lit(".out")).alias("output_dir"),
        )
    )
    return ops.attach_run_registry(runs, registry)


@query(_REGISTRY + " SELECT c_custkey, stem, run_id, run_name FROM att")
def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).select("c_custkey", "stem", "run_id", "run_name")


@query(
    _REGISTRY
    + """, l AS (SELECT concat('cust_', o_custkey) AS stem, CAST(min(o_orderkey) AS VARCHAR) AS local_id FROM orders GROUP BY o_custkey)
SELECT stem, local_id, run_id AS registry_id FROM l JOIN att USING (stem) WHERE local_id <> run_id"""
)
def registry_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    local = local.select(
        F.concat(F.lit("cust_"), "o_custkey").alias("stem"), F.col("k").cast("string").alias("run_id")
    )
    return ops.registry_mismatch(local, _attached(spark, sf_dir))


@query(
    """
SELECT concat('gen ', o_orderkey) AS run, 'segment' AS metric, c_mktsegment AS value
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def linked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated runs inherit the metrics of the model they point to."""
    links = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("gen "), "o_orderkey").alias("run"),
        F.col("o_custkey").cast("string").alias("model_run"),
    )
    metrics = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("run"),
        F.lit("segment").alias("metric"),
        F.col("c_mktsegment").alias("value"),
    )
    return ops.link_generated_to_model(links, metrics)


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    """
WITH m AS (SELECT user_id AS run, event_type AS metric, CAST(max(CAST(props->>'k' AS INT)) AS VARCHAR) AS value FROM events GROUP BY ALL)
SELECT run, max(value) FILTER (metric = 'click') AS click, max(value) FILTER (metric = 'error') AS error,
       max(value) FILTER (metric = 'purchase') AS purchase, max(value) FILTER (metric = 'signup') AS signup,
       max(value) FILTER (metric = 'view') AS "view" FROM m GROUP BY run"""
)
def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("metric"))
        .agg(F.max(F.get_json_object("props", "$.k").cast("int")).cast("string").alias("value"))
    )
    return ops.wide_metrics(metrics, EVENT_TYPES, typed=False)


# which catalogue entry an event stands for
_METRIC = """CASE event_type WHEN 'view' THEN 'layers' WHEN 'click' THEN 'temperature' WHEN 'signup' THEN 'algorithm'
  WHEN 'error' THEN 'lr' ELSE 'other' END"""
_VALUES = ", ".join(
    f"('{m.name}', {ops.ORDER[m.name]}, '{m.dtype}', '{s}')" for m in ops.CATALOGUE for s in m.scopes
)
_CATALOGUE = f"WITH cat(metric, place, dtype, scope) AS (VALUES {_VALUES})"


@query(
    _CATALOGUE
    + f""" SELECT metric, CAST(coalesce(place, 999999) AS INT) AS place, n
FROM (SELECT {_METRIC} AS metric, count(*) AS n FROM events GROUP BY 1) LEFT JOIN (SELECT DISTINCT metric, place FROM cat) USING (metric)"""
)
def metric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.expr(_METRIC).alias("metric"))
    return rows.agg(F.count("*").alias("n")).select(
        "metric", ops.metric_order(F.col("metric")).alias("place"), "n"
    )


@query(
    _CATALOGUE
    + f""", e AS (SELECT user_id AS run, {_METRIC} AS metric, CASE WHEN value > 90 THEN event_type ELSE props->>'k' END AS value FROM events)
SELECT run, metric, value, dtype FROM e JOIN (SELECT DISTINCT metric, dtype FROM cat) USING (metric)
WHERE (dtype = 'int' AND (try_cast(value AS INT) IS NULL OR contains(value, '.')))
   OR (dtype = 'double' AND try_cast(value AS DOUBLE) IS NULL)"""
)
def metric_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.expr(_METRIC).alias("metric"),
        F.when(F.col("value") > 90, F.col("event_type"))
        .otherwise(F.get_json_object("props", "$.k"))
        .alias("value"),
    )
    return ops.metric_type_check(metrics, ops.catalogue_table(spark)).select(
        "run", "metric", "value", "dtype"
    )


@query(
    _CATALOGUE
    + """, r AS (SELECT user_id, bool_or(event_type = 'signup') AS m, bool_or(event_type = 'purchase') AS i, false AS t FROM events GROUP BY user_id),
s AS (SELECT unnest(['tokenizer', 'model', 'training', 'wandb']) AS scope FROM r WHERE m
      UNION SELECT 'evaluation_mols' FROM r WHERE i UNION SELECT 'evaluation_rts' FROM r WHERE t)
SELECT DISTINCT metric, CAST(place AS INT) AS place FROM cat WHERE scope IN (SELECT scope FROM s)"""
)
def available_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a sign-up hold a model, users with a purchase hold items, none holds templates."""
    kind = F.col("event_type")
    runs = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.bool_or(kind == "signup").alias("has_model"),
            F.bool_or(kind == "purchase").alias("has_items"),
            F.lit(False).alias("has_templates"),
        )
    )
    return ops.available_metrics(ops.run_scopes(runs), ops.catalogue_table(spark))


@query(
    """
SELECT user_id AS run, arg_max(round(value, 6), (ts, event_id)) AS eval_accuracy
FROM events WHERE event_type = 'purchase' GROUP BY user_id"""
)
def last_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last log entry that holds an evaluation value."""
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "purchase", F.round("value", 6)).alias("eval_accuracy"),
    )
    return ops.last_value(log, "run", "eval_accuracy", ["ts", "event_id"])


@query(
    """
SELECT event_id, CAST(event_id AS VARCHAR) AS batch_size, concat('0.', user_id) AS lr FROM events"""
)
def card_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training arguments found in model card texts."""
    card = F.concat(
        F.lit("# Run\n\nThe following arguments were used:\n- learning_rate: 0."),
        "user_id",
        F.lit("\n- train_batch_size: "),
        "event_id",
        F.lit("\n- seed: 42\n"),
    )
    found = card_values(card)
    return table(spark, sf_dir, "events").select(
        "event_id", *[c.alias(name) for name, c in found.items()]
    )


@query(
    """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ByteLevel' WHEN 'AUTOMOBILE' THEN 'Char' WHEN 'MACHINERY' THEN 'Atom'
  WHEN 'HOUSEHOLD' THEN 'Smarts' END AS kind, CAST(2 AS INT) AS vocab_size, c_name AS algorithm FROM customer"""
)
def tokenizer_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, algorithm and size read from tokenizer files, one built per customer."""
    segment = F.col("c_mktsegment")

    def split(pattern: str):
        return F.struct(
            F.lit("Split").alias("type"), F.struct(F.lit(pattern).alias("Regex")).alias("pattern")
        )

    pre = (
        F.when(segment == "BUILDING", F.struct(F.lit("ByteLevel").alias("type"), F.struct(F.lit("x").alias("Regex")).alias("pattern")))
        .when(segment == "AUTOMOBILE", split(PATTERNS["CHAR"]))
        .when(segment == "MACHINERY", split(PATTERNS["ATOM"]))
        .when(segment == "HOUSEHOLD", split(PATTERNS["SMARTS"]))
        .otherwise(split("other"))
    )
    model = F.struct(
        F.col("c_name").alias("type"),
        F.create_map(F.lit("^"), F.lit(0), F.lit("C"), F.lit(1), F.lit("N"), F.lit(2)).alias("vocab"),
    )
    text = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("^").alias("content"))).alias("added_tokens"),
            pre.alias("pre_tokenizer"),
            model.alias("model"),
        )
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return rows.select(
        "c_custkey",
        ops.detect_pre_tokenizer(F.col("text")).alias("kind"),
        ops.tokenizer_vocab_size(F.col("text")).cast("int").alias("vocab_size"),
        F.get_json_object("text", "$.model.type").alias("algorithm"),
    )


@query("SELECT concat('run ', o_orderkey) AS run FROM orders ORDER BY o_orderdate DESC, concat('run ', o_orderkey) DESC LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(
        table(spark, sf_dir, "orders").select(
            F.concat(F.lit("run "), "o_orderkey").alias("run"), F.col("o_orderdate").alias("created")
        )
    )


def _run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` of a run per nation and segment; those of BUILDING hold generated items."""
    orders, customer = (table(spark, sf_dir, t) for t in ("orders", "customer"))
    groups = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg"))
        .agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 1000).alias("s"))
    )
    tokenizer = (
        '{"model": {"type": "BPE", "vocab": {"^": 0, "C": 1, "N": 2}}, "added_tokens": [{"content": "^"}], '
        '"pre_tokenizer": {"type": "ByteLevel"}}'
    )
    config = F.format_string('{"n_layer": %d, "n_head": %d}', "k", F.col("n") % 8)
    model = {
        "pytorch_model.bin": F.lit("weights"),
        "checkpoint-1/pytorch_model.bin": F.lit("weights"),
        "checkpoint-1/scheduler.pt": F.lit("steps"),
        "tokenizer.json": F.lit(tokenizer),
        # every seventh is cut off
        "config.json": F.when(F.col("k") % 7 == 0, '{"n_layer": ').otherwise(config),
        # two of three runs have no such file
        "misc_training_information.json": F.when(
            F.col("k") % 3 == 0, F.format_string('{"model_size": "%dM", "dataset_dir": "data/%s"}', "n", "seg")
        ),
        "all_results.json": F.format_string(
            '{"epoch": %d.25, "train_runtime": %d, "train_loss": %s}', "n", F.col("s") % 60, F.col("n") / 8
        ),
        "trainer_state.json": F.format_string(
            '{"best_metric": %s, "log_history": [{"eval_accuracy": 0.5}, {"eval_accuracy": %s}, {"loss": 1.0}]}',
            F.col("s") / 16,
            F.col("n") / 4,
        ),
        "README.md": F.format_string("# Run\n- learning_rate: 0.%d\n- train_batch_size: %d\n", "k", "n"),
    }
    items = {
        "generated_smiles.csv": F.lit("C\n"),
        "generate_args.json": F.format_string('{"num_beams": %d, "temperature": 0.75}', F.col("n") % 5),
        "assess_stats.json": F.format_string('{"Validity": %s, "FCD GuacaMol": 0.5}', F.col("s") / 32),
    }

    def files(kind: str, contents: dict) -> DataFrame:
        folder = F.concat(F.lit(f"{kind}_"), "k", F.lit("_"), "seg", F.lit("/"))
        each = [F.struct(F.concat(folder, F.lit(f)).alias("path"), c.alias("content")) for f, c in contents.items()]
        rows = groups.where((F.col("seg") == "BUILDING") == (kind == "gen"))
        return rows.select(F.inline(F.array(*each))).where("content is not null")

    return files("model", model).unionByName(files("gen", items))


@query(
    """
WITH g AS (SELECT c_nationkey AS k, c_mktsegment AS seg, count(*) AS n, sum(o_orderkey % 1000) AS s
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, seg = 'BUILDING' AS gen, concat('model_', k, '_', CASE seg WHEN 'BUILDING' THEN 'AUTOMOBILE' ELSE seg END) AS model FROM g),
reg AS (SELECT concat('model_', s_nationkey, '_AUTOMOBILE') AS model,
        CASE WHEN count(*) > 1 THEN 'Multiple' ELSE min(concat('s', s_suppkey)) END AS run_id FROM supplier GROUP BY 1),
m AS (SELECT * FROM r WHERE NOT gen)
SELECT CASE WHEN r.gen THEN concat('gen_', r.k, '_BUILDING') END AS "Generated directory", r.model AS "Model directory",
  CASE WHEN m.k IS NOT NULL THEN 'ByteLevel' END AS pre_tokenizer, CASE WHEN m.k IS NOT NULL THEN 'BPE' END AS algorithm,
  CAST(CASE WHEN m.k IS NOT NULL THEN 2 END AS INT) AS vocab_size,
  CAST(CASE WHEN m.k % 7 <> 0 THEN m.k END AS INT) AS layers, CAST(CASE WHEN m.k % 7 <> 0 THEN m.n % 8 END AS INT) AS heads,
  CASE WHEN m.k % 3 = 0 THEN concat(m.n, 'M') END AS model_size, CASE WHEN m.k % 3 = 0 THEN concat('data/', m.seg) END AS dataset_dir,
  CAST(m.n AS INT) AS num_epochs, CAST(m.n AS INT) AS batch_size, CAST('0.' || CAST(m.k AS VARCHAR) AS DOUBLE) AS lr, reg.run_id AS wandb_run_id,
  '0:00:' || lpad(CAST(m.s % 60 AS VARCHAR), 2, '0') AS train_runtime,
  CAST(m.n / 8 AS DOUBLE) AS train_loss, CAST(m.s / 16 AS DOUBLE) AS val_loss, CAST(m.n / 4 AS DOUBLE) AS val_acc,
  CAST(CASE WHEN r.gen THEN r.n % 5 END AS INT) AS num_beams, CASE WHEN r.gen THEN 0.75::DOUBLE END AS temperature,
  CAST(CASE WHEN r.gen THEN r.s / 32 END AS DOUBLE) AS validity_mols, CASE WHEN r.gen THEN 0.5::DOUBLE END AS fcd_g_mols
FROM r LEFT JOIN m ON m.model = r.model LEFT JOIN reg ON reg.model = r.model"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of runs written from orders and customers, found, read and collected, a row per run.

    Generated runs link to their nation's AUTOMOBILE model; suppliers stand for a registry of those.
    """
    path = shared_path(spark, "runs")
    write_named(_run_files(spark, sf_dir), path)
    runs = discover_runs(list_files(spark, path))
    model = F.regexp_replace("run", r"gen_(\d+)_BUILDING$", "model_$1_AUTOMOBILE")
    links = runs.where("has_items").select("run", model.alias("model_run"))
    registry = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("run_id"),
        "s_name",
        F.concat(F.lit("out/model_"), "s_nationkey", F.lit("_AUTOMOBILE")).alias("output_dir"),
    )
    found = collect_run_metrics(spark, path, links, registry.withColumnRenamed("s_name", "run_name"))
    return short_directories(found).select(
        "Generated directory", "Model directory", "pre_tokenizer", "algorithm", "vocab_size", "layers", "heads",
        "model_size", "dataset_dir", "num_epochs", "batch_size", "lr", "wandb_run_id", "train_runtime", "train_loss",
        "val_loss", "val_acc", "num_beams", "temperature", "validity_mols", "fcd_g_mols",
    )
