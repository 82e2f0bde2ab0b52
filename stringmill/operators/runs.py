"""Metrics of runs: catalogue, extraction, registry, wide tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import format_duration, path_stem, round_epoch
from ..functions.pieces import PATTERNS

UNKNOWN_ORDER = 999_999  # fixed value: place of a metric outside the catalogue
MULTIPLE = "Multiple"  # fixed value: shown when several registered runs match


@dataclass(frozen=True)
class Metric:
    """Name, scopes, type, number format, and where the value comes from."""

    name: str
    scopes: tuple[str, ...]
    dtype: str
    spec: str = ""
    file: str = ""
    path: str = ""


_MOLS, _RTS = "evaluation_mols", "evaluation_rts"

# fixed values: metrics in output order with the JSON key they are read from
CATALOGUE = (
    Metric("pre_tokenizer", ("tokenizer",), "string"),
    Metric("algorithm", ("tokenizer",), "string", "", "tokenizer.json", "$.model.type"),
    Metric("vocab_size", ("tokenizer",), "int"),
    Metric("layers", ("model",), "int", "", "config.json", "$.n_layer"),
    Metric("heads", ("model",), "int", "", "config.json", "$.n_head"),
    Metric("hidden_dim", ("model",), "int", "", "config.json", "$.n_embd"),
    Metric("model_size", ("model",), "string", "", "misc_training_information.json", "$.model_size"),
    Metric("dataset_dir", ("training",), "string", "", "misc_training_information.json", "$.dataset_dir"),
    Metric("num_epochs", ("training",), "int", "", "all_results.json", "$.epoch"),
    Metric("batch_size", ("training",), "int"),
    Metric("lr", ("training",), "double", ".4f"),
    Metric("wandb_run_id", ("wandb",), "string"),
    Metric("wandb_run_name", ("wandb",), "string"),
    Metric("train_runtime", ("training",), "string", "", "all_results.json", "$.train_runtime"),
    Metric("train_loss", ("training",), "double", ".4f", "all_results.json", "$.train_loss"),
    Metric("val_loss", ("training",), "double", ".4f", "trainer_state.json", "$.best_metric"),
    Metric("val_acc", ("training",), "double", ".4f"),
    Metric("test_loss", ("training",), "double", ".4f", "all_results.json", "$.test_loss"),
    Metric("test_acc", ("training",), "double", ".4f", "all_results.json", "$.test_accuracy"),
    Metric("test_ppl", ("training",), "double", ".4f", "all_results.json", "$.test_perplexity"),
    Metric("num_beams", (_MOLS, _RTS), "int", "", "generate_args.json", "$.num_beams"),
    Metric("temperature", (_MOLS, _RTS), "double", ".2f", "generate_args.json", "$.temperature"),
    Metric("repetition_penalty", (_MOLS, _RTS), "double", ".2f", "generate_args.json", "$.repetition_penalty"),
    Metric("validity_mols", (_MOLS,), "double", ".4f", "assess_stats.json", "$.Validity"),
    Metric("uniqueness_mols", (_MOLS,), "double", ".4f", "assess_stats.json", "$.Uniqueness"),
    Metric("novelty_mols", (_MOLS,), "double", ".4f", "assess_stats.json", "$.Novelty"),
    Metric("fcd_mols", (_MOLS,), "double", ".4f", "assess_stats.json", "$.FCD"),
    Metric("fcd_g_mols", (_MOLS,), "double", ".4f", "assess_stats.json", "$['FCD GuacaMol']"),
    Metric("validity_rts", (_RTS,), "double", ".4f", "generate_stats.json", "$.relative_fractions.valid"),
    Metric("uniqueness_rts", (_RTS,), "double", ".4f", "generate_stats.json", "$.relative_fractions.unique"),
    Metric("feasibility_rts", (_RTS,), "double", ".4f", "generate_stats.json", "$.relative_fractions.feasible"),
    Metric("known_either_rts", (_RTS,), "int", "", "generate_stats.json", "$.counts.known"),
    Metric("known_val_rts", (_RTS,), "int", "", "generate_stats.json", "$.counts.known_from_valid_set"),
    Metric("known_test_rts", (_RTS,), "int", "", "generate_stats.json", "$.counts.known_from_test_set"),
)
ORDER = {m.name: i for i, m in enumerate(CATALOGUE, start=1)}


def metric_order(name: Column) -> Column:
    """Place of a metric in the output; unknown ones come last."""
    places = F.create_map(*[F.lit(v) for kv in ORDER.items() for v in kv])
    return F.coalesce(F.try_element_at(places, name), F.lit(UNKNOWN_ORDER))


def detect_pre_tokenizer(tokenizer_json: Column) -> Column:
    """ByteLevel, Char, Atom or Smarts by the stored pre-tokenizer; else null."""
    kind = F.upper(F.get_json_object(tokenizer_json, "$.pre_tokenizer.type"))
    pattern = F.get_json_object(tokenizer_json, "$.pre_tokenizer.pattern.Regex")
    absent = F.get_json_object(tokenizer_json, "$.pre_tokenizer").isNull()
    named = F.try_variant_get(F.try_parse_json(tokenizer_json), "$.added_tokens", "variant").isNotNull()
    return (
        F.when(kind == "BYTELEVEL", "ByteLevel")
        .when((absent & named) | (pattern == PATTERNS["CHAR"]), "Char")
        .when((kind == "SPLIT") & (pattern == PATTERNS["ATOM"]), "Atom")
        .when((kind == "SPLIT") & (pattern == PATTERNS["SMARTS"]), "Smarts")
    )


def tokenizer_vocab_size(tokenizer_json: Column) -> Column:
    """Size without special tokens; the vocabulary is an object, or a list for Unigram."""
    vocab = F.get_json_object(tokenizer_json, "$.model.vocab")
    entries = F.coalesce(
        F.json_array_length(vocab), F.size(F.json_object_keys(vocab))
    )
    return entries - F.json_array_length(F.get_json_object(tokenizer_json, "$.added_tokens"))


def last_eval_value(state_json: Column, key: str = "eval_accuracy") -> Column:
    """Value of ``key`` in the last log entry that holds it; null when none does."""
    logs = F.from_json(F.get_json_object(state_json, "$.log_history"), "array<map<string,string>>")
    holding = F.filter(logs, lambda e: F.map_contains_key(e, key))
    return F.try_element_at(holding, F.lit(-1))[key]


def last_value(df: DataFrame, by: str, value: str, order_by: Sequence[str]) -> DataFrame:
    """The same over a log table: last non-null value per run."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(by).agg(F.max(F.struct(*order_by, value))[value].alias(value))


def extract_metrics(artifacts: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Long ``(run, metric, value)`` of everything the catalogue finds; values are text.

    A file is parsed once, to a VARIANT that the catalogue's paths are read from; a path that is
    not there, or a file that is no JSON, gives no row. Token models are read by path from the
    text, as a vocabulary may be larger than a VARIANT can be.
    """
    from ..sources.artifacts import card_values

    content = F.col("content")
    in_tokenizer = F.col("file") == "tokenizer.json"
    parsed = F.when(~in_tokenizer, F.try_parse_json(content))
    artifacts = artifacts.select("run", "file", "content", parsed.alias("parsed"))

    def pick(m: Metric) -> Column:
        if m.file == "tokenizer.json":
            value = F.get_json_object(content, m.path)
        else:
            value = F.try_variant_get("parsed", m.path, "string")
        if m.name == "num_epochs":
            value = round_epoch(value.cast("double")).cast("string")
        if m.name == "train_runtime":
            value = format_duration(value.cast("double"))
        return F.when(F.col("file") == m.file, value)

    found = {m.name: pick(m) for m in CATALOGUE if m.path}
    found["pre_tokenizer"] = F.when(in_tokenizer, detect_pre_tokenizer(content))
    found["vocab_size"] = F.when(in_tokenizer, tokenizer_vocab_size(content).cast("string"))
    found["val_acc"] = F.when(F.col("file") == "trainer_state.json", last_eval_value(content))
    result = _long(artifacts, found)
    if cards is not None:
        result = result.unionByName(_long(cards, card_values(content)))
    return result


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])
    return df.select("run", F.inline(pairs)).where("value is not null")


def attach_run_registry(runs: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``run_id, run_name`` of the registered run with the same folder stem.

    None gives null; several give ``Multiple``, or an error when ``strict``.
    """

    def only(column: str) -> Column:
        many = (
            F.raise_error(F.concat(F.lit("several runs for "), F.first("stem"))).cast("string")
            if strict
            else F.lit(MULTIPLE)
        )
        return F.when(F.count("*") > 1, many).otherwise(F.first(column)).alias(column)

    table = (
        registry.withColumn("stem", path_stem(F.col("output_dir")))
        .groupBy("stem")
        .agg(only("run_id"), only("run_name"))
    )
    return runs.withColumn("stem", path_stem(F.col("output_dir"))).join(table, "stem", "left")


def registry_mismatch(local: DataFrame, attached: DataFrame, by: str = "stem") -> DataFrame:
    """Runs whose own id differs from the registered one (both present)."""
    joined = local.select(by, F.col("run_id").alias("local_id")).join(
        attached.select(by, F.col("run_id").alias("registry_id")), by
    )
    return joined.where(F.col("local_id") != F.col("registry_id"))


def link_generated_to_model(links: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of the linked model under the name of the generated run.

    ``links`` is ``(run, model_run)``; a run that links nowhere yields nothing.
    """
    return (
        links.join(metrics.withColumnRenamed("run", "model_run"), "model_run")
        .select("run", "metric", "value")
    )


def wide_metrics(
    metrics: DataFrame, names: Sequence[str] | None = None, typed: bool = True, by: str = "run"
) -> DataFrame:
    """One row per run, metrics as columns in catalogue order (or in the order of ``names``)."""
    names = list(names) if names else [m.name for m in CATALOGUE]
    wide = metrics.groupBy(by).pivot("metric", names).agg(F.first("value", ignorenulls=True))
    if not typed:
        return wide
    types = {m.name: m.dtype for m in CATALOGUE}
    return wide.select(
        by, *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in names]
    )


def catalogue_table(spark) -> DataFrame:
    """The catalogue as a table: ``(metric, place, dtype, spec, scope)``, one row per scope."""
    rows = [(m.name, ORDER[m.name], m.dtype, m.spec, s) for m in CATALOGUE for s in m.scopes]
    return spark.createDataFrame(
        rows, "metric string, place int, dtype string, spec string, scope string"
    )


def run_scopes(runs: DataFrame, model_linked: Column | None = None) -> DataFrame:
    """Adds ``scopes`` a run offers metrics for."""
    model = F.col("has_model") if model_linked is None else F.col("has_model") | model_linked
    parts = [
        F.when(model, F.array(*[F.lit(s) for s in ("tokenizer", "model", "training", "wandb")])),
        F.when(F.col("has_items"), F.array(F.lit(_MOLS))),
        F.when(F.col("has_templates"), F.array(F.lit(_RTS))),
    ]
    empty = F.array().cast("array<string>")
    return runs.withColumn("scopes", F.concat(*[F.coalesce(p, empty) for p in parts]))


def available_metrics(runs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Metrics with a scope that at least one run has, with their place, ``(metric, place)``."""
    scopes = runs.select(F.explode("scopes").alias("scope")).distinct()
    return catalogue.join(scopes, "scope", "left_semi").select("metric", "place").distinct()


def metric_type_check(metrics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Values that do not read as the declared type of their metric."""
    types = catalogue.select("metric", "dtype").distinct()
    value = F.col("value")
    fits = (
        F.when(F.col("dtype") == "int", value.try_cast("int").isNotNull() & ~value.contains("."))
        .when(F.col("dtype") == "double", value.try_cast("double").isNotNull())
        .otherwise(F.lit(True))
    )
    return metrics.where(value.isNotNull()).join(types, "metric").where(~fits)
