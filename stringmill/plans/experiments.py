"""Collecting metrics of runs and comparing groups of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import path_stem
from ..operators.runs import (
    attach_run_registry,
    available_metrics,
    catalogue_table,
    extract_metrics,
    link_generated_to_model,
    run_scopes,
    wide_metrics,
)
from ..operators.stats import best_group, rank_groups, sample_stats, t_test_against
from ..sources.artifacts import discover_runs, list_files, read_cards, read_json_artifacts
from ..sources.shared import stored


def collect_run_metrics(
    spark: SparkSession,
    root: str,
    links: DataFrame | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """One row per run below ``root``: generated folder, model folder and all metrics on offer.

    ``links`` is ``(run, model_run)`` for generated runs; they inherit the metrics of the model.
    """
    # both are read several times below; the files themselves are listed and parsed once
    runs = stored(discover_runs(list_files(spark, root)), "runs")
    metrics = extract_metrics(read_json_artifacts(spark, root), read_cards(spark, root))
    metrics = stored(metrics.join(runs.select("run"), "run", "left_semi"), "metrics")
    if links is None:
        links = spark.createDataFrame([], "run string, model_run string")
    owners = runs.join(links, "run", "left").withColumn(
        "model_run", F.when(F.col("has_model"), F.col("run")).otherwise(F.col("model_run"))
    )
    inherited = link_generated_to_model(
        owners.where(F.col("model_run") != F.col("run")).select("run", "model_run"), metrics
    )
    everything = metrics.unionByName(inherited)
    if registry is not None:
        named = attach_run_registry(
            owners.where("model_run is not null").select(
                "run", F.col("model_run").alias("output_dir")
            ),
            registry,
        )
        for column, metric in (("run_id", "wandb_run_id"), ("run_name", "wandb_run_name")):
            everything = everything.unionByName(
                named.where(F.col(column).isNotNull()).select(
                    "run", F.lit(metric).alias("metric"), F.col(column).alias("value")
                )
            )
    offered = available_metrics(
        run_scopes(owners, F.col("model_run").isNotNull()), catalogue_table(spark)
    )
    # at most one row per catalogue entry
    names = [r["metric"] for r in offered.orderBy("place").collect()]
    wide = wide_metrics(everything, names)
    generated = F.col("has_items") | F.col("has_templates")
    return owners.select(
        "run",
        F.when(generated, F.col("run")).alias("Generated directory"),
        F.col("model_run").alias("Model directory"),
    ).join(wide, "run", "left")


def short_directories(table: DataFrame) -> DataFrame:
    """The same table with folder stems instead of paths."""
    return table.withColumns(
        {c: path_stem(F.col(c)) for c in ("Generated directory", "Model directory")}
    )


def compare_groups(
    df: DataFrame,
    by: str = "group",
    value: str = "value",
    direction: str = "higher",
    alternative: str = "auto",
) -> DataFrame:
    """The best group with several values tested against every group, worst mean first."""
    stats = sample_stats(df, by, value)
    tested = t_test_against(stats, best_group(stats, direction, True, by), alternative, by)
    return rank_groups(tested, descending=direction == "lower", by=by)
