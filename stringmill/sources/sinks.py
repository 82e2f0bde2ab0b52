"""Writers. All of them write in parallel; part files of one folder are in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.formats import format_metric

METRIC_FORMATS = ("CSV", "JSON", "MD", "ALL")


def _csv_out(df: DataFrame, path: str, header: bool, mode: str) -> None:
    (
        df.write.mode(mode)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def write_items(df: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    """All columns but ``ord`` as CSV without an index; a present ``ord`` sets the row order."""
    if "ord" in df.columns:
        df = df.orderBy("ord").drop("ord")
    _csv_out(df, path, header, mode)


def tally_json(tally: DataFrame) -> DataFrame:
    """One row ``value``: counts, absolute_fractions and relative_fractions as JSON."""

    def section(column: str) -> Column:
        # a tally has a handful of counters, so the list is short by definition
        entries = F.array_sort(F.collect_list(F.struct("idx", "counter", F.col(column).alias("v"))))
        return F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["counter"], e["v"]))
        )

    packed = tally.agg(
        section("count").alias("counts"),
        section("absolute_fraction").alias("absolute_fractions"),
        section("relative_fraction").alias("relative_fractions"),
    )
    return packed.select(F.to_json(F.struct("*")).alias("value"))


def write_tally_json(tally: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tally_json(tally).write.mode(mode).text(path)


def write_eval_json(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    result.write.mode(mode).json(path)


def markdown_rows(df: DataFrame, order_by: str) -> DataFrame:
    """Lines of a Markdown table as ``(line_no, value)``, ordered by a column of the table."""
    spark, names = df.sparkSession, df.columns
    head = ["| " + " | ".join(names) + " |", "|" + "|".join(":--" for _ in names) + "|"]
    top = spark.createDataFrame(
        [(i - len(head), "", h) for i, h in enumerate(head)], "line_no int, key string, value string"
    )
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    body = df.select(
        F.lit(0).alias("line_no"),
        F.col(f"`{order_by}`").cast("string").alias("key"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"),
    )
    return top.unionByName(body)


def write_metrics(
    df: DataFrame, path: str, fmt: str = "ALL", order_by: str = "run", mode: str = "errorifexists"
) -> None:
    """A wide metrics table as ``path/csv``, ``path/json`` (one object per run) and ``path/md``."""
    fmt = fmt.upper()
    if fmt not in METRIC_FORMATS:
        raise ValueError(f"fmt must be one of {METRIC_FORMATS}")
    rows = df.orderBy(order_by)
    if fmt in ("CSV", "ALL"):
        _csv_out(rows, f"{path}/csv", True, mode)
    if fmt in ("JSON", "ALL"):
        shown = [
            F.round(F.col(f"`{f.name}`"), 3).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
        rows.select(*shown).write.mode(mode).option("ignoreNullFields", False).json(f"{path}/json")
    if fmt in ("MD", "ALL"):
        lines = markdown_rows(df, order_by).orderBy("line_no", "key").select("value")
        lines.write.mode(mode).text(f"{path}/md")


def save_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    stats.select("n", "mu", "sigma").write.mode(mode).parquet(path)


def load_stats(spark, path: str) -> DataFrame:
    """Stored moments; tables holding only mu and sigma get a null count."""
    raw = spark.read.parquet(path)
    if not {"mu", "sigma"} <= set(raw.columns):
        raise ValueError(f"{path} holds no mu and sigma")
    n = F.col("n") if "n" in raw.columns else F.lit(None).cast("long")
    return raw.select(n.alias("n"), *[F.col(c).cast(schemas.MOMENTS[c].dataType) for c in ("mu", "sigma")])


def format_wide(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Text form of the metric columns named in ``formats``."""
    return df.select(
        *[
            format_metric(F.col(f"`{c}`"), formats[c]).alias(c) if c in formats else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
