"""Grouped sample statistics and significance tests on them.

The data is aggregated once to moments per group; all tests are column arithmetic on the
few rows that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.student import alternative_name, t_p_value

ALPHA = 0.05  # fixed value: level of all tests
DIRECTIONS = ("higher", "lower")


def sample_stats(df: DataFrame, by: str | Sequence[str] = "group", value: str = "value") -> DataFrame:
    """Per group ``n, mean, std, var`` (ddof = 1); one value has a mean but no spread."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("var"),
    )


def one_sample_t(mean: Column, std: Column, n: Column, mu: Column) -> tuple[Column, Column]:
    """(t, df) of a sample against a fixed mean."""
    return (mean - mu) / (std / F.sqrt(n)), (n - 1).cast("double")


def unequal_spread(std_a: Column, std_b: Column) -> Column:
    """Whether one standard deviation is more than twice the other."""
    return (std_a > 2.0 * std_b) | (std_b > 2.0 * std_a)


def two_sample_t(
    mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column
) -> tuple[Column, Column]:
    """(t, df): pooled variance, or Welch when the spreads differ by more than a factor of 2."""
    welch = unequal_spread(F.sqrt(var_a), F.sqrt(var_b))
    share_a, share_b = var_a / n_a, var_b / n_b
    pooled = ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
    error = F.when(welch, F.sqrt(share_a + share_b)).otherwise(
        F.sqrt(pooled * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    )
    df_welch = F.pow(share_a + share_b, 2) / (
        F.pow(share_a, 2) / (n_a - 1) + F.pow(share_b, 2) / (n_b - 1)
    )
    df = F.when(welch, df_welch).otherwise((n_a + n_b - 2).cast("double"))
    return (mean_a - mean_b) / error, df


def reject(p: Column, alpha: float = ALPHA) -> Column:
    return p < F.lit(alpha)


def t_test_1samp(stats: DataFrame, mu: float, alternative: str = "two-sided") -> DataFrame:
    """Adds ``t, df, p, reject`` of every group against one fixed mean."""
    t, df = one_sample_t(F.col("mean"), F.col("std"), F.col("n"), F.lit(float(mu)))
    tested = stats.withColumns({"t": t, "df": df})
    p = t_p_value(F.col("t"), F.col("df"), F.lit(alternative_name(alternative)))
    return tested.withColumn("p", p).withColumn("reject", reject(F.col("p")))


def best_group(
    stats: DataFrame, direction: str = "higher", with_sample: bool = True, by: str = "group"
) -> DataFrame:
    """The row with the best mean; ``with_sample`` skips groups of a single value."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    rows = stats.where(F.col("n") > 1) if with_sample else stats
    order = F.col("mean").desc() if direction == "higher" else F.col("mean").asc()
    return rows.orderBy(order, by).limit(1)


def rank_groups(stats: DataFrame, descending: bool = False, by: str = "group") -> DataFrame:
    order = F.col("mean").desc() if descending else F.col("mean").asc()
    return stats.orderBy(order, by)


def t_test_against(
    stats: DataFrame, baseline: DataFrame, alternative: str = "two-sided", by: str = "group"
) -> DataFrame:
    """One baseline row tested against every group.

    A group with one value is tested as a fixed mean, a sample by the two-sample test.
    ``alternative="auto"`` follows the sign of the mean difference: less when the baseline is
    below the group, else greater. The baseline is a single row and enters as constants.
    """
    base = baseline.select(by, "n", "mean", "var", "std").first()
    if base is None:
        raise ValueError("there is no baseline group")
    b = {c: F.lit(base[c]) for c in ("n", "mean", "var", "std")}
    t1, df1 = one_sample_t(b["mean"], b["std"], b["n"], F.col("mean"))
    t2, df2 = two_sample_t(b["mean"], b["var"], b["n"], F.col("mean"), F.col("var"), F.col("n"))
    single = F.col("n") == 1
    if alternative == "auto":
        side = F.when(b["mean"] < F.col("mean"), "less").otherwise("greater")
    else:
        side = F.lit(alternative_name(alternative))
    tested = stats.withColumns(
        {
            "baseline": F.lit(base[by]),
            "baseline_mean": b["mean"],
            "test": F.when(single, "one-sample")
            .when(unequal_spread(b["std"], F.col("std")), "welch")
            .otherwise("pooled"),
            "alternative": side,
            "t": F.when(single, t1).otherwise(t2),
            "df": F.when(single, df1).otherwise(df2),
        }
    )
    p = t_p_value(F.col("t"), F.col("df"), F.col("alternative"))
    return tested.withColumn("p", p).withColumn("reject", reject(F.col("p")))


def normality_check(
    df: DataFrame, by: str = "group", value: str = "value", alpha: float = ALPHA
) -> DataFrame:
    """Jarque-Bera test per group from skewness and kurtosis, in one pass at any size."""
    rows = df.groupBy(by).agg(
        F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")
    )
    jb = F.col("n") / 6.0 * (F.pow("skew", 2) + F.pow("kurt", 2) / 4.0)
    return (
        rows.withColumn("jb", jb)
        .withColumn("p", F.exp(-F.col("jb") / 2.0))
        .withColumn("normal", F.col("p") > alpha)
    )
