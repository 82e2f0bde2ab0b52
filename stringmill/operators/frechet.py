"""Moments of vector columns and the Fréchet distance between two samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


def with_embedding(
    df: DataFrame,
    load: Callable[[], Callable[[pd.Series], np.ndarray]],
    col: str = "item",
    out: str = "embedding",
) -> DataFrame:
    """Adds a vector per row. ``load`` runs once per task and returns the embedding function."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(fn(batch), dtype=np.float32)))

    return df.withColumn(out, embed(F.col(col)))


def embedding_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row ``(n, mu, sigma)`` with the sample covariance (n - 1).

    One pass: every task sums its vectors to count, mean and centred products, and these are
    merged in two steps by streaming tasks. The size of what is merged depends on the vector
    width and the number of tasks, not on the number of rows.
    """
    vectors = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    parts = vectors.mapInArrow(_sum_vectors, _PARTS)
    merged = parts.repartition(MERGE_TASKS).mapInArrow(_merge_parts, _PARTS)
    total = merged.repartition(1).mapInArrow(_merge_parts, _PARTS).first()
    if total is None or total["n"] < 2:
        raise ValueError("a covariance needs at least two rows")
    width = len(total["mean"])
    sigma = np.array(total["products"]).reshape(width, width) / (total["n"] - 1)
    return df.sparkSession.createDataFrame(
        [(total["n"], total["mean"], sigma.tolist())], schemas.MOMENTS
    )


MERGE_TASKS = 16
_PARTS = "n long, mean array<double>, products array<double>"
_Part = tuple[int, np.ndarray, np.ndarray]


def _merge(a: _Part | None, b: _Part) -> _Part:
    """Count, mean and centred products of two samples together."""
    if a is None:
        return b
    if len(a[1]) != len(b[1]):
        raise ValueError(f"vectors of different lengths: {len(a[1])}, {len(b[1])}")
    n = a[0] + b[0]
    shift = b[1] - a[1]
    mean = a[1] + shift * (b[0] / n)
    return n, mean, a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _row(part: _Part | None) -> Iterator[pa.RecordBatch]:
    if part is not None:
        n, mean, products = part
        columns = [pa.array([n]), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])]
        yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "products"])


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None
    for batch in batches:
        if batch.num_rows:
            widths = pc.list_value_length(batch.column("v")).unique()
            if len(widths) > 1:
                raise ValueError(f"vectors of different lengths: {widths.to_pylist()[:5]}")
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            mean = x.mean(0)
            part = _merge(part, (len(x), mean, (x - mean).T @ (x - mean)))
    yield from _row(part)


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None
    for batch in batches:
        for i in range(batch.num_rows):
            mean = batch.column("mean")[i].values.to_numpy()
            products = batch.column("products")[i].values.to_numpy()
            part = _merge(part, (batch.column("n")[i].as_py(), mean, products.reshape(len(mean), -1)))
    yield from _row(part)


def covariance_entries(stats: DataFrame) -> DataFrame:
    """Long form of the moments: ``(i, j, mu_i, cov)``."""
    rows = stats.select("mu", F.posexplode("sigma").alias("i", "line"))
    return rows.select(
        "i", F.element_at("mu", F.col("i") + 1).alias("mu_i"), F.posexplode("line").alias("j", "cov")
    )


def _moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    row = stats.select("mu", "sigma").first()
    return np.array(row["mu"]), np.array(row["sigma"])


def _root(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(matrix)
    return (vectors * np.sqrt(np.clip(values, 0.0, None))) @ vectors.T


def frechet_distance(a: DataFrame, b: DataFrame) -> float:
    """Distance of two one-row moment tables; only the d x d step runs on the driver."""
    (mu_a, cov_a), (mu_b, cov_b) = _moments(a), _moments(b)
    if mu_a.shape != mu_b.shape:
        raise ValueError("the moments have different widths")
    root = _root(cov_a)
    cross = np.linalg.eigvalsh(root @ cov_b @ root)
    spread = np.trace(cov_a) + np.trace(cov_b) - 2.0 * np.sqrt(np.clip(cross, 0.0, None)).sum()
    return float(((mu_a - mu_b) ** 2).sum() + spread)
