"""Evaluating a sample against a reference, and reference statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import score_from_distance
from ..functions.text import trimmed
from ..operators.canonical import with_canonical
from ..operators.cuts import first_n
from ..operators.frechet import embedding_stats, frechet_distance
from ..operators.quality import basic_stats
from ..sources.sinks import save_stats


def evaluate_items(
    gen: DataFrame,
    reference: DataFrame | None = None,
    stats: DataFrame | None = None,
    n: int | None = None,
    canonical: Callable[[Column], Column] = trimmed,
    vec: str = "embedding",
) -> DataFrame:
    """One row: FCD, FCD GuacaMol and, with reference rows, Validity, Uniqueness, Novelty.

    ``gen`` and ``reference`` hold ``item`` and the vector column, ``gen`` also ``ord`` and
    ``valid``. The set metrics are taken of the first ``n`` generated rows, the distance of the
    first ``n`` valid ones. Stored statistics win over reference rows for the distance.
    """
    if reference is None and stats is None:
        raise ValueError("reference rows or stored statistics are needed")
    sample = gen if n is None else first_n(gen, n)
    valid = gen.where("valid")
    valid = valid if n is None else first_n(valid, n)
    target = stats if stats is not None else embedding_stats(reference, vec)
    distance = F.lit(frechet_distance(embedding_stats(valid, vec), target))
    scores = [distance.alias("FCD"), score_from_distance(distance).alias("FCD GuacaMol")]
    if reference is None:
        return gen.sparkSession.range(1).select(*scores)
    sets = basic_stats(with_canonical(sample, "item", canonical), reference)
    return sets.select(*scores, "*")


def precompute_stats(
    items: DataFrame,
    path: str,
    canonical: Callable[[Column], Column] = trimmed,
    vec: str = "embedding",
) -> DataFrame:
    """Moments of reference items, stored for later; every item must have a canonical form."""
    broken = with_canonical(items, "item", canonical).where("canonical is null").limit(1).collect()
    if broken:
        raise ValueError(f"no canonical form: {broken[0]['item']!r}")
    stats = embedding_stats(items, vec)
    save_stats(stats, path)
    return stats
