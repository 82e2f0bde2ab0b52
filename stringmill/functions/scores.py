"""Scores derived from one number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_from_distance(distance: Column) -> Column:
    return F.exp(F.lit(-0.2) * distance)


def distance_from_score(score: Column) -> Column:
    return F.lit(-5.0) * F.log(score)


def perplexity(mean_loss: Column) -> Column:
    """``exp(loss)``; doubles overflow to Infinity by themselves."""
    return F.exp(mean_loss)
