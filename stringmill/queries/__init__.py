"""All named queries."""

from . import corpora, runs, samples, statistics, streams, templates, tokens  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
