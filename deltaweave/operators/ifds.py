"""IFDS tabulation: IDE without values."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import ide
from .ide import Options, Problem

__all__ = ["Options", "Problem", "solve"]


def solve(p: Problem, seeds: DataFrame, max_rounds: int = 10_000, **options) -> DataFrame:
    """Path edges (d1, n, d2) reachable from seeds (n, d), each with the self-loop (d, n, d)."""
    return ide.solve(p, seeds, options=Options(max_rounds=max_rounds, **options)).select("d1", "n", "d2").distinct()
