"""Joins that keep rows with NULL keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__right_{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(renamed[f"__right_{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*[f"__right_{i}" for i in range(len(keys))])
