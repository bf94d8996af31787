"""Correlating collections: the two-step IN as one semi- or anti-join, which Catalyst broadcasts or shuffles by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of ``left`` whose column is among the other's values; null is in a list that has a null."""
    keys = right.select(F.col(other).alias("__in"))
    return left.join(keys, left[column].eqNullSafe(F.col("__in")), "left_semi")


def is_not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    keys = right.select(F.col(other).alias("__in"))
    return left.join(keys, left[column].eqNullSafe(F.col("__in")), "left_anti")
