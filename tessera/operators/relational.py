"""Relational operators with an explicit policy for nulls and ties: ANSI nulls, total orders where rows are picked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strategies of an inner equi-join, as the optimizer's hints; without one it chooses by size.
JOIN_HINTS = {"hash": "shuffle_hash", "sort_merge": "merge", "broadcast": "broadcast"}
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def equi_join(left: DataFrame, right: DataFrame, on: Column, strategy: str | None = None) -> DataFrame:
    """Inner join; null keys match nothing."""
    return left.join(right.hint(JOIN_HINTS[strategy]) if strategy else right, on, "inner")


def semi_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ``keys``: what a bitmap of row numbers does for an index."""
    return df.join(keys, on, "left_semi")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order; a window group limit prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str, *aggregates: Column) -> DataFrame:
    """Aggregates, with plain columns taken from the row of each group with the least ``order``; partial aggregation, no sort."""
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns], *aggregates)


def null_order(column: str, ascending: bool = True) -> Column:
    """Nulls first when ascending, last when descending."""
    return F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()


def predecessor(df: DataFrame, column: str, value: object) -> DataFrame:
    """The greatest value not above ``value``."""
    return df.where(F.col(column) <= F.lit(value)).agg(F.max(column).alias(column))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have; a key with a null part is exempt."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
