"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(ranked: DataFrame, relevant: DataFrame, query: str, doc: str, k: int, rank: str = "rank") -> DataFrame:
    """(query, hits, n_relevant, precision, recall) at k; queries with nothing relevant have null recall."""
    top = ranked.where(F.col(rank) <= k)
    hits = top.join(relevant.select(query, doc).distinct(), [query, doc], "left_semi").groupBy(query).agg(F.count(F.lit(1)).alias("hits"))
    total = relevant.select(query, doc).distinct().groupBy(query).agg(F.count(F.lit(1)).alias("n_relevant"))
    asked = ranked.select(query).distinct().join(total, query, "full").join(hits, query, "left")
    return asked.select(query, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")).withColumn("precision", F.col("hits") / F.lit(float(k))).withColumn("recall", F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")))


def recall_against(exact: DataFrame, found: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, recall) of an approximate result against the exact one."""
    marked = exact.select(query, doc).join(found.select(query, doc).distinct().withColumn("_hit", F.lit(1)), [query, doc], "left")
    return marked.groupBy(query).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def rank_by(df: DataFrame, query: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def accept_rates(scores: DataFrame, score: str, genuine: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tar, far): shares of genuine and of impostor pairs accepted at each threshold."""
    cuts = F.explode(F.array(*map(F.lit, thresholds)))
    rows = scores.withColumn("threshold", cuts)
    return rows.groupBy("threshold").agg(F.avg(F.when(F.col(genuine), (F.col(score) >= F.col("threshold")).cast("int"))).alias("tar"), F.avg(F.when(~F.col(genuine), (F.col(score) >= F.col("threshold")).cast("int"))).alias("far"))
