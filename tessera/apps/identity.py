"""Identity matching from nearest samples, under consent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, NEIGHBOURS = 0.45, 5
#: Sources whose identities count only where they are allowed.
DATASETS = ("public_lfw", "public_celeba")


def allowed(identities: DataFrame, allow_datasets: bool = False) -> DataFrame:
    """Identities that may be returned: not withdrawn, participants with granted consent, datasets if allowed."""
    status, source = F.col("consent_status"), F.col("source")
    ok = (F.coalesce(status, F.lit("")) != "withdrawn") & ((source != "participant") | F.coalesce(status == "granted", F.lit(False)))
    return identities.where(ok if allow_datasets else ok & ~F.coalesce(source, F.lit("")).isin(*DATASETS))


def candidates(hits: DataFrame, identities: DataFrame, aggregation: str = "max", allow_datasets: bool = False) -> DataFrame:
    """(query_id, identity columns, score, best_sample_score, matched_samples) from hits (query_id, identity_id, sample_id, score).

    The score is the best sample's, or with 'mean_top' the mean of the three best.
    """
    w = Window.partitionBy("query_id", "identity_id").orderBy(F.col("score").desc(), "sample_id")
    ranked = hits.where(F.col("identity_id").isNotNull()).withColumn("_n", F.row_number().over(w))
    score = F.max("score") if aggregation == "max" else F.avg(F.when(F.col("_n") <= 3, F.col("score")))
    grouped = ranked.groupBy("query_id", "identity_id").agg(score.alias("score"), F.max("score").alias("best_sample_score"), F.count(F.lit(1)).alias("matched_samples"), F.min_by("sample_id", "_n").alias("sample_id"))
    return grouped.join(allowed(identities, allow_datasets), "identity_id")


def decide(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, identity_id, score, status): the best identity, 'registered' if it reaches the threshold, else 'unknown'."""
    best = found.groupBy("query_id").agg(F.max_by("identity_id", F.struct("score", -F.col("identity_id"))).alias("identity_id"), F.max("score").alias("score"))
    known = F.col("score") >= threshold
    return best.select("query_id", F.when(known, F.col("identity_id")).alias("identity_id"), "score", F.when(known, "registered").otherwise("unknown").alias("status"))


def may_enrol(consents: DataFrame, purpose: str) -> DataFrame:
    """Identities with a granted, not withdrawn consent for a purpose."""
    return consents.where((F.col("purpose") == purpose) & (F.col("status") == "granted") & F.col("withdrawn_at").isNull()).select("identity_id").distinct()
