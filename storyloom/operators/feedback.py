"""Source authority from decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIOR = 5


def recalibrated(sources: DataFrame, feedback: DataFrame, candidates: DataFrame, items: DataFrame, as_of: Column, days: int = 30, prior: float = PRIOR) -> DataFrame:
    """(source_id, picks, passes, authority_score) of every enabled source; a decision counts once for each source of its cluster."""
    recent = feedback.filter(F.col("action").isin("pick", "pass") & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))))
    by_cluster = recent.join(candidates.select("candidate_id", "cluster_id"), "candidate_id").groupBy("cluster_id").agg(F.count_if(F.col("action") == "pick").alias("picks"), F.count_if(F.col("action") == "pass").alias("passes"))
    members = items.select("cluster_id", "source_id").distinct()  # before the join: one row for each source of a cluster
    votes = members.join(by_cluster, "cluster_id").groupBy("source_id").agg(F.sum("picks").alias("picks"), F.sum("passes").alias("passes"))
    p, f = F.coalesce("picks", F.lit(0)), F.coalesce("passes", F.lit(0))
    mean = (prior * F.col("authority_score_seed") / 100 + p) / (prior + p + f)
    score = F.greatest(F.lit(1), F.least(F.lit(100), F.floor(100 * mean + 0.5).cast("int")))
    return sources.filter("enabled").join(votes, "source_id", "left").select("source_id", p.alias("picks"), f.alias("passes"), score.alias("authority_score"))
