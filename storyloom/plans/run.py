"""The scoring run: clusters to ranked candidates, set at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import candidates as C
from storyloom.operators import signals as S
from storyloom.sources.shared import written


def scored(items: DataFrame, clusters: DataFrame, sources: DataFrame, coverage: DataFrame, as_of: Column, days: int = 30, n: int = 200, hours: int = 24, heat_days: int = 30, similarity: DataFrame | None = None) -> DataFrame:
    """The pool's best clusters with all their signals. ``clusters`` is the stored state; the pool's items are read once."""
    pool = S.pool(clusters, as_of, days)
    facts = S.facts(items.join(pool.select("cluster_id"), "cluster_id", "left_semi"), sources, as_of, hours)
    rows = pool.select("cluster_id", "primary_domain", "first_seen_at").join(facts, "cluster_id").join(S.latest_coverage(coverage).select("cluster_id", "country_count"), "cluster_id", "left")
    geo = S.spread_of(F.col("country_count"))
    rows = rows.withColumns({"geo": geo, "score": S.score_of(F.col("authority"), F.col("primary_domain"), geo, F.col("is_exclusive"), F.col("arxiv_only"))})
    best = S.top(rows, n)  # n rows
    young = S.moved(best, as_of, hours).withColumnRenamed("cluster_id", "c")
    heat = S.temperature(clusters, as_of, heat_days, similarity).select("cluster_id", "z", "temperature")
    return best.join(F.broadcast(young), F.col("cluster_id") == F.col("c")).join(heat, "cluster_id").select("cluster_id", "authority", "geo", "arxiv_only", "score", "ratio", "trajectory", "z", "temperature", "is_exclusive")


def charged(rows: DataFrame, ceiling: int, spent: int = 0, projected: tuple[int, int] = (0, 0)) -> DataFrame:
    """rows(cluster_id, score, decision, failed, summarise_micros, curate_micros) with ``halted`` and ``micros``, the spend of each in millionths of a dollar.

    Clusters go by score. Each pays for a summary, and if that didn't fail and the archive didn't drop it, for a curation; a call that fails is
    paid too. Before a call the spend so far with the call's projected cost must stay below the ceiling; else the run halts there, and all later
    clusters with it. The rows are a run's best clusters, so one window holds them.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "cluster_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    goes = ~F.col("failed").eqNullSafe("summarise") & (F.col("decision") != "drop")
    whole = F.col("summarise_micros") + F.when(goes, F.col("curate_micros")).otherwise(0)
    sofar = F.lit(spent) + F.coalesce(F.sum(whole).over(earlier), F.lit(0))
    at_first = F.col("sofar") + projected[0] >= ceiling
    at_second = goes & (F.col("sofar") + F.col("summarise_micros") + projected[1] >= ceiling)
    judged = rows.withColumn("sofar", sofar).withColumns({"first": at_first, "second": at_second})
    judged = judged.withColumn("after", F.coalesce(F.bool_or(F.col("first") | F.col("second")).over(earlier), F.lit(False)))
    micros = F.when(F.col("after") | F.col("first"), 0).when(F.col("second"), F.col("summarise_micros")).otherwise(whole)
    return judged.withColumns({"halted": F.col("after") | F.col("first") | F.col("second"), "micros": micros}).drop("sofar", "first", "second", "after")


def run(items: DataFrame, clusters: DataFrame, sources: DataFrame, coverage: DataFrame, candidates: DataFrame, curations: DataFrame, as_of: Column, cutoff: float = 60, days: int = 30, heat_days: int = 30, similarity: DataFrame | None = None, gate: Callable[[DataFrame], DataFrame] | None = None, ceiling: int | None = None, spent: int = 0, projected: tuple[int, int] = (0, 0)) -> DataFrame:
    """(cluster_id, score, temperature, trajectory, overlap, decision, curation_score, stage, outcome, candidate_id, pulse_rank, micros) of the best clusters.

    A pass with the model's curations(cluster_id, curation_score, and where there are any failed, summarise_micros, curate_micros) joined in. ``gate``
    gives (cluster_id, overlap, decision) of the archive for the best clusters alone; a cluster without a match has overlap 0 and passes. The stage tells
    how far a cluster came: halted (by the ceiling, in millionths of a dollar), failed_summarise, archived, failed_curate, below_cutoff, decided
    (skipped) or saved; the five best saved ones have a pulse rank.
    """
    best = written(scored(items, clusters, sources, coverage, as_of, days, heat_days=heat_days, similarity=similarity), "best")
    for name, kind in (("failed", "string"), ("summarise_micros", "long"), ("curate_micros", "long")):
        curations = curations if name in curations.columns else curations.withColumn(name, F.lit(None if kind == "string" else 0).cast(kind))
    gated = best.join(curations, "cluster_id").join(clusters.select("cluster_id", "primary_domain"), "cluster_id")
    found = best.select("cluster_id", F.lit(None).cast("double").alias("overlap"), F.lit(None).cast("string").alias("decision")) if gate is None else gate(best.select("cluster_id"))
    gated = gated.join(found, "cluster_id", "left").withColumns({"overlap": F.coalesce("overlap", F.lit(0.0)), "decision": F.coalesce("decision", F.lit("pass"))})
    paid = charged(gated, 2**62 if ceiling is None else ceiling, spent, projected)
    reached = F.when(F.col("halted"), "halted").when(F.col("failed") == "summarise", "failed_summarise").when(F.col("decision") == "drop", "archived").when(F.col("failed") == "curate", "failed_curate").when(F.col("curation_score") < cutoff, "below_cutoff")
    paid = written(paid.withColumn("reached", reached), "charged")
    kept = paid.filter("reached IS NULL").select("cluster_id", "primary_domain")
    saved = C.upsert(kept, candidates.join(F.broadcast(kept.select("cluster_id")), "cluster_id", "left_semi"), as_of)  # as many as are the best
    joined = paid.join(saved.drop("expires_at"), "cluster_id", "left")
    stage = F.coalesce("reached", F.when(F.col("outcome") == "skipped_decided", "decided").otherwise("saved"))
    ranked = joined.withColumn("stage", stage).withColumn("n", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("curation_score"), "cluster_id")))
    return ranked.select("cluster_id", "score", "temperature", "trajectory", "overlap", "decision", "curation_score", "stage", "outcome", "candidate_id", F.when((F.col("stage") == "saved") & (F.col("n") <= 5), F.col("n")).alias("pulse_rank"), "micros")


def funnel(passed: DataFrame, by: str = "run_id") -> DataFrame:
    """A row of counts for each run: considered, advanced (a summary was asked for), dropped, flagged, failed at each stage, halted, below the cutoff, decided before, inserted, superseded, and the run's own spend."""
    stage = lambda name: F.count_if(F.col("stage") == name)
    outcome = lambda name: F.count_if(F.col("outcome") == name)
    gone = F.col("stage").isin("halted", "failed_summarise")
    return passed.groupBy(by).agg(
        F.count("*").alias("considered"), F.count_if(F.col("micros") > 0).alias("advanced"), stage("archived").alias("dropped"), F.count_if((F.col("decision") == "flag") & ~gone).alias("flagged"),
        stage("failed_summarise").alias("failed_summarise"), stage("failed_curate").alias("failed_curate"), stage("halted").alias("halted"), stage("below_cutoff").alias("below_cutoff"), stage("decided").alias("skipped"),
        outcome("inserted").alias("inserted"), outcome("superseded").alias("superseded"), (F.sum("micros") / 1_000_000).alias("usd"),
    )
