"""Per-cluster signals, set at a time over all clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.schemas import DOMAINS

EXCLUSIVE_AUTHORITY = 75
EXCLUSIVE_HOURS = 4


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def exclusive(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, source_id, authority, gap_hours, is_exclusive) from each source's earliest publication."""
    first = items.groupBy("cluster_id", "source_id").agg(F.min("published_at").alias("at"))
    order = Window.partitionBy("cluster_id").orderBy("at", "source_id")
    lead = first.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("at").over(order)).filter("n = 1")
    joined = lead.join(sources.select("source_id", "authority_score"), "source_id")
    gap = hours_between(F.col("at"), F.col("next"))
    return joined.select("cluster_id", "source_id", F.col("authority_score").alias("authority"), F.round(gap, 6).alias("gap_hours"), F.coalesce((F.col("authority_score") >= EXCLUSIVE_AUTHORITY) & (gap > EXCLUSIVE_HOURS), F.lit(False)).alias("is_exclusive"))


def trajectory(items: DataFrame, clusters: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(cluster_id, ratio, trajectory): the last ``hours`` against those before; a young cluster is new."""
    edge, before = as_of - F.make_dt_interval(F.lit(0), F.lit(hours)), as_of - F.make_dt_interval(F.lit(0), F.lit(2 * hours))
    counts = items.groupBy("cluster_id").agg(F.count_if(F.col("published_at") > edge).alias("now"), F.count_if((F.col("published_at") > before) & (F.col("published_at") <= edge)).alias("then"))
    return moved(clusters.join(counts, "cluster_id", "left"), as_of, hours)


def moved(counted: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(cluster_id, ratio, trajectory) of clusters with their counts of now and then."""
    young = F.col("first_seen_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    ratio = F.when(young, 0.0).otherwise(F.coalesce(F.col("now"), F.lit(0)) / F.greatest(F.coalesce(F.col("then"), F.lit(0)), F.lit(1)))
    label = F.when(young, "new").when(ratio > 1.5, "rising").when(ratio >= 0.7, "peaking").otherwise("declining")
    return counted.select("cluster_id", F.round(ratio, 6).alias("ratio"), label.alias("trajectory"))


def temperature(clusters: DataFrame, as_of: Column, days: int = 30, similarity: DataFrame | None = None, loud: float = 2.5, alike: float = 0.75) -> DataFrame:
    """(cluster_id, z, temperature) against the other active clusters of the domain, by leave-one-out sums; loud clusters of like items are over-saturated."""
    counted = (F.col("status") == "active") & (F.col("first_seen_at") >= as_of - F.make_dt_interval(F.lit(days)))
    n = F.col("item_count").cast("double")
    sums = clusters.filter(counted).groupBy("primary_domain").agg(F.count("*").alias("c"), F.sum(n).alias("s"), F.sum(n * n).alias("q"))
    joined = clusters.join(F.broadcast(sums), "primary_domain", "left")  # one row for each domain
    mine = F.when(counted, 1).otherwise(0)
    c, s, q = F.coalesce("c", F.lit(0)) - mine, F.coalesce("s", F.lit(0.0)) - mine * n, F.coalesce("q", F.lit(0.0)) - mine * n * n
    mean = s / c
    spread = F.when(c > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / c) / (c - 1)))).otherwise(0.0)
    z = F.when(c > 0, (n - mean) / F.greatest(spread, F.sqrt(F.greatest(mean, F.lit(1.0))))).otherwise(0.0)
    label = F.when(z < 0, "cold").when(z < 1, "warm").otherwise("hot")
    if similarity is not None:
        joined = joined.join(similarity.select("cluster_id", "similarity"), "cluster_id", "left")
        label = F.when((z >= loud) & (F.col("similarity") > alike), "over_saturated").otherwise(label)
    return joined.select("cluster_id", F.round(z, 6).alias("z"), label.alias("temperature"))


def latest_coverage(coverage: DataFrame) -> DataFrame:
    """The newest coverage row of each cluster; ties go to the larger id."""
    newest = F.max_by(F.struct("coverage_id", "country_count", "language_count", "total_article_count", "fetched_at"), F.struct("fetched_at", "coverage_id"))
    return coverage.groupBy("cluster_id").agg(newest.alias("c")).select("cluster_id", "c.*")


def score_of(authority: Column, domain: Column, geo: Column, alone: Column, arxiv: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for name, (_, weight, _) in DOMAINS.items() for x in (name, weight)])
    return F.round(F.log1p(authority) * F.coalesce(weights[domain], F.lit(1.0)) * (1 + 0.5 * geo) * F.when(alone, 1.5).otherwise(1.0) * F.when(arxiv, 0.5).otherwise(1.0), 6)


def spread_of(countries: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(countries / 5, F.lit(0.0))))


def facts(items: DataFrame, sources: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(cluster_id, authority, arxiv_only, now, then, source_id, gap_hours, is_exclusive): all that a cluster's items say, in one pass over them.

    A first aggregate goes to (cluster, source), a second one to the cluster; the window between them uses its exchange. An
    item's authority is its weighted one, else its source's; items of unknown sources count for time and movement alone.
    """
    edge, before = as_of - F.make_dt_interval(F.lit(0), F.lit(hours)), as_of - F.make_dt_interval(F.lit(0), F.lit(2 * hours))
    per = items.groupBy("cluster_id", "source_id").agg(
        F.min("published_at").alias("at"),
        F.sum("authority_weighted").alias("weighted"),
        F.count_if(F.col("authority_weighted").isNull()).alias("plain"),
        F.count_if(F.col("published_at") > edge).alias("now"),
        F.count_if((F.col("published_at") > before) & (F.col("published_at") <= edge)).alias("then"),
    )
    known = per.join(sources.select("source_id", "authority_score", "kind"), "source_id", "left")
    order = Window.partitionBy("cluster_id").orderBy("at", "source_id")
    placed = known.withColumns({"n": F.row_number().over(order), "next": F.lead("at").over(order)})
    own = F.when(F.col("kind").isNotNull(), F.coalesce("weighted", F.lit(0.0)) + F.col("plain") * F.col("authority_score"))
    lead = F.max(F.when(F.col("n") == 1, F.struct("source_id", F.col("authority_score").alias("authority"), hours_between(F.col("at"), F.col("next")).alias("gap"))))
    sums = placed.groupBy("cluster_id").agg(F.sum(own).alias("authority"), F.bool_and(F.col("kind") == "arxiv").alias("arxiv_only"), F.sum("now").alias("now"), F.sum("then").alias("then"), lead.alias("lead"))
    alone = F.coalesce((F.col("lead.authority") >= EXCLUSIVE_AUTHORITY) & (F.col("lead.gap") > EXCLUSIVE_HOURS), F.lit(False))
    return sums.select("cluster_id", F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("arxiv_only", F.lit(False)).alias("arxiv_only"), "now", "then", F.col("lead.source_id").alias("source_id"), F.round("lead.gap", 6).alias("gap_hours"), alone.alias("is_exclusive"))


def heuristic(facts: DataFrame, clusters: DataFrame, coverage: DataFrame) -> DataFrame:
    """(cluster_id, authority, geo, arxiv_only, score) of every cluster, from its facts."""
    joined = clusters.select("cluster_id", "primary_domain").join(facts.select("cluster_id", "authority", "arxiv_only", "is_exclusive"), "cluster_id", "left").join(latest_coverage(coverage).select("cluster_id", "country_count"), "cluster_id", "left")
    geo, authority = spread_of(F.col("country_count")), F.coalesce("authority", F.lit(0.0))
    arxiv, alone = F.coalesce("arxiv_only", F.lit(False)), F.coalesce("is_exclusive", F.lit(False))
    return joined.select("cluster_id", authority.alias("authority"), geo.alias("geo"), arxiv.alias("arxiv_only"), score_of(authority, F.col("primary_domain"), geo, alone, arxiv).alias("score"))


def pool(clusters: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return clusters.filter((F.col("status") == "active") & (F.col("last_seen_at") > as_of - F.make_dt_interval(F.lit(days))))


def top(scored: DataFrame, n: int = 200) -> DataFrame:
    return scored.orderBy(F.desc("score"), "cluster_id").limit(n)
