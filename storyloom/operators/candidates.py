"""The candidate pool: selections, decisions and the supersede-aware upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import half_life
from storyloom.schemas import DOMAINS


def live(as_of: Column) -> Column:
    return (F.col("status") == "new") & (F.col("expires_at") > as_of)


def active(candidates: DataFrame, as_of: Column, status: str = "new", domain: str | None = None, temperature: str | None = None, trajectory: str | None = None, limit: int = 30) -> DataFrame:
    """The best of the pool; expiry counts for status new only."""
    rows = candidates.filter(live(as_of) if status == "new" else F.col("status") == status)
    for name, value in (("primary_domain", domain), ("temperature", temperature), ("trajectory", trajectory)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc("curation_score"), F.desc("created_at"), "candidate_id").limit(min(limit, 100))


def newest_new(candidates: DataFrame) -> DataFrame:
    """(candidate_id, status): of a cluster's new rows only the newest stays new."""
    order = Window.partitionBy("cluster_id", "status").orderBy(F.desc("created_at"), F.desc("candidate_id"))
    return candidates.withColumn("n", F.row_number().over(order)).select("candidate_id", F.when((F.col("status") == "new") & (F.col("n") > 1), "expired").otherwise(F.col("status")).alias("status"))


def retire_decided(candidates: DataFrame, as_of: Column) -> DataFrame:
    """(candidate_id, status): new rows of clusters with an unexpired decision expire."""
    decided = candidates.filter(F.col("status").isin("picked", "passed") & (F.col("expires_at") > as_of)).select("cluster_id").distinct().withColumn("decided", F.lit(True))
    return candidates.join(decided, "cluster_id", "left").select("candidate_id", F.when((F.col("status") == "new") & F.col("decided"), "expired").otherwise(F.col("status")).alias("status"))


def upsert(curated: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """(cluster_id, outcome, candidate_id, expires_at) for curated(cluster_id, primary_domain), against all rows of each cluster."""
    open_row = F.col("expires_at") > as_of
    newest = F.struct("created_at", "candidate_id")
    per = candidates.groupBy("cluster_id").agg(
        F.bool_or(F.col("status").isin("picked", "passed") & open_row).alias("decided"),
        F.max(F.when(F.col("status") == "new", newest)).alias("new_row"),
        F.max(F.when((F.col("status") == "deferred") & open_row, newest)).alias("deferred_row"),
    )
    outcome = F.when(F.col("decided"), "skipped_decided").when(F.coalesce("new_row", "deferred_row").isNotNull(), "superseded").otherwise("inserted")
    target = F.when(outcome == "superseded", F.coalesce("new_row", "deferred_row")["candidate_id"])
    expiry = as_of + F.make_dt_interval(F.lit(0), half_life(F.col("primary_domain")).cast("int"))
    return curated.join(per, "cluster_id", "left").select("cluster_id", outcome.alias("outcome"), target.alias("candidate_id"), F.when(outcome != "skipped_decided", expiry).alias("expires_at"))


def decide(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(feedback_id, candidate_id, result, status): the first decision on a new candidate wins."""
    order = Window.partitionBy("candidate_id").orderBy("created_at", "feedback_id")
    ranked = decisions.withColumn("n", F.row_number().over(order)).join(candidates.select("candidate_id", "status"), "candidate_id")
    wins = (F.col("n") == 1) & (F.col("status") == "new")
    status = F.when(F.col("action") == "pick", "picked").when(F.col("action") == "pass", "passed").otherwise("deferred")
    return ranked.select("feedback_id", "candidate_id", F.when(wins, "applied").otherwise("already_decided").alias("result"), F.when(wins, status).otherwise(F.col("status")).alias("status"))


def feeds(candidates: DataFrame, as_of: Column, rows: int = 50) -> DataFrame:
    """(feed, rank, candidate_id, categories): the master feed and one for each domain; a feed without rows is one row of nulls."""
    pool = candidates.filter(live(as_of))
    every = pool.withColumn("feed", F.lit("master")).unionByName(pool.withColumn("feed", F.col("primary_domain")))
    order = Window.partitionBy("feed").orderBy(F.desc("curation_score"), F.desc("created_at"), "candidate_id")
    found = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).select("feed", "rank", "candidate_id", F.array_join(F.array_distinct(F.concat("keywords", "tags")), ",").alias("categories"))
    names = candidates.sparkSession.createDataFrame([(n,) for n in ("master", *DOMAINS)], "feed string")
    return found.join(names, "feed", "full_outer")


def pulse(fresh: DataFrame, rows: int = 5) -> DataFrame:
    """(run_id, kind, rank, candidate_id, title, description) of fresh(run_id, run_kind, ...); quiet runs but morning ones give nothing."""
    mover = F.col("is_exclusive") | ((F.col("temperature") == "hot") & F.col("trajectory").isin("rising", "new"))
    order = [F.desc("curation_score"), F.col("candidate_id")]
    meta = F.concat_ws(" · ", "primary_domain", F.concat(F.lit("score "), F.floor(F.col("curation_score") + 0.5).cast("string")), "trajectory", F.when(F.col("is_exclusive"), "exclusive"))
    why = F.trim("rationale")
    text = F.when(why != "", F.concat(F.lit("↳ "), why, F.lit("\n"), meta)).otherwise(meta)
    # the best of each run and kind before what a run is as a whole: a run's rows never come together
    best = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "run_kind").orderBy(*order))).filter(F.col("rank") <= rows)
    loud = fresh.groupBy(F.col("run_id").alias("of")).agg(F.max(mover).alias("loud"))
    shown = best.join(loud, F.col("run_id").eqNullSafe(F.col("of"))).filter((F.col("run_kind") == "morning") | F.col("loud"))
    return shown.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).filter(F.col("rank") <= rows).select("run_id", F.lit("candidate").alias("kind"), "rank", "candidate_id", F.col("headline").alias("title"), text.alias("description"))


def pulse_entries(fresh: DataFrame, waves: DataFrame) -> DataFrame:
    """``pulse`` with one more row for each morning run that has waves(run_id, description): kind ``waves``, without rank or candidate."""
    mornings = fresh.filter(F.col("run_kind") == "morning").select("run_id").distinct()
    title = F.concat(F.lit("Waves — "), "run_id")
    rows = waves.join(mornings, "run_id", "left_semi").select("run_id", F.lit("waves").alias("kind"), title.alias("title"), "description")
    return pulse(fresh).unionByName(rows, allowMissingColumns=True)


def oldest_needed(fresh: DataFrame, rows: int) -> str | None:
    """The oldest run that can be among the newest ``rows`` entries: candidates of newer runs alone are as many; null if there are too few."""
    last = pulse(fresh).select("run_id").orderBy(F.desc("run_id")).limit(rows).agg(F.count("*").alias("n"), F.min("run_id").alias("run_id")).first()
    return last["run_id"] if last["n"] == rows else None


def newest_entries(entries: DataFrame, rows: int = 50) -> DataFrame:
    """The pulse feed: entries of the newest runs, candidates by rank and then waves, with a link to the candidate or to the site."""
    newest = entries.orderBy(F.desc("run_id"), F.asc_nulls_last("rank")).limit(rows)
    page = F.concat(F.lit("https://feeds.example/c/"), F.col("candidate_id").cast("string"))
    return newest.select("run_id", "kind", "rank", "candidate_id", F.coalesce(page, F.lit("https://feeds.example/")).alias("link"))
