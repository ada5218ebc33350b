"""Landed items: hash deduplication, host lists, work states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import with_json_field
from storyloom.functions.urls import host, suffixes
from storyloom.schemas import AGGREGATOR_FEEDS, TRUSTED_HOSTS


def twins_folded(new: DataFrame) -> DataFrame:
    """Of equal (URL, title) pairs of a source the row with the smallest ``raw_id``."""
    order = Window.partitionBy("source_id", "url_hash", "title_hash").orderBy("raw_id")
    return new.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def hash_dedup(new: DataFrame, known: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Rows of new(raw_id, source_id, external_id, url_hash, title_hash) to insert.

    A URL known at any age drops a row; a title only if its known row was published within ``days``. In a
    batch equal (URL, title) pairs of a source fold to the first; then (source, external id) is unique.
    """
    recent = known.filter(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days)))
    fresh = twins_folded(new).join(known.select("url_hash"), "url_hash", "left_anti").join(recent.select("title_hash"), "title_hash", "left_anti").join(known.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti")
    return fresh.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "external_id").orderBy("raw_id"))).filter("n = 1").drop("n")


def trusted_items(items: DataFrame, feed: str = "feed_url", url: str = "url", hosts: Sequence[str] = tuple(TRUSTED_HOSTS)) -> DataFrame:
    """Items of aggregator feeds stay if their host or a parent domain is listed; other feeds pass."""
    listed = F.exists(suffixes(host(F.col(url))), lambda h: h.isin(list(hosts)))
    return items.filter(~F.col(feed).rlike(AGGREGATOR_FEEDS) | F.coalesce(listed, F.lit(False)))


def pending(raw: DataFrame, attempts: int = 3, rows: int = 20) -> DataFrame:
    return raw.filter(~F.col("processed") & (F.col("attempts") < attempts)).orderBy("fetched_at", "raw_id").limit(rows)


def state(processed: Column, attempts: Column, has_item: Column, most: int = 3) -> Column:
    return F.when(processed & has_item, "normal").when(processed, "dedup_hit").when(attempts >= most, "poisoned").otherwise("pending")


def outcomes(raw: DataFrame, items: DataFrame, duplicates: DataFrame, errors: DataFrame, meta: str | None = None) -> DataFrame:
    """(raw_id, outcome, attempts, error): a row with an item is skipped, one with a model error gets an attempt more. ``meta`` names a JSON column, into which the error is merged."""
    joined = raw.join(items.select("raw_id", F.lit(True).alias("done")), "raw_id", "left").join(errors.select("raw_id", "error"), "raw_id", "left").join(duplicates.select("raw_id", F.lit(True).alias("twin")), "raw_id", "left")
    outcome = F.when(F.col("done"), "skip").when(F.col("error").isNotNull(), "failed").when(F.col("twin"), "dedup_hit").otherwise("normal")
    error = F.when(outcome == "failed", F.substring("error", 1, 240))
    merged = [] if meta is None else [F.when(outcome == "failed", with_json_field(F.col(meta), "last_processing_error", error)).otherwise(F.col(meta)).alias(meta)]
    return joined.select("raw_id", outcome.alias("outcome"), (F.col("attempts") + (outcome == "failed").cast("int")).alias("attempts"), error.alias("error"), *merged)


def ticks(outcomes: DataFrame, tick: str = "tick") -> DataFrame:
    """Totals of each tick: a row that is skipped has its item, so it counts as normal."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy(tick).agg(F.count("*").alias("pulled"), n("normal", "skip").alias("normal"), n("dedup_hit").alias("dedup"), n("failed").alias("failures"))


def settled(log: DataFrame) -> DataFrame:
    """(raw_id, attempts, outcome, error) of a log of attempts(raw_id, attempt, outcome, error), in which any row may stand several times.

    An attempt counts once, by its number. The first attempt that didn't fail settles a row; later ones say nothing, as the row is skipped. The
    error is the last one before that. A row that only failed has a null outcome.
    """
    once = log.groupBy("raw_id", "attempt").agg(F.min(F.struct((F.col("outcome") == "failed").alias("bad"), "outcome", "error")).alias("a")).select("raw_id", "attempt", "a.*")
    done = F.min(F.when(~F.col("bad"), F.struct("attempt", "outcome")))
    rows = once.groupBy("raw_id").agg(done.alias("done"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.struct("attempt", "error")))).alias("failed"))  # a few attempts each
    counted = F.filter("failed", lambda f: F.col("done").isNull() | (f["attempt"] < F.col("done.attempt")))
    return rows.withColumn("failed", counted).select("raw_id", F.size("failed").alias("attempts"), "done.outcome", F.try_element_at("failed", F.lit(-1))["error"].alias("error"))
