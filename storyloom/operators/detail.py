"""Clusters and candidates with their sources and archive links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import json_number, json_text
from storyloom.operators.running import before, ranged
from storyloom.operators.signals import EXCLUSIVE_AUTHORITY, EXCLUSIVE_HOURS, hours_between

ORDER = ["cluster_id", "published_at", "source_id", "order_id", "line", "part_id"]


def _sourced(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, n_rows, n_sources, first_at, every) of the known sources, but every is (at, source_id, name, authority, known) of all, in the order of their first items."""
    firsts = items.groupBy("cluster_id", "source_id").agg(F.min("published_at").alias("at"), F.count("*").alias("n"))
    joined = firsts.join(sources.select("source_id", "name", F.col("authority_score").alias("authority"), F.lit(True).alias("known")), "source_id", "left").withColumn("known", F.col("known").isNotNull())
    of_known = lambda c: F.when(F.col("known"), F.col(c))
    every = F.array_sort(F.collect_list(F.struct("at", "source_id", "name", "authority", "known")))
    return joined.groupBy("cluster_id").agg(F.sum(of_known("n")).alias("n_rows"), F.count_if("known").alias("n_sources"), F.min(of_known("at")).alias("first_at"), every.alias("every"))


def _known(every: str) -> Column:
    return F.transform(F.filter(every, lambda x: x["known"]), lambda x: F.struct(*(x[n].alias(n) for n in ("at", "source_id", "name", "authority"))))


def source_list(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, n_rows, n_sources, first_at, listed): each source once, in the order of its first item; listed are (at, source_id, name, authority)."""
    return _sourced(items, sources).filter("n_sources > 0").select("cluster_id", "n_rows", "n_sources", "first_at", _known("every").alias("listed"))


def source_rows(items: DataFrame, sources: DataFrame, parts: int | None = None) -> DataFrame:
    """(cluster_id, position, source_id, name, title, url, published_at): a cluster's items, oldest first. A cluster's rows are dealt over tasks, however many there are."""
    rows = ranged(items.select(*ORDER, "title", "url"), ORDER, parts)
    placed = before(rows, ["cluster_id"], ORDER, F.lit(1), "earlier")
    return placed.join(sources.select("source_id", "name"), "source_id").select("cluster_id", (F.col("earlier") + 1).alias("position"), "source_id", "name", "title", "url", "published_at")


def archive_links(raw: Column) -> Column:
    """The links of an archive payload: entries with a text title, a text URL and a number; an empty array for a null or malformed payload."""
    # fields as variants in one step; an entry that is no object is null
    links = F.try_variant_get(F.try_parse_json(raw), "$.links", "array<struct<title:variant,url:variant,similarity:variant>>")
    typed = F.transform(links, lambda x: F.struct(json_text(x["title"]).alias("title"), json_text(x["url"]).alias("url"), json_number(x["similarity"]).alias("similarity")))
    whole = F.filter(typed, lambda x: x["title"].isNotNull() & x["url"].isNotNull() & x["similarity"].isNotNull())
    return F.coalesce(whole, F.array().cast("array<struct<title:string,url:string,similarity:double>>"))


def details(candidates: DataFrame, items: DataFrame, sources: DataFrame, payload: str = "archive_payload") -> DataFrame:
    """A candidate with its cluster's source list, its archive links, and of an exclusive one the earliest row of the exclusive source.

    A candidate whose cluster has no items has no sources. The cluster's rows themselves are ``source_rows``: they are the same for all its candidates.
    """
    # the cluster's earliest row is the first source's, and no other source can be the exclusive one
    row = F.min(F.struct("published_at", "source_id", "order_id", "line", "part_id", "title", "url")).alias("row")
    earliest = items.filter("published_at IS NOT NULL").groupBy("cluster_id").agg(row)
    lead, follower = F.get("every", F.lit(0)), F.get("every", F.lit(1))
    alone = lead["known"] & (lead["authority"] >= EXCLUSIVE_AUTHORITY) & (hours_between(lead["at"], follower["at"]) > EXCLUSIVE_HOURS)
    first = F.when(alone, F.struct("row.source_id", lead["name"].alias("name"), "row.title", "row.url", "row.published_at"))
    some = F.col("n_sources") > 0
    clusters = _sourced(items, sources).join(earliest, "cluster_id", "left").select("cluster_id", "n_rows", F.when(some, F.col("n_sources")).alias("n_sources"), "first_at", F.when(some, _known("every")).alias("listed"), first.alias("exclusive"))
    found = candidates.select("candidate_id", "cluster_id", payload).join(clusters, "cluster_id", "left")
    # payloads are parsed behind the joins, in as many tasks as those
    return found.select("candidate_id", "cluster_id", archive_links(F.col(payload)).alias("archive_links"), "n_rows", "n_sources", "first_at", "listed", "exclusive")
