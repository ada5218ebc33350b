"""Weekly briefs: upsert by week, context pool, validated pitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import json_items, json_text, without_trailing_commas
from storyloom.operators.detail import archive_links
from storyloom.sources.shared import written

TEXTS = ["hook", "thesis", "steelman", "break", "why_now", "fit"]


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(week_of, brief_id, text): a week that is written again keeps its first id."""
    joined = old.select("week_of", F.col("brief_id").alias("old_id"), F.col("text").alias("old_text")).join(new.select("week_of", F.col("brief_id").alias("new_id"), F.col("text").alias("new_text")), "week_of", "full_outer")
    return joined.select("week_of", F.coalesce("old_id", "new_id").alias("brief_id"), F.coalesce("new_text", "old_text").alias("text"))


def latest(briefs: DataFrame, rows: int = 12) -> DataFrame:
    """The feed: the newest weeks with their rank."""
    best = briefs.orderBy(F.desc("week_of")).limit(rows)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("week_of"))))  # a few rows


def by_week(briefs: DataFrame, week_of: str | None = None) -> DataFrame:
    """The brief of a week, or the newest one."""
    return briefs.filter(F.col("week_of") == week_of) if week_of else briefs.orderBy(F.desc("week_of")).limit(1)


def context(candidates: DataFrame, items: DataFrame, start: Column, end: Column, rows: int = 80, sources: int = 5, payload: str = "archive_payload") -> DataFrame:
    """(candidate_id, rank, status, headline, sources, archive_links): what was made or updated in the week, of any status, best first, each with its newest (title, url) and its archive links."""
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    best = [F.desc("curation_score"), F.desc("created_at"), F.col("candidate_id")]
    pool = candidates.filter(inside("created_at") | inside("updated_at")).orderBy(*best).limit(rows)
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*best)))  # at most ``rows`` rows
    order = Window.partitionBy("candidate_id").orderBy(F.desc("published_at"), "source_id", "part_id", "order_id", "line")
    newest = items.join(F.broadcast(ranked.select("candidate_id", "cluster_id")), "cluster_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sources)
    listed = newest.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title", "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("sources"))
    return ranked.join(listed, "candidate_id", "left").select("candidate_id", "rank", "status", "headline", "sources", archive_links(F.col(payload)).alias("archive_links"))


def decisions(feedback: DataFrame, candidates: DataFrame, start: Column, end: Column) -> DataFrame:
    """(feedback_id, action, reason, headline, created_at): the week's decisions, newest first."""
    week = feedback.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    return week.join(candidates.select("candidate_id", "headline"), "candidate_id").select("feedback_id", "action", "reason", "headline", "created_at").orderBy(F.desc("created_at"), "feedback_id")


def _pitches(raw: Column) -> Column:
    """The pitches of a response as structs; what isn't of the right JSON type, and a blank text, is null. Null if there is no array of pitches."""
    v = F.coalesce(F.try_parse_json(raw), F.try_parse_json(without_trailing_commas(raw)))

    def pitch(p: Column) -> Column:
        full = lambda name: F.nullif(F.btrim(json_text(p, f"$.{name}"), F.lit(" \t\r\n")), F.lit(""))
        evidence = F.transform(json_items(p, "$.evidence"), lambda e: F.struct(json_text(e, "$.title").alias("title"), json_text(e, "$.url").alias("url")))
        return F.struct(*(full(n).alias(n) for n in (*TEXTS, "collision")), evidence.alias("evidence"), F.transform(json_items(p, "$.candidate_ids"), lambda i: json_text(i)).alias("candidate_ids"))

    return F.transform(json_items(v, "$.pitches"), pitch)


def valid_pitches(responses: DataFrame, known_urls: DataFrame, known_ids: DataFrame) -> DataFrame:
    """(response_id, valid, pitches, known_ids, cleaned) of responses(response_id, raw).

    ``known_urls(response_id, url)`` and ``known_ids(response_id, id)`` are what each response was asked about. A response is valid if it
    has one to six pitches and each has its six texts and evidence left: entries with a title and a known URL. ``cleaned``
    is its pitches as JSON, trimmed, with evidence and ids that are known, in their order, and a blank collision as null; it is null for
    an invalid response, as one bad pitch rejects all. Null, empty or malformed responses have no pitches.
    """
    # written, as the texts would be made and parsed again for each of the four uses
    rows = written(responses.select("response_id", _pitches(F.col("raw")).alias("p")), "pitches")
    pitches = rows.select("response_id", F.posexplode("p").alias("n", "pitch"))
    key = ["response_id", "n"]

    def known(name: str, value: str, table: DataFrame, kept: Column) -> DataFrame:
        """The entries of a list that the table knows, put together again in their order."""
        entries = pitches.select(*key, F.posexplode(f"pitch.{name}").alias("i", "e")).withColumn(value, F.col("e.url") if value == "url" else F.col("e"))
        found = entries.join(table.select("response_id", value).distinct(), ["response_id", value], "left_semi")
        return found.filter(kept).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias(name))

    evidence = known("evidence", "url", known_urls, F.col("e.title").isNotNull())
    ids = known("candidate_ids", "id", known_ids, F.lit(True))
    good = F.col("evidence").isNotNull()
    for name in TEXTS:
        good = good & F.col(f"pitch.{name}").isNotNull()
    clean = F.struct(*(F.col(f"pitch.{n}").alias(n) for n in (*TEXTS, "collision")), "evidence", F.coalesce("candidate_ids", F.array().cast("array<string>")).alias("candidate_ids"))
    judged = pitches.join(evidence, key, "left").join(ids, key, "left").select(*key, good.alias("good"), clean.alias("pitch"))
    whole = judged.groupBy("response_id").agg(F.bool_and("good").alias("good"), F.count("*").alias("pitches"), F.sum(F.size("pitch.candidate_ids")).alias("known_ids"), F.array_sort(F.collect_list(F.struct("n", "pitch"))).alias("l"))
    valid = F.coalesce(F.col("good") & F.col("pitches").between(1, 6), F.lit(False))
    text = F.to_json(F.transform("l", lambda x: x["pitch"]), {"ignoreNullFields": "false"})
    return rows.select("response_id").join(whole, "response_id", "left").select("response_id", valid.alias("valid"), F.coalesce("pitches", F.lit(0)).alias("pitches"), F.coalesce("known_ids", F.lit(0)).alias("known_ids"), F.when(valid, text).alias("cleaned"))
