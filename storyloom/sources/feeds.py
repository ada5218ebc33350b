"""Landed feed documents and playlist answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions.text import json_items, json_text

ITEM = "title string, link string, guid string, id string, isoDate string, pubDate string, content string, contentSnippet string, creator string, author string, category array<string>, enclosure struct<_url:string,_type:string>"
PLAYLIST = "items array<struct<contentDetails:struct<videoId:string,videoPublishedAt:string>,snippet:struct<channelId:string,title:string,publishedAt:string>>>"


def read_feeds(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(ITEM).load(path)


def entries_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of a text column that holds one feed entry in each row."""
    return lines.select(F.from_xml(column, ITEM).alias("e")).select("e.*")


def feeds_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries, with ``feed_title``, of a text column that holds one whole feed (a channel and its items) in each row."""
    feed = F.from_xml(column, F.lit(f"title string, item array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>>"))
    return lines.select(feed.alias("f")).select(F.col("f.title").alias("feed_title"), F.explode("f.item").alias("e")).select("feed_title", "e.*")


def items_of(entries: DataFrame, as_of: Column) -> DataFrame:
    """(external_id, title, url, content, author, published_at, raw_meta); entries without a link or a title go.

    The id is the guid, else the id, else the link; empty ones don't count. ``raw_meta`` has the feed's title (where entries have a
    ``feed_title``), the categories and the enclosure; what an entry hasn't is null.
    """
    rfc = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    date = F.coalesce(F.try_to_timestamp("isoDate"), F.try_to_timestamp("pubDate"), rfc, as_of)
    good = entries.filter((F.trim(F.coalesce("link", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    feed_title = F.col("feed_title") if "feed_title" in entries.columns else F.lit(None).cast("string")
    enclosure = F.when(F.col("enclosure").isNotNull(), F.struct(F.col("enclosure._url").alias("url"), F.col("enclosure._type").alias("type")))
    meta = F.struct(feed_title.alias("feedTitle"), F.col("category").alias("categories"), enclosure.alias("enclosure"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return good.select(F.coalesce(some("guid"), some("id"), "link").alias("external_id"), F.trim("title").alias("title"), F.col("link").alias("url"), F.coalesce("content", "contentSnippet").alias("content"), F.coalesce("creator", "author").alias("author"), date.alias("published_at"), meta.alias("raw_meta"))


def videos_of(entries: DataFrame) -> DataFrame:
    """entries(external_id, url, title, media, content, snippet, ...) that have an id, a link and a title that isn't blank, with their description.

    ``media`` is JSON: a text or an array of texts. The description is that text, or the array's first, if it isn't empty; else content, else snippet.
    """
    media = F.try_parse_json("media")
    said = F.coalesce(F.nullif(json_text(media), F.lit("")), F.nullif(json_text(F.get(json_items(media), F.lit(0))), F.lit("")))
    full = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    good = entries.withColumn("title", F.trim("title")).filter(full("external_id") & full("url") & full("title"))
    return good.withColumn("description", F.coalesce(said, "content", "snippet")).drop("media", "content", "snippet")


def new_videos(videos: DataFrame, known: DataFrame) -> DataFrame:
    """Videos whose (competitor_id, external_id) isn't known, the first of each key."""
    order = Window.partitionBy("competitor_id", "external_id").orderBy("event_id")
    fresh = videos.join(known.select("competitor_id", "external_id"), ["competitor_id", "external_id"], "left_anti")
    return fresh.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def playlist_items(pages: DataFrame, since: Column) -> DataFrame:
    """(video_id, channel_id, title, published_at) of JSON pages; without ids or a date they go, and so does what is older."""
    item = pages.select(F.explode(F.from_json("raw", PLAYLIST)["items"]).alias("i"))
    at = F.try_to_timestamp(F.coalesce("i.contentDetails.videoPublishedAt", "i.snippet.publishedAt"))
    rows = item.select(F.col("i.contentDetails.videoId").alias("video_id"), F.col("i.snippet.channelId").alias("channel_id"), F.col("i.snippet.title").alias("title"), at.alias("published_at"))
    return rows.filter(F.col("video_id").isNotNull() & F.col("channel_id").isNotNull() & (F.col("published_at") >= since))
