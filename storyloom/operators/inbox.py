"""Newsletter senders and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import snippet
from storyloom.functions.urls import suffixes
from storyloom.schemas import TRANSPORT_DOMAINS


def domain_of(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.regexp_extract(address, "@(.*)$", 1)))


def deduplicated_map(sender_map: DataFrame) -> DataFrame:
    """(row_id, match_field, match_value, slug): of equal fields and lower-case values the oldest row, then the lowest id."""
    order = Window.partitionBy("match_field", F.lower("match_value")).orderBy("created_at", "row_id")
    return sender_map.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row_id", "match_field", F.lower("match_value").alias("match_value"), "slug")


def resolved(senders: DataFrame, sender_map: DataFrame) -> DataFrame:
    """(sender_id, slug): by list id, then address, then the address's domain, case-folded; null if none is mapped."""
    out = senders.withColumns({"v0": F.lower("list_id"), "v1": F.lower("from_addr"), "v2": domain_of(F.col("from_addr"))})
    one = deduplicated_map(sender_map)
    for i, name in enumerate(("list_id", "from_addr", "from_domain")):
        out = out.join(one.filter(F.col("match_field") == name).select(F.col("match_value").alias(f"v{i}"), F.col("slug").alias(f"s{i}")), f"v{i}", "left")
    return out.select("sender_id", F.coalesce("s0", "s1", "s2").alias("slug"))


def seeded(senders: DataFrame, seeds: DataFrame) -> DataFrame:
    """(sender_id, slug, authority) of senders whose domain is a seed's hint or below it, but not a mail service's; the first seed wins."""
    own = domain_of(F.col("from_addr"))
    rows = senders.withColumn("d", own).filter(F.col("d").isNotNull() & ~F.exists(suffixes(F.col("d")), lambda x: x.isin(TRANSPORT_DOMAINS)))
    tried = rows.select("sender_id", F.explode(suffixes(F.col("d"))).alias("hint"))
    # a hint's seeds are many, its first one is all that can win
    first = seeds.groupBy(F.lower("hint").alias("hint")).agg(F.min(F.struct("seed_order", "seed_slug", "authority")).alias("s"))
    return tried.join(first, "hint").groupBy("sender_id").agg(F.min("s").alias("s")).select("sender_id", F.col("s.seed_slug").alias("slug"), F.col("s.authority").alias("authority"))


def unmatched(senders: DataFrame, sender_map: DataFrame) -> DataFrame:
    """(list_id, from_addr, from_domain, subject, headers, match_field, match_value) of distinct senders that have a header and aren't mapped."""
    per = senders.groupBy("list_id", "from_addr").agg(F.min("subject").alias("subject"), F.min("headers").alias("headers"))
    keyed = per.select("list_id", "from_addr", domain_of(F.col("from_addr")).alias("from_domain"), "subject", "headers", F.when(F.col("list_id").isNotNull(), "list_id").when(F.col("from_addr").isNotNull(), "from_addr").alias("match_field"), F.lower(F.coalesce("list_id", "from_addr")).alias("match_value")).filter("match_value IS NOT NULL")
    return keyed.join(sender_map.select("match_field", F.lower("match_value").alias("match_value")).distinct(), ["match_field", "match_value"], "left_anti")


def chosen_links(messages: DataFrame, links: DataFrame, rows: int = 50) -> DataFrame:
    """(message_id, link, title, text): of each message the first article link, else the first of any kind, else a made one; the newest messages of a slug."""
    best = links.groupBy("message_id").agg(F.min(F.struct((F.col("kind") != "article").alias("other"), "pos", "link"))["link"].alias("link"))
    order = Window.partitionBy("slug").orderBy(F.desc("received_at"), "message_id")
    newest = messages.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)
    made = F.concat(F.lit("https://inbox.example/items/"), "slug", F.lit("/"), F.col("message_id").cast("string"))
    return newest.join(best, "message_id", "left").select("message_id", F.coalesce("link", made).alias("link"), F.coalesce("subject", F.lit("(no subject)")).alias("title"), snippet(F.col("body")).alias("text"))
