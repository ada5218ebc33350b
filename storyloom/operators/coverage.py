"""Coverage samples and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.running import last_known, ranged


def sample_summary(articles: DataFrame, outlets: int = 20) -> DataFrame:
    """(query_id, samples, countries, languages, outlets): exact distinct counts without blanks, outlets by count, then name."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    whole = articles.groupBy("query_id").agg(F.count("*").alias("samples"), F.countDistinct(filled("country")).alias("countries"), F.countDistinct(filled("language")).alias("languages"))
    per = articles.filter("outlet <> ''").groupBy("query_id", "outlet").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "outlet")
    top = per.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= outlets).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "outlet"))), lambda x: x["outlet"]), ",").alias("outlets"))
    return whole.join(top, "query_id", "left")


def timeline_summary(responses: DataFrame) -> DataFrame:
    """(query_id, total, first_seen) of JSON timelines, nested or flat; values of zero or less count nothing."""
    parsed = responses.select("query_id", F.explode_outer(F.from_json("raw", "timeline array<struct<date:string,value:double,series:string,data:array<struct<date:string,value:double>>>>")["timeline"]).alias("s"))
    points = parsed.select("query_id", F.explode_outer(F.when(F.col("s.data").isNotNull(), F.col("s.data")).otherwise(F.array(F.struct(F.col("s.date").alias("date"), F.col("s.value").alias("value"))))).alias("p"))
    at = F.coalesce(F.try_to_timestamp("p.date", F.lit("yyyyMMddHHmmss")), F.try_to_timestamp("p.date", F.lit("yyyyMMdd'T'HHmmss'Z'")))
    good = F.col("p.value") > 0
    return points.groupBy("query_id").agg(F.coalesce(F.sum(F.when(good, F.col("p.value"))), F.lit(0.0)).cast("long").alias("total"), F.min(F.when(good, at)).alias("first_seen"))


def lookups(requests: DataFrame, coverage: DataFrame, hours: float = 6, parts: int | None = None) -> DataFrame:
    """(request_id, coverage_id, fetched_at, hit) of requests(request_id, query_hash, requested_at): an as-of join with a time to live.

    A request sees the latest row of its query fetched until then (equal times: the largest coverage_id); it is a hit if
    that is at most ``hours`` old, else a miss without a row. Both sides become one order and the last row is carried forward; a query
    with most of the requests is dealt over tasks, each beginning with what the one before carried.
    """
    rows = requests.select("query_hash", F.col("requested_at").alias("at"), F.lit(1).alias("side"), F.col("request_id").alias("id"))
    rows = rows.unionByName(coverage.select("query_hash", F.col("fetched_at").alias("at"), F.lit(0).alias("side"), F.col("coverage_id").alias("id")))
    order = ["query_hash", "at", "side", "id"]
    seen = last_known(ranged(rows.filter("query_hash IS NOT NULL AND at IS NOT NULL"), order, parts), ["query_hash"], order, F.when(F.col("side") == 0, F.struct("at", "id")), "last").filter("side = 1")
    hit = F.coalesce(F.col("last.at") >= F.col("at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600)), F.lit(False))
    return seen.select(F.col("id").alias("request_id"), F.when(hit, F.col("last.id")).alias("coverage_id"), F.when(hit, F.col("last.at")).alias("fetched_at"), hit.alias("hit"))
