"""Model spend: priced calls, daily totals, alerts and the budget gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.running import before, ranged
from storyloom.schemas import BUCKETS, DEAREST, PRICES
from storyloom.sources.shared import written

EPSILON = 1e-9


def bucket(stage: str = "stage") -> Column:
    return F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])[F.col(stage)]


def priced(calls: DataFrame) -> DataFrame:
    """(id, usd, bucket, valid): tokens times the model's rate to six places, unless ``given_usd`` says otherwise; negative tokens are quarantined."""
    cents = lambda i: F.coalesce(F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, round(p[i] * 100))])[F.col("model")], F.lit(round(PRICES[DEAREST][i] * 100)))
    units = F.col("input_tokens") * cents(0) + F.col("output_tokens") * cents(1)  # hundred-millionths of a dollar
    valid = (F.col("input_tokens") >= 0) & (F.col("output_tokens") >= 0)
    return calls.select("id", F.when(valid, F.coalesce(F.col("given_usd") if "given_usd" in calls.columns else F.lit(None), (F.floor((units + 50) / 100) / 1_000_000)).cast("decimal(10,6)")).alias("usd"), bucket().alias("bucket"), valid.alias("valid"))


def daily(costs: DataFrame, ceiling: float, shares: dict[str, float], flat: dict[str, float] | None = None) -> DataFrame:
    """(day, bucket, usd, pct, alert, hit): a day's total (bucket 'all') and each bucket's, against its share of the ceiling or a flat ceiling of its own; a null bucket counts in the total only."""
    rows = costs.withColumn("day", F.to_date("occurred_at")).withColumn("bucket", bucket())
    sums = rows.groupingSets([["day"], ["day", "bucket"]], "day", "bucket").agg(F.sum("usd").alias("usd"), F.grouping("bucket").alias("whole")).filter("whole = 1 OR bucket IS NOT NULL")
    limit = F.when(F.col("whole") == 1, ceiling)
    for name, share in shares.items():
        limit = limit.when(F.col("bucket") == name, ceiling * share)
    for name, own in (flat or {}).items():
        limit = limit.when(F.col("bucket") == name, own)
    pct = F.col("usd").cast("double") / limit
    return sums.select("day", F.when(F.col("whole") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), F.col("usd").cast("double").alias("usd"), F.round(pct, 6).alias("pct"), (pct + EPSILON >= 0.8).alias("alert"), (pct + EPSILON >= 1.0).alias("hit"))


def alerts(costs: DataFrame, ceiling: float, fired: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(day, id, pct): the call at which a day's running spend first reaches 80 %, of days that haven't fired. A day's calls are dealt over tasks."""
    order = ["day", "occurred_at", "id"]
    rows = ranged(costs.select("id", "occurred_at", "usd", F.to_date("occurred_at").alias("day")), order, parts)
    running = before(rows, ["day"], order, F.col("usd"), "spent").withColumn("spent", F.col("spent") + F.coalesce("usd", F.lit(0)))
    first = running.filter(F.col("spent").cast("double") / ceiling + EPSILON >= 0.8).groupBy("day").agg(F.min(F.struct("occurred_at", "id", "spent")).alias("f"))
    out = first.select("day", F.col("f.id").alias("id"), F.round(F.least(F.lit(9.9999), F.col("f.spent").cast("double") / ceiling), 4).alias("pct"))
    return out if fired is None else out.join(fired, "day", "left_anti")


def gate(calls: DataFrame, ceiling: float, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """(id, admitted, scope): calls in order until one would reach its bucket's or the day's ceiling; that one halts the day. A day's calls are dealt over tasks."""
    order = ["day", "occurred_at", "id"]
    rows = ranged(calls.select("id", "occurred_at", "usd", F.to_date("occurred_at").alias("day"), bucket().alias("bucket")), order, parts)
    own = F.lit(None).cast("double")
    for name, share in shares.items():
        own = F.when(F.col("bucket") == name, ceiling * share).otherwise(own)
    spent = before(before(rows, ["day"], order, F.col("usd"), "of_day"), ["day", "bucket"], order, F.col("usd"), "of_bucket")
    reaches = lambda c, limit: F.col(c).cast("double") + F.col("usd").cast("double") + EPSILON >= limit
    scope = F.when(own.isNotNull() & reaches("of_bucket", own), "bucket").when(reaches("of_day", F.lit(ceiling)), "day")
    judged = written(spent.withColumn("scope", scope), "judged")
    stop = F.col("scope").isNotNull().cast("int")
    stops = before(judged, ["day"], order, stop, "earlier")
    return stops.select("id", (F.col("earlier") + stop == 0).alias("admitted"), F.when((F.col("earlier") == 0) & F.col("scope").isNotNull(), F.col("scope")).alias("scope"))
