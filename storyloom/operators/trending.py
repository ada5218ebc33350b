"""The trending board: terms of the live pool, weighted by heat and movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import normalised_headline
from storyloom.operators.greedy import first_wins
from storyloom.operators.running import before, ranged
from storyloom.schemas import HEAT_RANK, HEAT_WEIGHT, TRAJECTORY_WEIGHT
from storyloom.sources.shared import written

#: Days of a block; a row's days in a block are the bits of a long.
BLOCK = 32


def lookup(values: dict, key: str, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(key)], F.lit(default))


def one_per_story(pool: DataFrame, by: str | None = None) -> DataFrame:
    """Newest first, without rows that share a cluster or a normalised headline with an earlier one; an empty headline never collides. With ``by``, for each of its values apart."""
    headline = normalised_headline(F.col("headline"))
    ranked = pool.withColumns({"h": F.when(headline != "", headline), "o": order_of(by)})
    return _first_stories(ranked, by)


def order_of(by: str | None = None) -> Column:
    """Newest first; unique, also over the values of ``by``."""
    return F.struct((-F.unix_micros("created_at")).alias("late"), F.col("candidate_id").alias("id"), *([] if by is None else [by]))


def _first_stories(ranked: DataFrame, by: str | None) -> DataFrame:
    """The loop over (o, cluster_id, h, ...); ``h`` comes back as its key."""
    apart = [] if by is None else [by]
    own = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", *apart, F.col(c).cast("string")))
    return first_wins(ranked.withColumns({"c": own("cluster_id"), "h": own("h")}), "o", ["c", "h"]).drop("c")


def without_arxiv(pool: DataFrame, items: DataFrame, sources: DataFrame, domain: str | None = None) -> DataFrame:
    """The pool, of one domain if given, less clusters that have items and all of them from arXiv; a cluster without items stays."""
    pool = pool if domain is None else pool.filter(F.col("primary_domain") == domain)
    only = items.join(sources.select("source_id", "kind"), "source_id").groupBy("cluster_id").agg(F.bool_and(F.col("kind") == "arxiv").alias("only")).filter("only")
    return pool.join(only.select("cluster_id"), "cluster_id", "left_anti")


def board(stories: DataFrame, term: str, least: int, rows: int = 15, by: str | None = None) -> DataFrame:
    """([by,] rank, term, clusters, score, mean_heat, domains, headline) over the distinct trimmed terms of an array column; with ``by``, a board for each of its values."""
    key = [] if by is None else [by]
    weight = lookup(HEAT_WEIGHT, "temperature", 1.0) * lookup(TRAJECTORY_WEIGHT, "trajectory", 1.0)
    terms = stories.select(*key, "candidate_id", "o", "primary_domain", "headline", weight.alias("weight"), lookup(HEAT_RANK, "temperature", 1).alias("heat"), F.explode(F.array_distinct(F.transform(term, lambda x: F.trim(x)))).alias("term")).filter("term <> ''")
    by_domain = terms.groupBy(*key, "term", "primary_domain").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum("heat").alias("heat"), F.min(F.struct((-F.col("weight")).alias("w"), "o", "headline")).alias("best"))
    whole = by_domain.groupBy(*key, "term").agg(F.sum("n").alias("clusters"), F.round(F.sum("w"), 2).alias("score"), (F.sum("heat") / F.sum("n")).alias("mean_heat"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "primary_domain"))), lambda d: d["primary_domain"]), ",").alias("domains"), F.min("best")["headline"].alias("headline"))
    best = whole.filter(F.col("clusters") >= least)
    first = [F.desc("score"), F.desc("clusters"), F.col("term")]
    best = best if key else best.orderBy(*first).limit(rows)  # a few rows, then ranked
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*(key or [F.lit(1)])).orderBy(*first))).filter(F.col("rank") <= rows)
    return ranked.select(*key, "rank", "term", "clusters", "score", F.round("mean_heat", 6).alias("mean_heat"), "domains", "headline")


def pooled(candidates: DataFrame, since: str | None = None) -> DataFrame:
    """candidates(created_at, expires_at, decided_at, ...) with first_day and last_day, the days at whose end they were new and unexpired; those that have any, from ``since`` (yyyy-MM-dd) on."""
    until = F.least("expires_at", "decided_at") - F.expr("INTERVAL 1 MICROSECOND")  # least() passes over nulls
    first = F.to_date("created_at") if since is None else F.greatest(F.to_date("created_at"), F.to_date(F.lit(since)))
    return candidates.withColumns({"first_day": first, "last_day": F.date_sub(F.to_date(until), 1)}).filter("first_day <= last_day")


def daily_pools(candidates: DataFrame, name: str = "run_id", since: str | None = None) -> DataFrame:
    """candidates(created_at, expires_at, decided_at, ...) once for each day (``name``, yyyy-MM-dd) at whose end they were new and unexpired, from ``since`` on.

    A row that lives for d days is in at most d pools, so this grows with the rows, not with rows times runs. ``decided_at`` is null for
    what is still new; a row that was decided or expired before its first day's end is in no pool.
    """
    days = pooled(candidates, since)
    return days.withColumn(name, F.explode(F.transform(F.sequence("first_day", "last_day"), lambda d: F.date_format(d, "yyyy-MM-dd")))).drop("first_day", "last_day")


def _lone(days: DataFrame) -> DataFrame:
    """(cluster_id, lone): clusters no two of whose rows share a block of days, their numbers taken modulo 64. One that is not lone may still be so by days."""
    touched = F.expr(f"aggregate(sequence(floor(unix_date(first_day) / {BLOCK}), floor(unix_date(last_day) / {BLOCK})), 0L, (a, b) -> a | shiftleft(1L, CAST(pmod(b, 64) AS INT)))")
    return days.select("cluster_id", touched.alias("t")).groupBy("cluster_id").agg((F.sum(F.bit_count("t")) == F.bit_count(F.bit_or("t"))).alias("lone"))


def daily_stories(days: DataFrame, name: str = "run_id", only: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(name, candidate_id, o): what ``one_per_story`` leaves of the ``daily_pools`` of rows of ``pooled``, for the days of ``only`` (name) if given, without making the pools.

    A row that shares its cluster with no other row of a pool can lose by its headline alone. So later rows with its headline never
    win in that pool: it wins, or what it loses to beats them too. Which days a row is left with is known from the days of earlier such rows with its
    headline, bits of a block of days. Of the few rows that are left, those in doubt go through the loop.
    """
    headline = normalised_headline(F.col("headline"))
    narrow = days.select("candidate_id", "cluster_id", F.when(headline != "", headline).alias("h"), (-F.unix_micros("created_at")).alias("late"), F.unix_date("first_day").alias("a"), F.unix_date("last_day").alias("z"))
    spans = written(narrow.join(_lone(days), "cluster_id", "left").withColumn("lone", F.coalesce("lone", F.lit(True))), "pool")
    blocks = spans.withColumn("block", F.explode(F.expr(f"sequence(floor(a / {BLOCK}), floor(z / {BLOCK}))")))
    low, high = f"greatest(a - block * {BLOCK}, 0)", f"least(z - block * {BLOCK}, {BLOCK - 1})"
    bits = blocks.withColumn("bits", F.expr(f"shiftleft(shiftleft(1L, CAST({high} - {low} + 1 AS INT)) - 1, CAST({low} AS INT))")).drop("a", "z")
    key = ["h", "block"]
    order = ["late", "candidate_id"]
    named = before(ranged(bits.filter("h IS NOT NULL"), [*key, *order], parts), key, order, F.when(F.col("lone"), F.col("bits")).otherwise(0), "beaten", F.bit_or, lambda a, b: a.bitwiseOR(b))
    left = named.withColumn("bits", F.expr("bits & ~beaten")).filter("bits <> 0").select(bits.columns).unionByName(bits.filter("h IS NULL"))
    day = F.explode(F.expr(f"filter(sequence(0, {BLOCK - 1}), i -> getbit(bits, i) = 1)"))
    dated = left.withColumn("i", day).select("candidate_id", "cluster_id", "h", "lone", F.date_format(F.date_from_unix_date((F.col("block") * BLOCK + F.col("i")).cast("int")), "yyyy-MM-dd").alias(name), "late")
    dated = dated.withColumn("o", F.struct("late", F.col("candidate_id").alias("id"), name)).drop("late")
    rest = written(dated if only is None else dated.join(only.select(name).distinct(), name, "left_semi"), "pool-rest")
    crowd, lone = rest.filter("NOT lone"), rest.filter("lone")
    doubt = crowd.select(name, "h").filter("h IS NOT NULL").distinct()
    looped = written(crowd.unionByName(lone.join(doubt, [name, "h"], "left_semi")), "pool-doubt")
    kept = [name, "candidate_id", "o"]
    return _first_stories(looped, name).select(kept).unionByName(lone.join(doubt, [name, "h"], "left_anti").select(kept))


def waves(stories: DataFrame, by: str = "run_id", themes: int = 6, words: int = 10) -> DataFrame:
    """(by, description): the board of each value's stories as text, themes a line each and then keywords; a value whose board is empty has no row."""

    def joined(rows: DataFrame, text: Column, between: str, name: str) -> DataFrame:
        return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), between).alias(name))

    line = F.concat_ws(" · ", "term", F.concat(F.col("clusters").cast("string"), F.lit(" clusters")), F.split_part("domains", F.lit(","), F.lit(1)))
    top = joined(board(stories, "tags", 1, themes, by), line, "\n", "themes")
    named = joined(board(stories, "keywords", 2, words, by), F.col("term"), " · ", "words")
    return top.join(named, by, "full_outer").select(by, F.concat_ws("\n\n", "themes", F.concat(F.lit("Keywords: "), "words")).alias("description"))
