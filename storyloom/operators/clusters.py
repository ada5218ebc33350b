"""Story clusters: nearest neighbours, merging, compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.greedy import first_wins
from storyloom.operators.vectors import cosine_pairs, sharing_pairs
from storyloom.schemas import DOMAINS
from storyloom.sources.shared import written


def duplicates(new: DataFrame, stored: DataFrame, as_of: Column, at_least: float = 0.93, days: int = 7) -> DataFrame:
    """(id, stored_id, similarity): each new row's nearest recent stored row of its domain, if it is near enough."""
    recent = stored.filter(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return cosine_pairs(new, recent, "primary_domain", at_least=at_least, k=1).select(F.col("l_id").alias("id"), F.col("r_id").alias("stored_id"), "similarity")


def observed(clusters: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Active clusters seen within the last ``days``, by the time of observation."""
    return clusters.filter((F.col("status") == "active") & (F.col("last_seen_at") > as_of - F.make_dt_interval(F.lit(days))))


def nearest(items: DataFrame, centroids: DataFrame, as_of: Column, below: float = 0.30, days: int = 7) -> DataFrame:
    """(id, cluster_id, distance, joins) by the nearest centroid of the domain that is active and lately observed; a distance under ``below`` joins."""
    best = cosine_pairs(items, observed(centroids, as_of, days), "primary_domain", k=1)
    return best.select(F.col("l_id").alias("id"), F.col("r_id").alias("cluster_id"), (1 - F.col("similarity")).alias("distance"), (1 - F.col("similarity") < below).alias("joins"))


def archive_matches(centroids: DataFrame, archive: DataFrame, k: int = 5) -> DataFrame:
    """(id, rank, archive_id, similarity) over all domains."""
    one = lambda df: df.withColumn("everything", F.lit(1))
    return cosine_pairs(one(centroids), one(archive), "everything", k=k).select(F.col("l_id").alias("id"), "rank", F.col("r_id").alias("archive_id"), "similarity")


def search(queries: DataFrame, candidates: DataFrame, centroids: DataFrame, most: int = 100) -> DataFrame:
    """(query_id, rank, id, distance): each query's nearest candidates by the centroid of their cluster, as many as it wants.

    queries(id, vector, wanted), wanted at most ``most``; candidates(candidate_id, cluster_id). All queries are one
    join; equal distances (candidates of one cluster) fall to the smaller id. A candidate without a centroid isn't found.
    """
    placed = candidates.join(centroids.select(F.col("id").alias("cluster_id"), "vector"), "cluster_id").select(F.col("candidate_id").alias("id"), "vector")
    one = lambda df: df.withColumn("everything", F.lit(1))
    best = cosine_pairs(one(queries.select("id", "vector")), one(placed), "everything", k=most)
    wanted = queries.select(F.col("id").alias("l_id"), "wanted")
    return best.join(wanted, "l_id").filter("rank <= wanted").select(F.col("l_id").alias("query_id"), "rank", F.col("r_id").alias("id"), (1 - F.col("similarity")).alias("distance"))


def archive_links(matches: DataFrame, archive: DataFrame, links: int = 3) -> DataFrame:
    """matches with the overlap of their centroid, its best similarity, and the time of publication of the links to keep."""
    best = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = matches.join(archive.select(F.col("id").alias("archive_id"), "published_at"), "archive_id")
    return dated.select("id", "rank", "archive_id", "similarity", F.max("similarity").over(best).alias("overlap"), F.when(F.col("rank") <= links, F.col("published_at")).alias("link_published_at"))


def archive_decision(centroids: DataFrame, matches: DataFrame, archive: DataFrame, as_of: Column, drop: float = 0.85, flag: float = 0.70, days: int = 90) -> DataFrame:
    """(id, overlap, decision) of every centroid from its top match: drop if near and recent, flag if fairly near, else pass; without a match overlap is 0."""
    top = centroids.select("id").join(matches.filter("rank = 1"), "id", "left").join(archive.select(F.col("id").alias("archive_id"), "published_at"), "archive_id", "left")
    recent = F.coalesce(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    overlap = F.coalesce("similarity", F.lit(0.0))
    return top.select("id", overlap.alias("overlap"), F.when((overlap > drop) & recent, "drop").when((overlap > flag) & (overlap <= drop), "flag").otherwise("pass").alias("decision"))


def _mergeable(clusters: DataFrame, entities: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Active, lately observed clusters with their entities as tags."""
    tags = entities.filter("entity IS NOT NULL").groupBy("id").agg(F.collect_set("entity").alias("tags"))  # a cluster's own
    return observed(clusters, as_of, days).select("id", "vector", "primary_domain").join(tags, "id")


def merge_pairs(clusters: DataFrame, entities: DataFrame, as_of: Column, below: float = 0.15, days: int = 7) -> DataFrame:
    """(a, b, distance): active, lately observed clusters of one domain that are near and share an entity.

    Entities go with the vectors into the blocked join, so that no other pair is ever written or shuffled.
    """
    return sharing_pairs(_mergeable(clusters, entities, as_of, days), "primary_domain", below).select(F.col("id").alias("a"), F.col("other").alias("b"), "distance")


def _greedy(pairs: DataFrame) -> DataFrame:
    """What a sequential loop over (a, b, distance, rough) in order accepts, if it drops each pair that shares an end with an accepted one."""
    return first_wins(pairs.withColumn("o", F.struct("rough", "a", "b")).withColumn("ends", F.array("a", "b")), "o", ["ends"]).select("a", "b", "distance")


def greedy_matching(rows: DataFrame, below: float, k: int = 16, few: int = 2000) -> DataFrame:
    """(a, b, distance): the greedy matching by distance over all pairs of ``sharing_pairs``, without all of these pairs at once.

    Each row has the list of its k first pairs. Two rows that are each other's first stand in the matching, as no earlier pair can
    take either; rounds of this go on as long as they get on. A list that was cut at k and is used up says nothing, so its row waits. What
    rounds hardly change goes through ``first_wins`` as far as no list was cut. Then the rows that are left get new lists. The
    last ``few`` rows go through ``first_wins`` with all their pairs.
    """
    taken: list[DataFrame] = []
    every = lambda: reduce(DataFrame.unionByName, taken)

    def without(lists: DataFrame, pairs: DataFrame) -> DataFrame:
        taken.append(pairs)
        used = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        return written(lists.join(used, "id", "left_anti").join(used.withColumnRenamed("id", "other"), "other", "left_anti"), "lists")

    edge = lambda: lists.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "distance", "rough").distinct()
    left = written(rows, "unmatched")
    while left.count() > few:
        lists = written(sharing_pairs(left, "primary_domain", below, k), "lists")
        ends = written(lists.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct("rough", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).alias("last")), "list-ends")
        n = lists.count()
        while n:
            first = lists.groupBy("id").agg(F.min(F.struct("rough", "other", "distance")).alias("f")).select("id", "f.other", "f.distance", "f.rough")
            back = first.select(F.col("id").alias("other"), F.col("other").alias("id"))
            mutual = written(first.filter("id < other").join(back, ["id", "other"], "left_semi").select(F.col("id").alias("a"), F.col("other").alias("b"), "distance"), "matched")
            lists = without(lists, mutual)
            before, n = n, lists.count()
            if n > 0.9 * before:
                cut = ends.filter(F.col("n") == k).join(every().select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti").agg(F.min("last").alias("until"))
                known = edge().join(F.broadcast(cut), F.col("until").isNull() | (F.struct("rough", "a", "b") <= F.col("until"))).drop("until")
                lists = without(lists, written(_greedy(known), "matched"))
                break
        whole = ends.filter(F.col("n") < k).select("id").join(lists.select("id"), "id", "left_anti")  # all their partners are taken
        none = left.select("id").join(ends.select("id"), "id", "left_anti")
        gone = reduce(DataFrame.unionByName, [every().select(F.explode(F.array("a", "b")).alias("id")), whole, none])
        left = written(left.join(gone, "id", "left_anti"), "unmatched")
    taken.append(_greedy(sharing_pairs(left, "primary_domain", below).withColumnsRenamed({"id": "a", "other": "b"})))
    return every()


def compaction(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source, target, distance): greedy matching by distance; the larger cluster stays, then the older, then a."""
    return directed(_greedy(pairs.withColumn("rough", F.round("distance", 12))), clusters)


def directed(chosen: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source, target, distance) of matched pairs: the larger cluster stays, then the older, then a."""
    side = lambda name: clusters.select(F.col("id").alias(name), F.struct((-F.col("item_count")).alias("n"), "first_seen_at", F.lit(0 if name == "a" else 1).alias("s")).alias(f"{name}_rank"))
    both = chosen.join(side("a"), "a").join(side("b"), "b")
    keeps = F.col("a_rank") < F.col("b_rank")
    return both.select(F.when(keeps, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(keeps, F.col("a")).otherwise(F.col("b")).alias("target"), "distance")


def compacted(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """clusters(id, item_count, first_seen_at, last_seen_at, domains, status, merged_into, vector) after the merges.

    Of a target, centroids weigh by count, counts add up, domains unite, the first and the last time are those of both; a
    source is ``merged`` into its target and stays as it was. ``domains`` may be missing.
    """
    wide = "domains" in clusters.columns
    taken = clusters.select(F.col("id").alias("source"), F.col("item_count").alias("n2"), F.col("first_seen_at").alias("f2"), F.col("last_seen_at").alias("l2"), F.col("vector").alias("v2"), (F.col("domains") if wide else F.lit(None)).alias("d2"))
    src = merges.join(taken, "source").drop("source", "distance").withColumnRenamed("target", "id")
    gone = merges.select(F.col("source").alias("id"), F.col("target").alias("into"))
    # the old columns have names of their own, as a name inside a lambda could mean the new column
    joined = clusters.withColumnsRenamed({"item_count": "n1", "vector": "v1", "domains": "d1"}).join(src, "id", "left").join(gone, "id", "left")
    total = F.col("n1") + F.coalesce("n2", F.lit(0))
    mean = F.when(F.col("n2").isNotNull(), F.zip_with("v1", "v2", lambda x, y: (x * F.col("n1") + y * F.col("n2")) / total)).otherwise(F.transform("v1", lambda x: x.cast("double")))
    both = [F.when(F.col("d2").isNull(), F.col("d1")).otherwise(F.array_sort(F.array_union("d1", "d2"))).alias("domains")] if wide else []
    into = F.coalesce("into", "merged_into") if "merged_into" in clusters.columns else F.col("into")
    return joined.select(
        "id", total.alias("item_count"), F.least("first_seen_at", "f2").alias("first_seen_at"), F.greatest("last_seen_at", "l2").alias("last_seen_at"), *both,
        F.when(F.col("into").isNotNull(), "merged").otherwise(F.col("status")).alias("status"), into.alias("merged_into"), mean.alias("vector"),
        *[c for c in clusters.columns if c == "primary_domain"],
    )


def repointed(items: DataFrame, merges: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The items with those of merged clusters in their targets."""
    to = merges.select(F.col("source").alias(cluster), "target")
    return items.join(to, cluster, "left").withColumn(cluster, F.coalesce("target", cluster)).drop("target").select(*items.columns)


def compact(clusters: DataFrame, entities: DataFrame, as_of: Column, below: float = 0.15, days: int = 7, passes: int | None = 1, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(clusters, merges of all passes, items) after so many passes, or (``None``) until nothing merges.

    A pass finds near pairs of active clusters that share an entity once, matches them greedily and merges; a merged
    centroid has moved, so what it could merge with now is the next pass's. Entities of a source are its target's in the next pass.
    """
    every, number = None, 0
    while passes is None or number < passes:
        merges = written(directed(greedy_matching(_mergeable(clusters, entities, as_of, days), below), clusters), "merges")
        if merges.isEmpty() and every is not None:
            break
        every = merges if every is None else every.unionByName(merges)
        clusters = written(compacted(clusters, merges), "compacted")
        entities = written(repointed(entities, merges, "id"), "entities")
        items = None if items is None else written(repointed(items, merges), "repointed")
        number += 1
        if passes is None and merges.isEmpty():
            break
    return clusters, every, items


def survivors(parents: DataFrame) -> DataFrame:
    """(id, survivor) for parents(id, merged_into), null at a survivor, by pointer jumping."""
    state = written(parents.select("id", F.coalesce("merged_into", "id").alias("survivor")), "survivors")
    while True:
        up = state.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"))
        new = written(state.join(up, "survivor", "left").select("id", F.col("survivor").alias("old"), F.coalesce("next", "survivor").alias("survivor")), "survivors")
        moved = new.filter("old <> survivor").limit(1).count()
        state = new.select("id", "survivor")
        if not moved:
            return state


def collisions(best: DataFrame, low: float = 0.45, high: float = 0.80, rows: int = 20) -> DataFrame:
    """(a, b, similarity): the most similar pairs of clusters of different domains within the band.

    A block is a pair of domains; each of its groups keeps its ``rows`` best, so pairs never pile up.
    """
    others = best.withColumn("other", F.explode(F.array(*[F.lit(d) for d in DOMAINS]))).withColumn("block", F.concat_ws("|", F.least("primary_domain", "other"), F.greatest("primary_domain", "other")))
    pairs = cosine_pairs(others.filter("primary_domain < other"), others.filter("primary_domain > other"), "block", at_least=low, at_most=high, best=rows)
    return pairs.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), "similarity").orderBy(F.desc("similarity"), "a", "b").limit(rows)


def best_per_cluster(candidates: DataFrame, start: Column, end: Column) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.desc("curation_score"), F.desc("created_at"), "candidate_id")
    return candidates.filter((F.col("created_at") >= start) & (F.col("created_at") < end)).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
