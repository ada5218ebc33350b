"""Online assignment of items to story clusters, in steps of observation time.

The assignment depends on order by its meaning: an item joins the nearest centroid and moves it. Here time is cut into
steps, and what a step does depends on its items and the state before it alone, not on parts, partitions or files:

1. Each item of the step joins the nearest centroid of the state that was lately observed, if it is near enough.
2. Of the items left, in order of (observed_at, id), one that is near no earlier leader is a leader and starts a
   cluster; the others join the step's nearest leader. Leaders are found in rounds (``leaders``): the first rows of each cell
   are judged in order, then all rows near a leader go, then the next rows are judged. No pairs leave a join.
3. Centroids move to the mean of all their members; domains unite.

With one item a step this is the item-by-item assignment, (c n + x) / (n + 1).

Two clocks are kept apart: ``first_seen_at`` is the publication of the item that started the cluster; ``last_seen_at`` the latest
observation, which alone decides whether a cluster is still open. A hit of the semantic dedup (an item that repeats a
stored one) gets its stored item's cluster and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.vectors import PART_ROWS, cosine_pairs, unit
from storyloom.sources.shared import written

NEEDED = ["id", "vector", "observed_at", "published_at", "domains"]
#: Rows of a cell that are judged one after another at a time.
BLOCK = 256


def step_of(observed_at: Column, cuts: Sequence[Column]) -> Column:
    """The number of cuts at or before an observation."""
    return reduce(lambda n, cut: n + (observed_at >= cut).cast("int"), cuts, F.lit(0))


def assignable(items: DataFrame, cell: str = "primary_domain") -> DataFrame:
    """The rows that can be assigned: with an id, a time of observation, a cell and a vector that has a direction."""
    return items.select(*NEEDED, cell).filter(F.col("id").isNotNull() & F.col("observed_at").isNotNull() & F.col(cell).isNotNull() & unit("vector").isNotNull())


def _in_order(below: float):
    """Of the rows of one cell, in order, those near no earlier one that was taken."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["observed_at", "id"])
        m = np.stack(rows["vector"].to_list()).astype(float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        taken = np.zeros(0, int)
        for start in range(0, len(m), BLOCK):
            block = m[start : start + BLOCK]
            far = np.ones(len(block), bool) if not len(taken) else (1 - block @ m[taken].T >= below).all(axis=1)
            apart = 1 - block @ block.T
            own: list[int] = []
            for i in np.flatnonzero(far):
                if (apart[i, own] >= below).all():
                    own.append(i)
            taken = np.concatenate([taken, start + np.array(own, int)])
        return rows.iloc[taken]

    return take


def leaders(items: DataFrame, below: float, cell: str, chunk_rows: int = PART_ROWS) -> DataFrame:
    """The rows (id, vector, cell) that are near no earlier leader, in order of (observed_at, id), cell by cell.

    A round judges the first ``chunk_rows`` open rows of each cell, which come before all other open rows, and closes
    every row near one of the new leaders. So the leaders are the same for any ``chunk_rows``; a cell with many leaders takes more rounds.
    """
    open_ = written(items.select("id", "observed_at", cell, "vector"), "open")
    order = Window.partitionBy(cell).orderBy("observed_at", "id")
    found = None
    while True:
        first = open_.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= chunk_rows).drop("n")
        new = written(first.groupBy(cell).applyInPandas(_in_order(below), first.schema).select("id", "vector", cell), "leaders")
        found = new if found is None else found.unionByName(new)
        near = cosine_pairs(open_, new, cell, k=1).filter(1 - F.col("similarity") < below).select(F.col("l_id").alias("id"))
        open_ = written(open_.join(near, "id", "left_anti").join(new.select("id"), "id", "left_anti"), "open")
        if open_.isEmpty():
            return found


def assign_step(state: DataFrame | None, step: DataFrame, start: Column | None, below: float = 0.30, cell: str = "primary_domain", days: int = 7, chunk_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, distance) of the step's items, the state after it); the distance is null where an item starts a cluster."""
    left, joined = step, None
    if state is not None:
        recent = state.filter(F.col("last_seen_at") > start - F.make_dt_interval(F.lit(days)))
        best = cosine_pairs(step, recent, cell, k=1).select(F.col("l_id").alias("id"), F.col("r_id").alias("cluster"), (1 - F.col("similarity")).alias("distance"))
        joined = written(best.filter(F.col("distance") < below), "joined")
        left = step.join(joined, "id", "left_anti")
    started = cosine_pairs(left, leaders(left, below, cell, chunk_rows), cell, k=1).select(F.col("l_id").alias("id"), F.col("r_id").alias("cluster"), F.when(F.col("l_id") != F.col("r_id"), 1 - F.col("similarity")).alias("distance"))
    found = written(started if joined is None else joined.unionByName(started), "assigned")
    return found, written(_moved(state, found.join(step, "id"), cell), "centroids")


def _moved(state: DataFrame | None, members: DataFrame, cell: str) -> DataFrame:
    """Clusters with the members of a step: means weigh by count, domains unite, each clock keeps to its own."""
    sums = members.select("cluster", F.posexplode("vector").alias("place", "x")).groupBy("cluster", "place").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("total"))  # one entry for each component
    seed = F.col("id") == F.col("cluster")
    own = members.groupBy("cluster").agg(F.count("*").alias("m"), F.max(F.when(seed, F.col("published_at"))).alias("published"), F.max("observed_at").alias("seen"), F.min(cell).alias("own_cell"))
    names = members.select("cluster", F.explode("domains").alias("domain")).groupBy("cluster").agg(F.array_sort(F.collect_set("domain")).alias("own_domains"))  # a fixed vocabulary
    step = own.join(total, "cluster").join(names, "cluster", "left").withColumnRenamed("cluster", "id").withColumn("own_domains", F.coalesce("own_domains", F.array().cast("array<string>")))
    mean = F.transform("total", lambda x: x / F.col("m"))
    if state is None:
        return step.select("id", F.col("own_cell").alias(cell), F.col("m").alias("item_count"), F.col("published").alias("first_seen_at"), F.col("seen").alias("last_seen_at"), F.col("own_domains").alias("domains"), mean.alias("vector"))
    state = state.withColumnRenamed("item_count", "before")  # a name inside a lambda could mean the new column of that name
    n = F.coalesce("before", F.lit(0)) + F.coalesce("m", F.lit(0))
    moved = F.when(F.col("m").isNull(), F.col("vector")).when(F.col("before").isNull(), mean).otherwise(F.zip_with("vector", "total", lambda c, t: (c * F.col("before") + t) / n))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("domains", none), F.coalesce("own_domains", none)))
    return state.join(step, "id", "full").select("id", F.coalesce(cell, "own_cell").alias(cell), n.alias("item_count"), F.coalesce("first_seen_at", "published").alias("first_seen_at"), F.greatest("last_seen_at", "seen").alias("last_seen_at"), both.alias("domains"), moved.alias("vector"))


def assign_steps(items: DataFrame, cuts: Sequence[Column], below: float = 0.30, cell: str = "primary_domain", days: int = 7, chunk_rows: int = PART_ROWS, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, distance) of all items, the clusters' state after the last step).

    ``cuts`` are the steps' starts, but for the first's. ``hits(id, stored_id)`` are dedup hits: they change nothing, and
    get the cluster of their stored item and no distance (no row if that has none). Ids are unique; ``below`` is above 0. Items
    without an id, a time, a cell or a direction (null, empty or zero vectors) have no row.
    """
    good = assignable(items, cell)
    if hits is not None:
        good = good.join(hits.select("id"), "id", "left_anti")
    good = good.withColumn("__step", step_of(F.col("observed_at"), cuts))
    found, state = [], None
    for number, start in enumerate([None, *cuts]):
        step = good.filter(F.col("__step") == number).drop("__step")
        if state is None:
            start = None
        one, state = assign_step(state, step, start, below, cell, days, chunk_rows)
        found.append(one)
    assigned = reduce(DataFrame.unionByName, found)
    return (assigned if hits is None else with_hits(assigned, hits)), state


def with_hits(assigned: DataFrame, hits: DataFrame) -> DataFrame:
    stored = assigned.select(F.col("id").alias("stored_id"), "cluster")
    return assigned.unionByName(hits.join(stored, "stored_id").select("id", "cluster", F.lit(None).cast("double").alias("distance")))
