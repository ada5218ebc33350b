"""Greedy first-wins selection under several keys: rounds of joins for what is large, one bounded task for what is left."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.sources.shared import written

#: So many rows go through the loop in one task.
LOOP_ROWS = 20_000


def _loop(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential loop over rows (n, claims)."""
    used: set = set()
    kept = []
    rows = rows.sort_values("n")
    for n, claims in zip(rows["n"], rows["claims"], strict=True):
        if used.isdisjoint(claims):
            used.update(claims)
            kept.append(n)
    return pd.DataFrame({"n": kept}, dtype="int64")


def _first(left: DataFrame, rows: int) -> DataFrame:
    """What the loop accepts of the first rows in order, all of which come before the rest."""
    head = written(left.orderBy("o").limit(rows).withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o")).cast("long")).withColumn("all", F.lit(1)), "greedy-head")
    kept = head.select("n", "claims", "all").groupBy("all").applyInPandas(_loop, "n long")
    return written(head.join(kept, "n", "left_semi").select("o", "claims"), "greedy-accepted")


def first_wins(rows: DataFrame, order: str, keys: Sequence[str], loop_rows: int = LOOP_ROWS) -> DataFrame:
    """The rows that a sequential loop in ``order`` (unique) would accept, if it drops each row that shares a key with an accepted one.

    A round accepts rows that come first among the remaining rows of all their keys, and drops what shares a key
    with them. Up to ``loop_rows`` remaining rows end in one task, by the loop itself. Where a round gets rid of less than
    a tenth (rows that are ordered along a chain of conflicts), the first ``loop_rows`` go through the loop too: they come before all
    others, so what it accepts stands. So there are never more rounds than rows over ``loop_rows``, and few as a rule. A null key never
    conflicts. Keys may be of one space (``a`` and ``b`` of an edge list): then pass an array column instead, as
    ``keys=[name]`` of array type.
    """
    arrays = dict(rows.dtypes)[keys[0]].startswith("array")
    listed = F.transform(keys[0], lambda x: F.concat(F.lit("0|"), x.cast("string"))) if arrays else F.array(*[F.concat(F.lit(f"{i}|"), F.col(k).cast("string")) for i, k in enumerate(keys)])
    left = written(rows.select(F.col(order).alias("o"), F.filter(listed, lambda c: c.isNotNull()).alias("claims")), "greedy-left")
    taken: list[DataFrame] = []

    def without(accepted: DataFrame) -> DataFrame:
        """left less the accepted and what conflicts with them."""
        used = accepted.select(F.explode("claims").alias("claim"))
        dropped = left.select("o", F.explode("claims").alias("claim")).join(used, "claim", "left_semi").select("o").distinct()
        taken.append(accepted.select("o"))
        return written(left.join(accepted.select("o"), "o", "left_anti").join(dropped, "o", "left_anti"), "greedy-left")

    n = left.count()
    while n > loop_rows:
        flat = left.select("o", F.explode("claims").alias("claim"))
        beaten = flat.join(flat.groupBy("claim").agg(F.min("o").alias("first")), "claim").filter("o <> first").select("o").distinct()
        left = without(written(left.join(beaten, "o", "left_anti"), "greedy-accepted"))
        before, n = n, left.count()
        if n > loop_rows and n > 0.9 * before:
            left = without(_first(left, loop_rows))
            n = left.count()
    taken.append(_first(left, loop_rows).select("o"))
    every = taken[0]
    for part in taken[1:]:
        every = every.unionByName(part)
    return rows.join(every.withColumnRenamed("o", order), order, "left_semi")
