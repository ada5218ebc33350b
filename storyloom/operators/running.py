"""Running values over a long order without one task for a key.

``ranged`` deals rows over ranges of (keys, order) and writes them, so that a row's part is fixed. Values are then
run within each part and key; the parts' totals (a row for each part and key) are run over the parts, and come back as an
offset. A key with all rows of the table is spread over all parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.sources.shared import written

PART = "__part"


def ranged(rows: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """rows with their part; ``order`` begins with the widest key and is unique."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def _with(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """offsets by part and keys, nulls being equal."""
    renamed = offsets.withColumnsRenamed({c: f"__of_{c}" for c in (PART, *keys)})
    on = F.col(PART) == F.col(f"__of_{PART}")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(renamed, on, how).drop(*(f"__of_{c}" for c in (PART, *keys)))


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, total: Callable[[Column | str], Column] = F.sum, add: Callable[[Column, Column], Column] = add) -> DataFrame:
    """rows of ``ranged`` with ``name``: the sum of the value over all earlier rows of the keys, 0 for the first; or another ``total`` of which 0 is the neutral value, with the ``add`` of two of them."""
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(PART, *keys).agg(total(value).alias("__sum"))
    offsets = sums.select(PART, *keys, F.coalesce(total("__sum").over(across), F.lit(0)).alias("__offset"))
    return _with(rows.withColumn("__own", F.coalesce(total(value).over(within), F.lit(0))), offsets, keys).withColumn(name, add(F.col("__own"), F.col("__offset"))).drop("__own", "__offset")


def last_known(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows of ``ranged`` with ``name``: the last value that isn't null, up to the row itself."""
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy(PART, *keys).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("__last"))
    carried = lasts.select(PART, *keys, F.last("__last", ignorenulls=True).over(across).alias("__carried"))
    return _with(rows.withColumn("__own", F.last(value, ignorenulls=True).over(within)), carried, keys).withColumn(name, F.coalesce("__own", "__carried")).drop("__own", "__carried")
