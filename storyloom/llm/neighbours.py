"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded to a power of two, goes through a fast pseudo-rotation (three rounds of random signs and
a Hadamard transform); its bucket in a table is the nearest signed axis. Each of ``TABLES`` tables has its own
signs. A query also probes the next nearest axes, ``PROBES`` in each table. Buckets are Spark groups: the
queries that probe a bucket meet its rows, exact distances are computed in blocks in double precision, and only
each query's best ids of the bucket go on. A bucket of more than ``BLOCK_ROWS`` rows is split by a hash of id
and vector, and its queries go to each part, so that no task holds a hot bucket. All rows are indexed; no candidate is
dropped before its exact distance is known. Queries that found fewer than k neighbours probe all axes.

Vectors are held and measured in double precision, and distances beyond its square's range are scaled by powers of
two, so that no component is too large or too small. Vectors that are null, empty or zero or hold null or non-finite components take no part. Vectors of other
sizes form spaces of their own. Equal distances go to the smaller id; repeated rows of an id count once, with
the smallest distance: equal rows become one before the index, and a bucket's best are its best ids. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import lean, table, written

TABLES = 3
PROBES = 48
BLOCK_ROWS = 512
K = 10
#: Every query row's id is divisible by this.
QUERY_STEP = 100


def rotation_signs(size: int, tables: int = TABLES) -> np.ndarray:
    """tables x 3 x size signs, the same on every machine."""
    return np.random.default_rng(20_240_101 + size).choice(np.array([-1.0, 1.0]), (tables, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    size, step = x.shape[1], 1
    while step < size:
        pair = x.reshape(len(x), size // (2 * step), 2, step)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(len(x), size)
        step *= 2
    return x / np.sqrt(size)


def axes(vectors: np.ndarray, probes: int, tables: int = TABLES) -> np.ndarray:
    """row x table x probe: the nearest signed axes (2 i for +, 2 i + 1 for -), nearest first."""
    n, d = vectors.shape
    size = 1 << max(0, int(d - 1).bit_length())
    x = np.zeros((n, size))
    level = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # before the norm, whose squares could overflow
    x[:, :d] = level / np.linalg.norm(level, axis=1, keepdims=True)
    probes = min(probes, 2 * size)
    out = np.empty((n, tables, probes), np.int32)
    for t, signs in enumerate(rotation_signs(size, tables)):
        y = x
        for s in signs:
            y = hadamard(y * s)
        both = np.stack([y, -y], axis=2).reshape(n, 2 * size)
        out[:, t] = np.argsort(-both, axis=1, kind="stable")[:, :probes] if probes > 1 else both.argmax(axis=1)[:, None]
    return out


def matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaling by a power of two changes no digit."""
    gap = rows - point
    most = np.abs(gap).max(axis=1)
    scale = np.where((most > 1e-140) & (most < 1e140) | (most == 0) | ~np.isfinite(most), 1.0, np.ldexp(1.0, np.clip(-np.frexp(most)[1], -1000, 1000)))
    gap *= scale[:, None]
    return np.sqrt((gap * gap).sum(axis=1)) / scale


def usable(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def hashed(rows: DataFrame, probes: int, tables: int, kind: str) -> DataFrame:
    """(id, v, dim, place) with one row for each table and probe; place is table * 2^20 + axis."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                places = axes(matrix(part.column(1), int(d)), probes, tables) + (np.arange(tables, dtype=np.int32) << 20)[None, :, None]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, d, np.int32)), pa.array(list(places.reshape(part.num_rows, -1)), pa.list_(pa.int32()))], ["id", "v", "dim", "places"])

    return rows.mapInArrow(lean(run), f"id {kind}, v array<double>, dim int, places array<int>").select("id", "v", "dim", F.explode("places").alias("place"))


def nearest(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, key, score) of the k nearest found for every query row."""
    kind = dict(rows.dtypes)[key]
    found = rows.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("asks")).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    good = written(found, "neighbours-vectors")
    base = hashed(good.select("id", "v"), 1, tables, kind)
    # one row for each bucket: tables x signed axes, whatever the number of vectors
    parts = base.groupBy("dim", "place").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    index = base.join(F.broadcast(parts), ["dim", "place"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).select("dim", "place", "part", "id", "v")

    def search(queries: DataFrame, width: int, over: int) -> DataFrame:
        asked = hashed(queries.select("id", "v"), width, over, kind).join(F.broadcast(parts), ["dim", "place"]).select("dim", "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            schema = pa.schema([("query_id", left.schema.field("id").type), ("id", left.schema.field("id").type), ("score", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            d = left.column("dim")[0].as_py()
            q, c = matrix(left.column("v"), d), matrix(right.column("v"), d)
            q_id, c_id = left.column("id").to_numpy(), right.column("id").to_numpy()
            order = np.argsort(c_id, kind="stable")
            c, c_id = c[order], c_id[order]
            starts = np.flatnonzero(np.r_[True, c_id[1:] != c_id[:-1]])
            with np.errstate(over="ignore", invalid="ignore"):
                squares, out = (c * c).sum(axis=1), []
                for i in range(len(q)):
                    own = float(q[i] @ q[i])
                    rough = squares - 2 * (c @ q[i]) + own
                    slack = 1e-14 * (d + 8) * (squares.max() + own)  # more than rounding can take
                    if not np.isfinite(slack) or slack < 1e-280:
                        rough, slack = distances(c, q[i]), 0.0
                    rough[c_id == q_id[i]] = np.inf
                    low = np.minimum.reduceat(rough, starts)  # of each id
                    edge = np.partition(low, k - 1)[k - 1] if k < len(low) else np.inf
                    near = np.flatnonzero((c_id != q_id[i]) & (rough <= edge + 2 * slack))
                    exact = distances(c[near], q[i])
                    best = np.lexsort((c_id[near], exact))
                    best = best[np.sort(np.unique(c_id[near][best], return_index=True)[1])[:k]]
                    out.append((np.full(len(best), q_id[i]), c_id[near][best], exact[best]))
            return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema)

        pairs = asked.groupBy("dim", "place", "part").cogroup(index.groupBy("dim", "place", "part")).applyInArrow(block, f"query_id {kind}, id {kind}, score double")
        return pairs.groupBy("query_id", "id").agg(F.min("score").alias("score"))

    order = Window.partitionBy("query_id").orderBy("score", "id")
    best = lambda pairs: pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = written(best(search(good.filter("asks"), probes, tables)), "neighbours-first")
    full = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    wanting = good.filter("asks").join(full, "id", "left_anti")
    rest = best(search(wanting, 1 << 20, 1))
    done = first.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(rest)
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
