"""Shared pieces of the training-data operators: tables, shared folder, vectorised text scans."""

from __future__ import annotations

import base64
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
STEP_BYTES = 500_000
#: Most rows of an Arrow batch while an intermediate table is written; Spark itself ends a batch at 64 MB.
BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that an operator's Python step sees at once, whatever the batch that Spark sends.
SLICE_ROWS = 1000
#: What may be broadcast at once, and what a row of a few numbers takes in a broadcast relation.
BROADCAST_BYTES = 8_000_000
ROW_BYTES = 40
#: A table of so many rows is no burden to one task.
SMALL_ROWS = 20_000

_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine a temporary one is set if there is none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of all operators called inside go to one folder, which goes at the end: use their results before it."""
    folder = f"{_FOLDER.get() or shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for the jobs inside; the session's setting comes back."""
    before = spark.conf.get(BATCH_SETTING)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, row_bytes: int = ROW_BYTES) -> bool:
    """Whether a table of small rows fits BROADCAST_BYTES."""
    return rows.count() * row_bytes <= BROADCAST_BYTES


def checked(rows: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """rows with a broadcast hint if they fit BROADCAST_BYTES; beyond, Spark shuffles."""
    return F.broadcast(rows) if few(rows, row_bytes) else rows


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, parts) of the keys with more rows than half a shuffle partition's fair share, None if there are none.

    There are at most twice as many as partitions. Up to SMALL_ROWS rows no task is too large.
    """
    spark = rows.sparkSession
    total = rows.count()
    if total <= SMALL_ROWS:
        return None
    fair = max(1, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > fair).select(*keys, F.ceil(F.col("__n") / fair).cast("int").alias("__parts"))
    found = hot.collect()
    return spark.createDataFrame(found, hot.schema) if found else None


def spread(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has few rows of each key: rows of hot keys of left (or of ``counted``) are dealt over parts, and right's go to each."""
    hot = hot_keys(left if counted is None else counted, keys)
    if hot is None:
        return left.join(right, keys, how)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts)).drop("__parts")
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")


def give_back() -> None:
    """Returns to the system what the allocators of a Python worker hold; workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that sees them in slices, and gives its worker's free memory back when the partition ends."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(b.slice(i, SLICE_ROWS) for b in batches for i in range(0, max(1, b.num_rows), SLICE_ROWS))
        finally:
            give_back()

    return inner


@lru_cache(maxsize=1)
def token_ranks(path: str):
    """A byte-pair vocabulary of token ranks, read once by a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the quarter of the documents that no model may learn from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def one_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Of repeated rows of a key one, with the smallest text and the largest other columns."""
    others = [F.max(c).alias(c) for c in rows.columns if c not in (key, text)]
    return rows.groupBy(key).agg(F.min(text).alias(text), *others)


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows of df, picked by a hash of the key: the same rows in every run and on every cluster."""
    if total <= rows:
        return df
    share = int(rows / total * 1_000_003)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1_000_003)) < share)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents that hold about ``most`` bytes and at most ``rows`` documents each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, i + rows, max(i + 1, j))
        yield i, j
        i = j


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
#: Inside a word of [^\x20\x09-\x0D]+.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Inside a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z became a-z.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the n + 1 places in that list where each document's words begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    here = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = here[:-1]
    begins = np.flatnonzero(here & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = here[1:]
    ends = np.flatnonzero(here & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, letters: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of every word (or other span of bytes); ``letters`` says as what a byte counts: A-Z as a-z unless given."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    size = ends - begins
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), MULTIPLIER, np.uint64))
    values = letters[data[place + np.repeat(begins, size)]].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * powers[place], first) + size.astype(np.uint64))
