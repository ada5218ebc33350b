"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bitmasks.

Vectors become integers, floor(1024 x), and are cut into 4 equal parts with a codebook of 256 entries each. A
codebook's index holds, for each dimension, its entries' coordinates in order and a mask for each prefix of that
order: the entries among the first i, as uint64 words. Entries inside [q - r, q + r] of a dimension are the
difference of two prefix masks, found by two binary searches; ANDed over all dimensions they are the entries in the
cube around q. The radius begins at the codebook's usual gap between neighbouring entries. If no entry is in the cube, the radius
grows by half; if the best one inside is farther than the radius, the radius becomes that distance, and the next
cube is sure to hold all entries at most so far away, ties included. So the candidates are exact, and only they are
measured.

Spark runs the rounds: a pass over the table assigns every part and adds up, in numpy, each partition's components by
entry; one aggregate adds the partitions' sums; the codebook (256 x dimension integers, whatever the table's size)
goes through the driver to the next pass. Sums are integers, so the order of tasks and their repetition change
nothing. Vectors are read anew in each pass, nothing but the last pass is written.

Rows whose vector is null, empty, holds null or non-finite components, or has another length than the vector of the
smallest id (or one that 4 doesn't divide) are dropped. Rows of one id are separate rows with a code each; the first
codebook takes the smallest vector of an id. Rows without an id get codes and are in no first codebook. With fewer
than 256 ids the codebooks are so much smaller; an empty table gives no rows. Of equally near entries the lower index
counts. Squared distances must fit 62 bits (components below 2^27 for 64 dimensions); beyond it an ArithmeticError
says so, as Spark's own sums do. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import few, lean, spread, table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts that are looked up at once.
BLOCK = 512


class Slices:
    """The index of one codebook: (entries, dimension) integers."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, dims = book.shape
        self.words = -(-n // 64)
        bits = np.zeros((n, self.words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(book, order, axis=0).T)
        self.prefixes = np.zeros((dims, n + 1, self.words), np.uint64)
        for k in range(dims):
            np.bitwise_or.accumulate(bits[order[:, k]], axis=0, out=self.prefixes[k, 1:])
        self.radius = self._gap()

    def _gap(self) -> int:
        """The median, over entries, of the largest coordinate difference to the entry where that is least."""
        if len(self.book) < 2:
            return 1
        gaps = []
        for i, entry in enumerate(self.book):
            apart = np.abs(self.book - entry).max(axis=1)
            apart[i] = np.iinfo(np.int64).max
            gaps.append(apart.min())
        return max(1, int(np.median(gaps)))

    def inside(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the cube of each point."""
        masks = np.full((len(points), self.words), ~np.uint64(0))
        for k, (row, prefix) in enumerate(zip(self.sorted, self.prefixes, strict=True)):
            low = np.searchsorted(row, points[:, k] - radius, "left")
            high = np.searchsorted(row, points[:, k] + radius, "right")
            masks &= prefix[high] ^ prefix[low]
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point."""
        n = len(points)
        entry, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        open_, radius = np.arange(n), np.full(n, self.radius, np.int64)
        while len(open_):
            masks = self.inside(points[open_], radius[open_])
            row, at = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
            if len(row):
                apart = points[open_[row]] - self.book[at]
                distance = np.einsum("ij,ij->i", apart, apart)
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                least = np.minimum.reduceat(distance, first)
                hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.r_[first, len(row)])))
                hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # candidates are in order of index
                best[open_[row[first]]], entry[open_[row[first]]] = least, at[hit]
            found = best[open_]
            r = radius[open_]
            none = found == np.iinfo(np.int64).max
            done = ~none & (found <= r * r)
            root = np.ceil(np.sqrt(np.where(none, 0, found).astype(np.float64))).astype(np.int64) + 1  # at least the distance
            radius[open_] = np.where(none, r + r // 2 + 1, root)
            open_ = open_[~done]
        return entry, best


def integers(column: pa.Array, dims: int, scale: int = SCALE) -> np.ndarray:
    """(rows, dims) of floor(scale * x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * scale)
    if len(scaled) and 4 * np.abs(scaled).max() ** 2 * dims >= 2.0**62:
        raise ArithmeticError("vector components are too large: squared distances overflow a long")
    return scaled.astype(np.int64).reshape(-1, dims)


def usable(vectors: DataFrame, vector: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows that take part, and their vectors' length (0 if there are none)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    good = vectors.filter((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite)
    first = good.orderBy(F.col("id").asc_nulls_last(), F.size(vector)).select(F.size(vector)).first()
    return (good.filter(F.size(vector) == first[0]), first[0]) if first else (good, 0)


def first_books(good: DataFrame, dims: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids: at most ``entries`` rows come to the driver."""
    ids = good.select("id").filter("id IS NOT NULL").distinct().orderBy("id").limit(entries)
    chosen = [r.id for r in ids.collect()]
    rows = good.filter(F.col("id").isin(chosen)).groupBy("id").agg(F.min("vector").alias("vector")).collect() if chosen else []
    if not rows:  # no row has an id
        return [np.zeros((1, dims // parts), np.int64)] * parts
    whole = np.floor(np.array([r.vector for r in sorted(rows, key=lambda r: r.id)], np.float64) * scale).astype(np.int64)
    return np.split(whole, parts, axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, books: list[np.ndarray], scale: int) -> Iterator[tuple]:
    """(batch, first row, vectors, (entry, distance) of each part) of every block of rows."""
    indexes = [Slices(b) for b in books]
    dims = sum(b.shape[1] for b in books)
    for batch in batches:
        whole = integers(batch.column(at), dims, scale)
        for i in range(0, len(whole), BLOCK):
            rows = whole[i : i + BLOCK]
            pieces = np.split(rows, len(books), axis=1)
            yield batch, i, pieces, [index.nearest(np.ascontiguousarray(piece)) for index, piece in zip(indexes, pieces, strict=True)]


def _adding(books: list[np.ndarray], scale: int) -> Callable:
    """Sums of a whole partition: rows (part, entry, place, total); place -1 counts."""

    def run(batches):
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for _, _, pieces, found in _blocks(batches, 0, books, scale):
            for total, piece, (entry, _) in zip(totals, pieces, found, strict=True):
                np.add.at(total, entry, np.hstack([np.ones((len(piece), 1), np.int64), piece]))
        for part, total in enumerate(totals):
            used = np.flatnonzero(total[:, 0])
            width = total.shape[1]
            columns = [np.full(len(used) * width, part), np.repeat(used, width), np.tile(np.arange(-1, width - 1), len(used)), total[used].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["part", "entry", "place", "total"])

    return run


def trained(good: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks after the rounds; unused entries stay."""
    for _ in range(rounds):
        sums = good.select("vector").mapInArrow(lean(_adding(books, scale)), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        wholes = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for part, entry, place, total in sums:
            wholes[part][entry, place + 1] = total
        books = [np.where(w[:, :1] > 0, w[:, 1:] // np.maximum(w[:, :1], 1), b) for w, b in zip(wholes, books, strict=True)]
    return books


def encoded(good: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of every row."""
    kinds = dict(good.dtypes)

    def run(batches):
        for batch, i, pieces, found in _blocks(batches, 2, books, scale):
            n = len(pieces[0])
            code = np.stack([entry for entry, _ in found], axis=1)
            error = np.sum([distance for _, distance in found], axis=0)
            texts = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return good.select("id", "label", "vector").mapInArrow(lean(run), f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code, error) of every row, the codebooks). At most 256 entries: an index is two hex digits."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    good, dims = usable(rows, "vector", parts)
    books = trained(good, first_books(good, dims, parts, min(entries, 256), scale), rounds, scale) if dims else [np.zeros((1, 0), np.int64)] * parts
    coded = encoded(good, books, scale) if dims else good.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with the sum of the errors of each label, rows without a label together: an aggregate, joined back by the label."""
    keyed = coded.withColumns({"__known": F.col("label").isNotNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    totals = keyed.groupBy("__known", "__label").agg(F.sum("error").alias("label_error"))
    keys = ["__known", "__label"]
    joined = keyed.join(F.broadcast(totals), keys) if few(totals, 100) else spread(keyed, totals, keys)
    return joined.drop(*keys)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    found = label_errors(written(coded, "codes"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by measuring all entries, round by round."""
    steps = []
    for k in range(ROUNDS + 1):
        apart = "list_sum(list_transform(range(1, len(a.x) + 1), lambda j: (a.x[j] - b.x[j]) * (a.x[j] - b.x[j])))"
        steps.append(f"near{k} AS (SELECT a.rid, a.p, min({apart} * {ENTRIES} + b.e)::BIGINT AS best FROM parts a JOIN book{k} b USING (p) GROUP BY a.rid, a.p)")
        if k < ROUNDS:
            steps.append(f"""flat{k} AS (SELECT n.p, n.best % {ENTRIES} AS e, unnest(a.x) AS v, generate_subscripts(a.x, 1) AS j FROM near{k} n JOIN parts a USING (rid, p)),
means{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (SELECT p, e, j, sum(v)::BIGINT AS s, count(*) AS n FROM flat{k} GROUP BY p, e, j) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) r(p)),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS (SELECT p, e, x FROM parts JOIN firsts USING (rid)),
{", ".join(steps)},
said AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(x, ',') AS t FROM book{ROUNDS})),
coded AS (SELECT rid, string_agg(printf('%02x', (best % {ENTRIES})::INTEGER), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), said
"""


ORACLE = _oracle()
