"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words and its subwords (byte trigrams, blanks and marks among them), as written, hashed to
fixed numbers of buckets, and a few binned form terms (share of repeated words, of repeated neighbours and lines, of
capitals and marks, mean word length, size). A bounded sample of labelled texts (``sample_rows``) gives the terms'
inverse document frequencies and, by a truncated singular value decomposition in numpy, the latent space; its
labelled vectors are broadcast (``sample_rows`` x ``RANK`` numbers, so of a fixed size). Every document is projected
and compared with all labelled vectors by exact cosine products, in blocks of a fixed shape; the ``neighbours``
nearest vote with weights that grow with similarity.

A score depends on its own text alone: projection is a sum over the text's own terms, blocks have one shape
whatever a batch holds, and similarities are rounded to nine places. So repeated rows have equal scores. Ties in
similarity fall to the smaller id of the labelled row.

Null texts count as empty texts: they get the vote of the labelled texts nearest to an empty one. Very long
texts are read whole in one pass. Of several texts under one labelled id the smallest is learned from, of several
labels the largest counts. Empty tables give no rows. Without labelled rows the score is 0.5. Only the named columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import MULTIPLIER, NOT_SPACE, bounded_sample, give_back, held_out, lean, mix, one_text, steps, table, utf8, word_spans

SAMPLE_ROWS = 4000
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 12.0
THRESHOLD = 0.7
PRIOR = 0.5
#: Documents that are counted at once, and compared at once.
BLOCK = 128
#: Labelled rows that training unfolds at once: the sample stays sparse in the driver's memory.
FIT_ROWS = 256

SUBWORD_BITS, WORD_BITS = 12, 11
SUBWORDS, WORDS = 1 << SUBWORD_BITS, 1 << WORD_BITS
BINS = 12
FORMS = 8
FORM_WEIGHT = 0.35
TERMS = SUBWORDS + WORDS + BINS * FORMS

UPPER, LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
MARK[33:48] = MARK[58:65] = MARK[91:97] = MARK[123:127] = True


def hashed_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word as written."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    size = ends - begins
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), MULTIPLIER, np.uint64))
    letters = data[place + np.repeat(begins, size)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(letters * powers[place], first) + size.astype(np.uint64))


def shares(own: np.ndarray, bucket: np.ndarray, n: int, size: int) -> np.ndarray:
    """Text x bucket: square roots of the buckets' shares of each text's terms."""
    counts = np.bincount(own * size + bucket, minlength=n * size).reshape(n, size)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def distinct_per(own: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    return np.bincount(own, weights=fresh, minlength=n)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text x term, as float32: shares of subwords and words, and form terms."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    if len(data) >= 3:
        x = data.astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SUBWORD_BITS)
        same = doc[:-2] == doc[2:]
        out[:, :SUBWORDS] = shares(doc[:-2][same], code[same].astype(np.int64), n, SUBWORDS)
    begins, ends, at = word_spans(data, offsets, NOT_SPACE)
    words = hashed_words(data, begins, ends)
    own = np.repeat(np.arange(n), np.diff(at))
    out[:, SUBWORDS : SUBWORDS + WORDS] = shares(own, (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), n, WORDS)
    sums = lambda mask: np.bincount(doc, weights=mask, minlength=n)
    upper, letters, marks, lines = sums(UPPER[data]), sums(LETTER[data]), sums(MARK[data]), sums(data == 10)
    total = np.maximum(np.diff(at), 1)
    twice = np.zeros(len(words), bool)
    twice[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    line_begins, line_ends, line_at = word_spans(data, offsets, np.arange(256) != 10)
    line_distinct = distinct_per(np.repeat(np.arange(n), np.diff(line_at)), hashed_words(data, line_begins, line_ends), n)
    length = np.bincount(own, weights=ends - begins, minlength=n) / total
    safe = np.maximum(size, 1)
    forms = [
        1 - np.minimum(distinct_per(own, words, n) / total, 1),
        np.bincount(own, weights=twice, minlength=n) / total,
        1 - np.minimum(line_distinct / np.maximum(np.diff(line_at), 1), 1),
        upper / np.maximum(letters, 1),
        np.sqrt(marks / safe),
        np.minimum(length / 24, 1),
        np.minimum(np.log2(size + 1) / 20, 1),
        np.minimum(lines / safe * 10, 1),
    ]
    for i, value in enumerate(forms):
        place = np.clip(value, 0, 1) * (BINS - 1)  # a value between two bins counts for both
        low = np.floor(place).astype(int)
        base = SUBWORDS + WORDS + i * BINS
        out[np.arange(n), base + low] += (1 - (place - low)).astype(np.float32) * FORM_WEIGHT
        out[np.arange(n), base + np.minimum(low + 1, BINS - 1)] += (place - low).astype(np.float32) * FORM_WEIGHT
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # inverse document frequencies
    space: np.ndarray  # term x rank
    vectors: np.ndarray  # labelled x rank, of length 1, in the order of their ids
    labels: np.ndarray
    base: float

    def latent(self, at: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """The unit vector of one text's terms in the latent space."""
        out = (shares.astype(np.float64) * self.weights[at]) @ self.space[at]
        return out / max(float(np.sqrt((out * out).sum())), 1e-12)

    def project(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space, each from its own row's terms alone."""
        out = np.zeros((len(terms), self.space.shape[1]))
        for i, row in enumerate(terms):
            at = np.flatnonzero(row)
            out[i] = self.latent(at, row[at])
        return out

    def vote(self, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out, k = np.empty(len(terms)), min(neighbours, len(self.labels))
        block = np.zeros((BLOCK, self.space.shape[1]))
        for i in range(0, len(terms), BLOCK):
            j = min(len(terms), i + BLOCK)
            block[: j - i] = self.project(terms[i:j])
            near = np.round(block @ self.vectors.T, 9)[: j - i]
            edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            for r, (row, least) in enumerate(zip(near, edge, strict=True), i):
                top = np.flatnonzero(row >= least)
                top = top[np.argsort(-row[top], kind="stable")[:k]]
                weight = np.exp(SHARPNESS * (row[top] - 1))
                out[r] = ((weight * self.labels[top]).sum() + PRIOR * 1e-3 * self.base) / (weight.sum() + PRIOR * 1e-3)
        return np.clip(out, 0.0, 1.0)


def fit_sparse(ids: np.ndarray, shares: np.ndarray, at: np.ndarray, labels: np.ndarray, rank: int = RANK) -> QualityModel:
    """Term weights and a truncated SVD by subspace iteration, from a fixed seed.

    Row i of the sample has the terms ids[at[i]:at[i + 1]] with their shares; FIT_ROWS rows at a time are unfolded.
    """
    n = len(at) - 1
    idf = np.log((1 + n) / (1 + np.bincount(ids, minlength=TERMS))) + 1

    def blocks():
        for i in range(0, n, FIT_ROWS):
            j = min(n, i + FIT_ROWS)
            own = slice(at[i], at[j])
            x = np.zeros((j - i, TERMS), np.float32)
            x[np.repeat(np.arange(j - i), np.diff(at[i : j + 1])), ids[own]] = shares[own] * idf[ids[own]].astype(np.float32)
            yield x

    rank = min(rank, n, TERMS)
    basis = np.random.default_rng(3).normal(size=(TERMS, min(rank + 8, n, TERMS))).astype(np.float32)
    for _ in range(4):
        turned = np.zeros_like(basis)
        for x in blocks():
            turned += x.T @ (x @ basis)
        basis, _ = np.linalg.qr(turned)
    _, _, turn = np.linalg.svd(np.concatenate([x @ basis for x in blocks()]), full_matrices=False)
    model = QualityModel(idf, (basis @ turn.T[:, :rank]).astype(np.float64), np.zeros((n, rank)), labels.astype(np.float64), float(labels.mean()))
    for i in range(n):
        model.vectors[i] = model.latent(ids[at[i] : at[i + 1]], shares[at[i] : at[i + 1]])
    return model


def fit(terms: np.ndarray, labels: np.ndarray, rank: int = RANK) -> QualityModel:
    """``fit_sparse`` of text x term."""
    row, ids = np.nonzero(terms)
    return fit_sparse(ids, terms[row, ids], np.searchsorted(row, np.arange(len(terms) + 1)), labels, rank)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """A model of the labelled rows of docs, at most about ``sample_rows`` of them, picked by a hash of the key."""
    kind = dict(docs.dtypes)[key]
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(~held_out("k"))
    total = marks.filter(~held_out("k")).count()
    if not total:
        return None

    def features(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            for i, j in steps(offsets, rows=BLOCK):
                terms = term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = [np.flatnonzero(row).astype(np.int16) for row in terms]
                yield pa.RecordBatch.from_arrays([batch.column("k")[i:j], batch.column("y")[i:j], pa.array(ids, pa.list_(pa.int16())), pa.array([row[at] for row, at in zip(terms, ids, strict=True)], pa.list_(pa.float32()))], ["k", "y", "ids", "share"])

    picked = known.join(F.broadcast(bounded_sample(marks, "k", sample_rows, total)), "k").select("k", "t", "y")  # about sample_rows labels
    got = one_text(picked, "k", "t").mapInArrow(lean(features), f"k {kind}, y int, ids array<smallint>, share array<float>").toArrow().sort_by("k")
    if not got.num_rows:
        return None
    ids, share = got.column("ids").combine_chunks(), got.column("share").combine_chunks()
    at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())])
    model = fit_sparse(ids.flatten().to_numpy(), share.flatten().to_numpy(), at, got.column("y").to_numpy())
    del got, ids, share
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = np.full(batch.num_rows, 0.5)
            for i, j in steps(offsets, rows=BLOCK) if m is not None else ():
                out[i:j] = m.vote(term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {dict(docs.dtypes)[key]}, score double").withColumnRenamed("key", key)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go, repeated rows alike; all columns stay, whatever their names.

    Null and empty texts are judged as empty texts, very long ones whole. Without labels no document goes; an empty
    table gives no rows.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches):
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(names.index("text")))
            good = np.ones(batch.num_rows, bool)
            for i, j in steps(offsets, rows=BLOCK) if m is not None else ():
                good[i:j] = m.vote(term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(lean(keep), docs.schema)
