"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, A-Z folded, other ASCII as a
blank). A linear softmax on that mean gives the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of the labelled texts (about ``sample_rows`` in all, at
least ``LEAST_ROWS`` for each language, so that rare languages are learned too; every language is a class); a
temperature, fitted on a part of the sample that the descent never saw, calibrates the probabilities, and a
threshold on them (``reject_share`` of correct held-back texts) marks predictions as rejected.

Null texts and texts without a letter give ``und`` and score 0. Very long texts are read whole in one pass.
Empty tables give no rows; repeated rows give equal predictions; of several texts under one id the smallest is
learned from, under the largest of its labels. Equal probabilities go to the language whose name comes first. If no
row is labelled, all is ``und``.
Only the columns named in the call are read, so further columns and their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import LOWER, held_out, lean, one_text, steps, table, utf8

BUCKET_BITS = 15
DIMENSIONS = 16
SAMPLE_ROWS = 4000
LEAST_ROWS = 20
ORDERS = (2, 3, 4)
FOLD = LOWER.copy()
FOLD[:128][~(((LOWER[:128] >= 97) & (LOWER[:128] <= 122)))] = 32
ASCII_LETTER = (LOWER >= 97) & (LOWER <= 122)


@dataclass
class LanguageModel:
    classes: list[str]
    table: np.ndarray  # bucket x class: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order the bucket of every byte position, and a mask of the n-grams within one text."""
    x = FOLD[data].astype(np.uint32)
    out = []
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the end of the own text
    for order in ORDERS:
        h = np.zeros(len(x), np.uint32)
        for k in range(order):
            n = max(0, len(x) - k)
            h[:n] = h[:n] * np.uint32(0x01000193) + x[k:] + np.uint32(1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F)
        out.append(((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), left >= order))
    return out


def bags(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text, for training."""
    out = []
    grams = subwords(data, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = np.concatenate([g[a:b][ok[a:b]] for g, ok in grams])
        ids, counts = np.unique(own, return_counts=True)
        out.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 20.0, reject_share: float = 0.01) -> LanguageModel:
    """Stochastic gradient descent over the sample, in an order given by the seed; every fifth text calibrates."""
    classes = sorted({s[2] for s in samples})
    rng = np.random.default_rng(5)
    label = np.array([classes.index(s[2]) for s in samples])
    hold = np.arange(len(samples)) % 5 == 4
    learn = np.flatnonzero(~hold) if len(samples) >= 50 else np.arange(len(samples))
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weight = np.zeros((DIMENSIONS, len(classes)), np.float32)
    weight += rng.normal(0, 0.1, weight.shape)
    bias = np.zeros(len(classes), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, share, _ = samples[i]
            if not len(ids):
                continue
            hidden = share @ embed[ids]
            error = softmax(hidden @ weight + bias)
            error[label[i]] -= 1
            embed[ids] -= step * share[:, None] * (weight @ error)[None, :]
            weight -= 0.01 * step * np.outer(hidden, error)
            bias -= 0.001 * step * error
    scores = (embed @ weight).astype(np.float32)
    check = np.flatnonzero(hold) if len(samples) >= 50 else learn
    logits = np.array([s[1] @ scores[s[0]] + bias if len(s[0]) else bias for s in (samples[i] for i in check)]).reshape(len(check), len(classes))
    truth = label[check]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss)) if len(check) else 1.0
    sure = softmax(logits / temperature)
    right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == truth]) if len(check) else np.zeros(0)
    return LanguageModel(classes, scores, bias, temperature, float(right[int(reject_share * len(right))]) if len(right) else 0.0)


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model of the labelled rows of docs: about ``sample_rows`` in all, the same number of each language, picked by a hash of the key."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(LEAST_ROWS, sample_rows // len(counts))
    # a row for each class of the softmax, which the model on the driver holds anyway
    shares = docs.sparkSession.createDataFrame([(y, min(1.0, each / n)) for y, n in counts.items()], "y string, part double")
    picked = rows.join(F.broadcast(shares), "y").filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1_000_003)) < F.col("part") * 1_000_003)
    picked = one_text(picked.select("k", "t", "y"), "k", "t")

    def features(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in steps(offsets):
                part = bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.list_(pa.int32())), pa.array([p[1] for p in part], pa.list_(pa.float32())), batch.column(1)[i:j], batch.column(2)[i:j]], ["ids", "share", "y", "k"])

    got = picked.select("t", "y", "k").mapInArrow(lean(features), f"ids array<int>, share array<float>, y string, k {dict(rows.dtypes)['k']}").toArrow().sort_by("k")
    flat = lambda name, kind: [np.asarray(x.values.to_numpy(zero_copy_only=False), kind) for x in got.column(name)]
    return fit(list(zip(flat("ids", np.int32), flat("share", np.float32), got.column("y").to_pylist(), strict=True)))


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names, scores, reject = [], [], []
            for i, j in steps(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                some = letters(own, at)
                if m is None:
                    names += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    reject += [True] * (j - i)
                    continue
                logits, n = np.zeros((j - i, len(m.classes))), np.zeros(j - i)
                full = np.flatnonzero(np.diff(at))
                for buckets, ok in subwords(own, at):
                    n[full] += np.add.reduceat(ok, at[full], dtype=np.int64) if len(full) else 0
                    for c in range(len(m.classes) if len(full) else 0):
                        logits[full, c] += np.add.reduceat(np.where(ok, m.table[:, c][buckets], 0), at[full], dtype=np.float64)
                p = softmax((logits / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)
                best = p.argmax(axis=1)
                names += [m.classes[b] if s else "und" for b, s in zip(best, some, strict=True)]
                scores += np.where(some, p.max(axis=1), 0.0).tolist()
                reject += (~some | (p.max(axis=1) < m.reject_below)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(reject, pa.bool_())], ["key", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter."""
    count = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out())
