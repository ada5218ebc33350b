"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window) and stands for the
set of its word shingles. For exact containment one shingle of each window is a sufficient prefix: its rarest,
counted over the whole corpus in a first pass. The second pass looks up only those prefix shingles in each
document. A hit at a word gives the window's only possible place; it counts if the place lies within the
document (length and position bounds) and all words there are the window's, compared one by one as 64-bit
word hashes.

A benchmark of at most ``block_bytes`` of text (equal items counted once) is broadcast, and both passes are narrow
steps without a shuffle. A larger one stays distributed (``_joined``): a mask of 2^24 buckets, a fixed size, tells which
shingles of the documents may be an item's; only those become rows, each with the words around it. Spark counts them,
picks each distinct window's rarest, joins documents and windows on it, hot shingles dealt over tasks, and compares the
words. Both ways give the same rows.

Null and empty texts have no words; an item without words has no window; a null item_id stays out of the item
list but its windows still mark words. Very long texts are read whole. Repeated items count once by their id, and so do
several texts under one id. Repeated documents get equal rows. Of equally rare shingles the smaller hash is the prefix.
An empty table of items gives documents without hits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import ALNUM, MULTIPLIER, checked, lean, mix, spread, steps, table, utf8, word_hashes, word_spans, written

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8_000_000
FILTER_BITS = 20
MASK_BITS = 24


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = out * MULTIPLIER + words[i : i + n]
    return mix(out)


@dataclass
class Windows:
    """A block of benchmark windows, joined to their prefix shingles."""

    words: np.ndarray  # word hashes of all items, one after another
    first: np.ndarray  # window -> place of its first word
    size: np.ndarray  # window -> words
    item: np.ndarray  # window -> number of its item
    ids: list  # item number -> item_id
    sizes: tuple[int, ...]  # sizes of shingles in use
    tokens: np.ndarray  # the distinct shingles of all windows, sorted
    pairs: np.ndarray  # window x shingle: (window, shingle's place in tokens, offset within the window)
    prefix: np.ndarray | None = None  # sorted prefix shingles
    at: np.ndarray | None = None  # prefix shingle -> where its windows begin in ``order``
    order: np.ndarray | None = None
    offset: np.ndarray | None = None
    mask: np.ndarray | None = None

    def choose(self, counts: np.ndarray) -> None:
        """The rarest shingle of each window becomes its prefix; ties go to the smaller hash, then the first place."""
        window, token, offset = self.pairs.T if len(self.pairs) else np.zeros((3, 0), np.int64)
        order = np.lexsort((offset, token, counts[token], window))
        best = order[np.flatnonzero(np.r_[True, window[order][1:] != window[order][:-1]])] if len(order) else order
        chosen, inverse = np.unique(token[best], return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        self.prefix, self.order, self.offset = self.tokens[chosen], window[best][by], offset[best][by]
        self.at = np.searchsorted(inverse[by], np.arange(len(chosen) + 1))
        self.mask = mask_of(self.prefix)
        self.pairs, self.tokens = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)


def mask_of(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(tokens >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def places(tokens: np.ndarray, mask: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where members of the sorted ``tokens`` stand in ``found``, and which they are."""
    if not len(tokens) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.flatnonzero(mask[(found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    which = np.searchsorted(tokens, found[maybe])
    which[which == len(tokens)] = 0
    same = tokens[which] == found[maybe]
    return maybe[same], which[same]


def windows_of(ids: list, texts: list[str | None], window: int = WINDOW, shingle: int = SHINGLE) -> Windows:
    data, offsets = utf8(pa.array(texts, pa.string()))
    begins, ends, at = word_spans(data, offsets, ALNUM)
    words = word_hashes(data, begins, ends)
    first, size, item, pairs, tokens = [], [], [], [], []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        n = min(window, b - a)
        if not n:
            continue
        k = min(shingle, n)
        own = shingles(words[a:b], k)
        for start in range(b - a - n + 1):
            for o in range(n - k + 1):
                pairs.append((len(first), len(tokens) + start + o, o))
            first.append(a + start)
            size.append(n)
            item.append(i)
        tokens += own.tolist()
    distinct, inverse = np.unique(np.array(tokens, np.uint64), return_inverse=True)
    table_ = np.array(pairs, np.int64).reshape(-1, 3)
    if len(table_):
        table_[:, 1] = inverse[table_[:, 1]]
    in_use = tuple(sorted({min(shingle, int(n)) for n in size}))
    return Windows(words, np.array(first, np.int64), np.array(size, np.int64), np.array(item, np.int64), ids, in_use, distinct, table_)


def corpus_counts(docs: DataFrame, text: str, tokens: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """How often each of the block's shingles stands in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, mask_of(tokens), sizes))

    def run(batches):
        own, mask, ks = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in steps(offsets):
                begins, ends, at = word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                words = word_hashes(data[offsets[i] : offsets[j]], begins, ends)
                for k in ks:
                    total += np.bincount(places(own, mask, shingles(words, k))[1], minlength=len(own))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    out = np.zeros(len(tokens), np.int64)
    for r in docs.select(text).mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


def matches(block: Windows, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of every occurrence in a step of documents."""
    docs, starts, found = [], [], []
    bounds = lambda place: np.searchsorted(at, place, "right") - 1
    for k in block.sizes:
        place, which = places(block.prefix, block.mask, shingles(words, k))
        if not len(place):
            continue
        n = block.at[which + 1] - block.at[which]
        entry = np.repeat(block.at[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = block.order[entry]
        start = np.repeat(place, n) - block.offset[entry]
        doc = bounds(np.repeat(place, n))
        fits = (start >= at[doc]) & (start + block.size[window] <= at[doc + 1])
        window, start, doc = window[fits], start[fits], doc[fits]
        good = np.ones(len(window), bool)
        for o in range(int(block.size[window].max()) if len(window) else 0):
            inside = good & (o < block.size[window])
            good[inside] = words[start[inside] + o] == block.words[block.first[window[inside]] + o]
        docs.append(doc[good])
        starts.append(start[good])
        found.append(window[good])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, starts, found))


def scan(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs with n_words, spans (first word, word after the last, ...) and items (ids as strings) added, in place of columns of these names; options as in ``_scanned``."""
    named = {"__n": "n_words", "__spans": "spans", "__items": "items"}
    return _scanned(docs.drop(*(n for n in named.values() if n != options.get("text", "text"))), items, **options).withColumnsRenamed(named)


def _scanned(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns of ``scan`` under names that clash with none."""
    rows = written(items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t")).filter("t IS NOT NULL").distinct(), "decontamination-items")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("k"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    if total > block_bytes:
        return _joined(docs, rows, text, window, shingle)
    got = rows.orderBy("k", "t").toArrow()
    block = windows_of(got.column("k").to_pylist(), got.column("t").to_pylist(), window, shingle)
    block.choose(corpus_counts(docs, text, block.tokens, block.sizes))
    out = docs.withColumns({"__n": F.lit(0).cast("long"), "__spans": F.array().cast("array<int>"), "__items": F.array().cast("array<string>")})
    return _marked(out, docs.sparkSession.sparkContext.broadcast(block), docs.columns.index(text))


def item_mask(rows: DataFrame, window: int, shingle: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """Buckets of all shingles of the items, and the sizes of shingles in use; the driver gets packed bits of a fixed size."""

    def run(batches):
        mask, sizes = np.zeros(1 << MASK_BITS, bool), set()
        for batch in batches:
            for words in item_words(batch.column(1)):
                if len(words):
                    k = min(shingle, window, len(words))
                    sizes.add(k)
                    mask[(shingles(words, k) >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
        for i, part in enumerate(np.packbits(mask).reshape(16, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], ["slice", "bits", "sizes"])

    def either(batches):
        found: dict[int, np.ndarray] = {}
        sizes: set[int] = set()
        for batch in batches:
            for i, bits, own in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found[i] = found.get(i, np.uint8(0)) | np.frombuffer(bits, np.uint8)
                sizes |= set(own)
        for i, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], ["slice", "bits", "sizes"])

    kind = "slice int, bits binary, sizes array<int>"
    bits, sizes = np.zeros((16, (1 << MASK_BITS) // 128), np.uint8), set()
    for r in rows.select("k", "t").mapInArrow(lean(run), kind).repartition(16, "slice").mapInArrow(lean(either), kind).collect():
        bits[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
        sizes |= set(r["sizes"])
    return np.unpackbits(bits.reshape(-1)).astype(bool), tuple(sorted(sizes))


def item_words(column: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(column)
    begins, ends, at = word_spans(data, offsets, ALNUM)
    words = word_hashes(data, begins, ends)
    return [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _joined(docs: DataFrame, rows: DataFrame, text: str, window: int, shingle: int) -> DataFrame:
    """The distributed form of ``_scanned`` for rows(k, t) of any size; documents are told apart by their text's digest."""
    shared = docs.sparkSession.sparkContext.broadcast(item_mask(rows, window, shingle))
    digest_of = F.unhex(F.sha1(F.coalesce(text, F.lit("")).cast("binary")))

    def emit(batches):  # (digest, token, place, before, around) of every shingle that may be an item's
        mask, ks = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                own = data[offsets[i] : offsets[j]]
                begins, ends, at = word_spans(own, offsets[i : j + 1] - offsets[i], ALNUM)
                words = word_hashes(own, begins, ends)
                for k in ks:
                    token = shingles(words, k)
                    place = np.flatnonzero(mask[(token >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
                    doc = np.searchsorted(at, place, "right") - 1
                    inside = place + k <= at[doc + 1]
                    place, doc = place[inside], doc[inside]
                    low, high = np.maximum(at[doc], place - (window - k)), np.minimum(at[doc + 1], place + window)
                    around = [words[a:b].tobytes() for a, b in zip(low, high, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), pa.array(token[place].view(np.int64)), pa.array(place - at[doc]), pa.array((place - low).astype(np.int32)), pa.array(around, pa.binary())], ["digest", "token", "place", "before", "around"])

    def cut(batches):  # (k, win, size, token, offset) of every shingle of every window
        for batch in batches:
            ids, wins, sizes, tokens, offsets = [], [], [], [], []
            for key, words in zip(batch.column(0).to_pylist(), item_words(batch.column(1)), strict=True):
                n = min(window, len(words))
                k = min(shingle, n)
                own = shingles(words, k).view(np.int64) if n else []
                for start in range(len(words) - n + 1 if n else 0):
                    for o in range(n - k + 1):
                        ids.append(key)
                        wins.append(words[start : start + n].tobytes())
                        sizes.append(n)
                        tokens.append(int(own[start + o]))
                        offsets.append(o)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.int64()), pa.array(offsets, pa.int32())], ["k", "win", "size", "token", "offset"])

    seen = written(docs.select(digest_of.alias("digest"), F.col(text).alias("t")).mapInArrow(lean(emit), "digest binary, token long, place long, before int, around binary"), "decontamination-seen")
    windows = written(rows.select("k", "t").mapInArrow(lean(cut), "k string, win binary, size int, token long, offset int"), "decontamination-windows")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    tried = written(windows.select("win", "size", "token", "offset").distinct(), "decontamination-tried")
    rarest = spread(tried, counts, ["token"]).groupBy("win", "size").agg(F.min(F.struct("n", "token", "offset")).alias("s")).select("win", "size", "s.token", "s.offset")
    near = spread(seen, rarest, ["token"]).filter((F.col("before") >= F.col("offset")) & F.expr("substring(around, (before - offset) * 8 + 1, size * 8) = win"))
    hits = written(near.select("digest", (F.col("place") - F.col("offset")).cast("int").alias("start"), "size", "win").distinct(), "decontamination-hits")
    spans = hits.groupBy("digest").agg(F.flatten(F.array_sort(F.collect_list(F.array("start", F.col("start") + F.col("size"))))).alias("__spans"))
    owners = windows.filter("k IS NOT NULL").select("win", "k").distinct()
    ids = spread(hits.select("digest", "win").distinct().transform(lambda d: written(d, "decontamination-found")), owners, ["win"]).groupBy("digest").agg(F.array_sort(F.collect_set("k")).alias("__items"))
    found = written(spans.join(ids, "digest", "left"), "decontamination-spans")
    counted = docs.withColumns({"__digest": digest_of, "__n": F.lit(0).cast("long")})
    marked = counted.join(checked(found.withColumnRenamed("digest", "__digest"), 1000), "__digest", "left").drop("__digest")
    none = lambda kind: F.array().cast(kind)
    return _numbered(marked.withColumns({"__spans": F.coalesce("__spans", none("array<int>")), "__items": F.coalesce("__items", none("array<string>"))}).select(*docs.columns, "__n", "__spans", "__items"), docs.columns.index(text))


def _numbered(rows: DataFrame, text_at: int) -> DataFrame:
    """rows with the number of the text's words in the last column but two."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            counts = [np.diff(word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)[2]) for i, j in steps(offsets)]
            columns = [*batch.columns[:-3], pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64()), *batch.columns[-2:]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(lean(run), rows.schema)


def _marked(rows: DataFrame, shared, text_at: int) -> DataFrame:
    def run(batches):
        block = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            counts, spans, items = [], batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, j in steps(offsets):
                own = data[offsets[i] : offsets[j]]
                begins, ends, at = word_spans(own, offsets[i : j + 1] - offsets[i], ALNUM)
                counts.append(np.diff(at))
                doc, start, window = matches(block, word_hashes(own, begins, ends), at)
                local = start - at[doc]
                by = np.argsort(doc, kind="stable")
                doc, window, local = doc[by], window[by], local[by]
                for d in np.unique(doc):
                    mine = slice(np.searchsorted(doc, d), np.searchsorted(doc, d, "right"))
                    spans[i + d] = (spans[i + d] or []) + np.stack([local[mine], local[mine] + block.size[window[mine]]], axis=1).reshape(-1).tolist()
                    new = {block.ids[x] for x in np.unique(block.item[window[mine]])} - {None}
                    items[i + d] = sorted(set(items[i + d] or []) | new)
            columns = [*batch.columns[:-3], pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(lean(run), rows.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and items; spans and the text go."""

    def covered(spans: list[int]) -> int:
        n, end = 0, 0
        for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
            n += max(0, b - max(a, end))
            end = max(end, b)
        return n

    def run(batches):
        for batch in batches:
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = [covered(s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = dict(scanned.dtypes)["doc_id"]
    return scanned.select("doc_id", "n_words", "spans", "items").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


ORACLE = """
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(10, len(w)) AS size, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS run
  FROM item_words, LATERAL unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(s) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS run
  FROM doc_words, sizes, LATERAL unnest(generate_series(1, len(w) - size + 1)) AS t(s) WHERE len(w) >= size
),
found AS (SELECT r.doc_id, r.s, r.size, x.item_id FROM runs r JOIN windows x ON r.size = x.size AND r.run = x.run),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go, repeated rows alike; all columns stay, whatever their names.

    Null and empty texts have no words and stay; very long ones are read whole. An empty table or benchmark drops nothing.
    """
    return _scanned(docs, table(spark, sf_dir, "benchmark")).filter(F.size("__spans") == 0).select(*docs.columns)
