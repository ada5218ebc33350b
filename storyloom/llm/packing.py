"""Best-fit packing of tokenised documents into sequences of a fixed size, bulk-synchronously.

``tokenize`` gives each document's ids (byte-pair vocabulary file, then the id that ends a document), cut into
pieces of the sequence's size where a document is longer; the first piece may be shorter. Each distinct
pre-token is encoded once and kept in a cache of bounded size for the time of a partition, which gives the same ids
as encoding the whole text. A text that holds one of the vocabulary's special strings, or characters beyond the plain
alphabet, goes whole through the vocabulary file.

``pack`` places pieces by rounds. A round range-sorts the pieces still to place and the gaps of open
sequences, both by size, largest first. One sweep over each range partition gives each piece the smallest gap
that still takes it (its successor in the order); what stays unmatched in a partition meets the gaps left by
the partitions before it, by rank, so that no two pieces claim a gap. Gaps shrink, and the next round follows.
Pieces larger than every gap open sequences: all of more than half a sequence, and of the rest as many, the
largest first, as their total length needs. Very short pieces travel in bundles, so the number of rounds
doesn't grow with the number of pieces in a sequence. Between rounds the driver sees counts by length (at most
``size`` rows) and by partition, never pieces.

Null and empty texts are a document of the end id alone. Very long texts are tokenised whole. Equal lengths are
ordered by a row number. Repeated rows are packed each for itself. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from functools import cached_property, lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import lean, table, token_ranks, utf8, written

SIZE = 1024
END_ID = 2
#: Pieces of at most this many ids travel in bundles of at most twice that.
SHORT = 64
#: Bytes of pre-tokens and their ids that a worker keeps during a partition; the cache starts anew beyond.
CACHE_BYTES = 24_000_000
#: What a cached pre-token takes besides.
ENTRY_BYTES = 120
STEP_CHARS = 1_000_000
ROWS_A_PARTITION = 40_000
#: The largest row number beside a document's place; bundles take numbers from here.
BUNDLES = 1 << 61


def _alphabet() -> tuple[str, str, str, str]:
    """Letters, numbers, blanks and all characters below U+0530 whose classes every Unicode version shares."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": [], "": []}
    for code in range(0x530):
        c, kind = chr(code), unicodedata.category(chr(code))
        if kind in ("Cn", "Cc") and c not in "\t\n\r\x0b\x0c" or c in "\x85":
            continue
        kinds[kind[0] if kind[0] in "LN" else "Z" if kind[0] == "Z" or kind == "Cc" else ""].append(c)
    text = {k: "".join(re.escape(c) for c in v) for k, v in kinds.items()}
    return text["L"], text["N"], text["Z"], text["L"] + text["N"] + text["Z"] + text[""]


@lru_cache(maxsize=1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """The vocabulary's pre-token pattern for texts of the plain alphabet, and a test for such texts."""
    letter, number, blank, every = _alphabet()
    parts = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    return re.compile(parts), re.compile(f"[^{every}]")


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    New pre-tokens go through the same vocabulary's ranks, which is the faster reader of the two; texts beyond the
    plain alphabet go whole through the vocabulary file. Tests hold both against the file alone.
    """

    def __init__(self, path: str, ranks: str):
        self.path, self.pieces = path, token_ranks(ranks)
        self.special = special_strings(path)
        self.line_end = self.pieces.encode_ordinary("\n")[0]
        self.kept: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def tokenizer(self):
        """The vocabulary file, read when a text first needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        self.kept, self.held = {}, 0
        self.__dict__.pop("tokenizer", None)

    def keep(self, new: set[str]) -> None:
        """Encodes new pre-tokens: those that aren't blank as the lines of one text, whose line ends part the ids again."""
        lines = [w for w in new if not w.isspace()]
        ids = np.asarray(self.pieces.encode_ordinary("\n".join(lines)), "<u4")
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) == len(lines) - 1:
            raw, starts, stops = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()], (4 * ends).tolist()
            self.kept.update(zip(lines, (raw[a:b] for a, b in zip(starts, [*stops, len(raw)], strict=True)), strict=True))
            self.held += len(raw) + sum(map(len, lines)) + ENTRY_BYTES * len(lines)
            new = new.difference(lines)
        for word in new:
            self.kept[word] = own = np.asarray(self.pieces.encode_ordinary(word), "<u4").tobytes()
            self.held += len(own) + len(word) + ENTRY_BYTES

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, odd = patterns()
        if self.held > CACHE_BYTES:
            self.clear()
        plain = [not odd.search(t) and not self.special.search(t) for t in texts]
        parts = [cut.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        found = [list(map(self.kept.get, own)) for own in parts]
        gaps = [[i for i, ids in enumerate(got) if ids is None] for got in found]
        self.keep({own[i] for own, at in zip(parts, gaps, strict=True) for i in at})
        out = []
        for text, p, own, got, at in zip(texts, plain, parts, found, gaps, strict=True):
            for i in at:
                got[i] = self.kept[own[i]]
            out.append(b"".join(got) if p else np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


@lru_cache(maxsize=1)
def special_strings(path: str) -> re.Pattern:
    """The vocabulary's special strings, which are one id each wherever they stand."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    return re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")


@lru_cache(maxsize=1)
def encoder(path: str, ranks: str) -> Encoder:
    return Encoder(path, ranks)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, ranks: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every piece of every document; path and ranks are one vocabulary in both forms."""
    path, ranks = path or vocabulary(), ranks or vocabulary("byte_bpe_50k.tiktoken")
    end = np.asarray([end_id], "<u4").tobytes()
    kind = dict(docs.dtypes)[key]

    def run(batches):
        own = encoder(path, ranks)
        try:
            yield from pieces_of(own, batches)
        finally:
            own.clear()

    def pieces_of(own, batches):
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, min(batch.num_rows, int(np.searchsorted(offsets, offsets[i] + STEP_CHARS, "right")) - 1))
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, got in enumerate(own.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]), i):
                    got += end
                    n = len(got) // 4
                    first = n % size or size
                    for p, a in enumerate([0, *range(first, n, size)]):
                        b = a + size if p else first
                        at.append(k)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(got[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(np.frombuffer(got[4 * a : 4 * b], "<u4").astype(np.int32))
                columns = {"key": batch.column(0).take(pa.array(at)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)
                i = j

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), schema).withColumnRenamed("key", key)


def _sweep(batches):
    """Of one range partition, sorted by size, gaps first: the successor of each piece among the gaps not yet taken."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    part, kind, ids, sizes, used = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in range(5))
    n = len(ids)
    mate, rank, open_gaps, left = np.full(n, -1, np.int64), np.full(n, -1, np.int64), [], 0
    for i, is_piece in enumerate(kind.tolist()):
        if not is_piece:
            open_gaps.append(i)
        elif open_gaps:
            g = open_gaps.pop()
            mate[i], mate[g] = g, i
        else:
            rank[i] = left  # no gap of this partition takes it: the first such piece comes first
            left += 1
    for r, g in enumerate(reversed(open_gaps)):
        rank[g] = r  # the smallest gap left comes first
    new_sizes, new_used, seq = sizes.copy(), used.copy(), np.full(n, -1, np.int64)
    taken = np.flatnonzero((mate >= 0) & (kind == 1))
    gaps = mate[taken]
    seq[taken], new_used[taken] = ids[gaps], used[gaps]
    new_sizes[gaps] = sizes[gaps] - sizes[taken]
    new_used[gaps] = used[gaps] + sizes[taken]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, kind, ids, new_sizes, new_used, seq, rank)], ["part", "kind", "id", "size", "used", "seq", "rank"])


SWEPT = "part int, kind int, id long, size int, used int, seq long, rank long"


#: kind 0: a gap (id: its sequence, size: what is free, used: what is not); 1: a piece to place; 2: a placed piece (seq, used: its offset).
STATE = ["kind", "id", "size", "used", "seq"]


def _histogram(state: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Numbers of gaps and of pieces to place, by size."""
    found: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in state.filter("kind < 2").groupBy("kind", "size").count().collect():
        found[r["kind"]][r["size"]] = r["count"]
    return found


def _round(state: DataFrame, rows: int) -> DataFrame:
    """One sweep: the state after it, with the pieces that it placed."""
    spark = state.sparkSession
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    dealt = state.repartitionByRange(max(1, ceil(rows / ROWS_A_PARTITION)), *order).sortWithinPartitions(*order)
    swept = written(dealt.select(F.spark_partition_id().alias("part"), "kind", "id", "size", "used").mapInArrow(lean(_sweep), SWEPT), "packing-sweep")
    over = sorted((r["part"], r["pieces"], r["spaces"]) for r in swept.filter("rank >= 0").groupBy("part").agg(F.sum("kind").alias("pieces"), F.sum(1 - F.col("kind")).alias("spaces")).collect())
    stack, spans = [], []  # (part, first free rank, gaps left) with the smallest gaps on top
    for part, n_pieces, n_spaces in over:
        at = 0
        while stack and at < n_pieces:
            own, first, n = stack.pop()
            take = min(n, n_pieces - at)
            spans.append((part, at, at + take, own, first - at))
            at += take
            if take < n:
                stack.append((own, first + take, n - take))
        if n_spaces:
            stack.append((part, 0, n_spaces))
    near = swept.select(F.when((F.col("kind") == 1) & (F.col("seq") >= 0), 2).otherwise(F.col("kind")).alias("kind"), "id", "size", "used", "seq", "part", "rank")
    if not spans:
        return written(near.select(*STATE), "packing-state")
    # at most two rows for each partition
    links = spark.createDataFrame(spans, "part int, low long, high long, own int, shift long")
    asks = F.broadcast(links.select(F.col("part").alias("p"), "low", "high", F.col("own"), "shift"))
    takes = F.broadcast(links.select(F.col("own").alias("p"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high")))
    within = (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    pieces, spaces = near.filter("kind = 1").join(asks, within, "left"), near.filter("kind = 0").join(takes, within, "left")
    asking = pieces.filter("p IS NOT NULL").select("id", "size", "own", (F.col("rank") + F.col("shift")).alias("rank"))
    free = spaces.filter("p IS NOT NULL").select(F.col("part").alias("own"), "rank", F.col("id").alias("gap"), F.col("size").alias("room"), F.col("used").alias("at"))
    both = asking.join(free, ["own", "rank"])
    placed = F.struct(F.lit(2).alias("kind"), F.col("id"), F.col("size"), F.col("at").alias("used"), F.col("gap").alias("seq"))
    shrunk = F.struct(F.lit(0).alias("kind"), F.col("gap").alias("id"), (F.col("room") - F.col("size")).cast("int").alias("size"), (F.col("at") + F.col("size")).cast("int").alias("used"), F.lit(-1).cast("long").alias("seq"))
    far = both.select(F.inline(F.array(placed, shrunk)))
    still = pieces.filter("p IS NULL").select(*STATE).unionByName(spaces.filter("p IS NULL").select(*STATE)).unionByName(near.filter("kind = 2").select(*STATE))
    return written(still.unionByName(far), "packing-state")


def _bundles(short: DataFrame, size: int, rows: int) -> DataFrame:
    """(bundle, id, at, total): short pieces of like length, joined up to ``size`` ids; a bundle lies within a range partition."""

    def run(batches):
        part, ids, lengths = ([], [], [])
        for b in batches:
            part.append(b.column(0).to_numpy())
            ids.append(b.column(1).to_numpy())
            lengths.append(b.column(2).to_numpy())
        if not ids or not sum(map(len, ids)):
            return
        part, ids, lengths = np.concatenate(part), np.concatenate(ids), np.concatenate(lengths)
        bundle, at, total, number, used = [], [], {}, 0, 0
        for n in lengths.tolist():
            if used + n > size:
                number, used = number + 1, 0
            bundle.append(number)
            at.append(used)
            used += n
            total[number] = used
        base = BUNDLES + int(part[0]) * (1 << 40)
        yield pa.RecordBatch.from_arrays([pa.array(base + np.array(bundle, np.int64)), pa.array(ids), pa.array(np.array(at, np.int32)), pa.array(np.array([total[b] for b in bundle], np.int32))], ["bundle", "id", "at", "total"])

    order = [F.desc("length"), F.asc("id")]
    return short.repartitionByRange(max(1, ceil(rows / ROWS_A_PARTITION)), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "length").mapInArrow(lean(run), "bundle long, id long, at int, total int")


def _openings(state: DataFrame, stuck: dict[int, int], size: int) -> tuple[Column, set[int]]:
    """Which pieces open a sequence, and the lengths of which all do.

    All of more than half a sequence; if there are none, as many of the others, the largest first, as their total length needs.
    """
    if big := {n for n in stuck if 2 * n > size}:
        return F.col("size").isin(sorted(big)), big
    need, whole, part = max(1, ceil(sum(n * c for n, c in stuck.items()) / size)), set(), F.lit(False)
    for n in sorted(stuck, reverse=True):
        if need <= 0:
            break
        if need < stuck[n]:  # part of a class, by hash, but at least one
            one = state.filter((F.col("kind") == 1) & (F.col("size") == n)).agg(F.min("id")).first()[0]
            part = (F.col("size") == n) & ((F.col("id") == one) | (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(need / stuck[n] * 1_000_003)))
        else:
            whole.add(n)
        need -= stuck[n]
    return F.col("size").isin(sorted(whole)) | part, whole


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, sequence_id, offset) of every piece of ``pieces(id, length)``; ids are unique, below 2^61, lengths 1 to size."""
    every = pieces.select("id", F.col("length").cast("int").alias("size"))
    placed = [every.filter(F.col("size") == size).select("id", F.col("id").alias("seq"), F.lit(0).alias("at"))]
    left, members = every.filter(F.col("size") < size), None
    if short := every.filter(F.col("size") <= SHORT).count():
        members = written(_bundles(every.filter(F.col("size") <= SHORT).withColumnRenamed("size", "length"), 2 * SHORT, short), "packing-bundles")
        left = left.filter(F.col("size") > SHORT).unionByName(members.select(F.col("bundle").alias("id"), F.col("total").alias("size")).distinct())
    state = left.select(F.lit(1).alias("kind"), "id", "size", F.lit(0).alias("used"), F.lit(-1).cast("long").alias("seq"))
    rooms, histogram = _histogram(state)
    while histogram:
        stuck = {n: c for n, c in histogram.items() if n > max(rooms, default=0)}
        if stuck:
            opens, whole = _openings(state, stuck, size)
            opens = (F.col("kind") == 1) & opens
            placed.append(state.filter(opens).select("id", F.col("id").alias("seq"), F.lit(0).alias("at")))
            gap = F.struct(F.lit(0).alias("kind"), F.col("id"), (F.lit(size) - F.col("size")).cast("int").alias("size"), F.col("size").alias("used"), F.col("seq"))
            state = state.select(F.inline(F.array(F.when(opens, gap).otherwise(F.struct(*STATE)))))
            rooms = rooms | {size - n: rooms.get(size - n, 0) + histogram[n] for n in stuck}
            histogram = {n: c for n, c in histogram.items() if n not in whole}
            if not histogram:
                break
        least = min(histogram)
        state = state.filter((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("size") >= least)))
        state = _round(state, sum(histogram.values()) + sum(c for n, c in rooms.items() if n >= least))
        placed.append(state.filter("kind = 2").select("id", "seq", F.col("used").alias("at")))
        rooms, histogram = _histogram(state)
    found = placed[0]
    for part in placed[1:]:
        found = found.unionByName(part)
    if members is not None:
        inner = members.withColumnRenamed("at", "within").withColumnRenamed("id", "member")
        whole = found.filter(F.col("id") < BUNDLES)
        found = whole.unionByName(found.filter(F.col("id") >= BUNDLES).join(inner, F.col("id") == F.col("bundle")).select(F.col("member").alias("id"), "seq", (F.col("at") + F.col("within")).alias("at")))
    return found.select("id", F.col("seq").alias("sequence_id"), F.col("at").cast("long").alias("offset"))


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    pieces = written(tokenize(docs, text, key, size=size).withColumn("id", F.monotonically_increasing_id()), "packing-pieces")
    return pieces.join(pack(pieces.select("id", "length"), size), "id").drop("id")


def sequences(pieces: DataFrame, ids: str | Column = "ids") -> DataFrame:
    """(sequence_id, ids) of placed pieces that carry their ids; a sequence holds at most its size."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids") if isinstance(ids, str) else ids.alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: where each kept document's ids lie in the training sequences.

    Null and empty texts are the end id alone, very long ones several pieces, repeated rows are packed each for itself,
    an empty table gives no rows. Columns other than doc_id and text end here, whatever their names.
    """
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
