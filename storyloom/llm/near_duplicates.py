"""N-gram Jaccard join: a grouped prefix join of the documents' shingle sets, and the components of its links.

1. Sets. Every text becomes the set of its distinct word shingles, as 64-bit hashes. One pass writes each
   set's size and 128-bit fingerprint, and a sketch of the corpus: how many sets hold a shingle of each of 2^20
   hash buckets (a table of fixed size). Equal sets collapse to the smallest id, their representative.
2. Prefixes. All sets are ordered by (bucket's count, hash), rare shingles first. Two sets that link must share
   one of their first n - ceil(t n) + 1 shingles. Sets with identical prefixes and size collapse to one group;
   only groups enter the index.
3. Group pairs. A shingle's groups are cut where their sizes, in order, are too far apart for a link; a group left alone
   is dropped there, and so is one that by size, place and held shingles can't link with another of them. A shingle of several prefixes has a centre, the group where it stands first. Each group of the
   shingle is paired with the centre; size and overlap bounds filter the pairs (of the two sets, a prefix shingle
   that no other prefix holds can't be in the overlap if it stands in the prefix that ends first: the other set
   would have it in its own prefix; of the other set nothing is taken off). Groups expand to members, and exact sets
   decide. A second round does the same with a second centre: of each shingle the first group, and of each group the
   first member, that the first centre's component doesn't hold. Two that are in one component need no further pair:
   all that is missing is a link they already have. What is then still outside the first centre's component meets
   those of its shingle, or group, that are in other components, and is decided alike. So every pair that the prefix
   filter admits is either decided or within one component, and no group emits pairs of one component.
4. Components by label propagation with pointer jumping, as joins.

Texts are read for the sketch, for the prefixes, and, of the documents in pairs alone, once for either side of a pair;
the two texts of a pair meet, and their sorted hash sets decide. Joins deal hot keys (copies of one text, shingles, centres, hubs, large components) over tasks:
``spread`` counts keys first and splits those beyond half a partition's fair share. What is broadcast is of a fixed
size (the sketch), has at most twice as many rows as there are partitions (hot keys), or fits ``BROADCAST_BYTES``
by its count, with a shuffled join beyond it.

Null, empty and blank texts have an empty set and link with nothing. A text of fewer words than a shingle is
one shingle. Very long texts are read whole. Repeated rows of an id with one text get equal results; different
texts under one id count as linked. Rows without an id have the size of their set and no component. Ties between
centres fall by a hash of the id. An empty table gives no rows. Only the named columns are read, so others may have
any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import MULTIPLIER, NOT_SPACE, checked, few, hot_keys, lean, mix, spread, steps, table, utf8, word_hashes, word_spans, written

#: The query's shingle size; its links have 100 * intersection >= PERCENT * union.
WORDS = 4
PERCENT = 85
#: The pipeline stage's.
STAGE_WORDS = 5
STAGE_PERCENT = 80
SKETCH_BITS = 20
SLICES = 16
#: A shingle of so many groups has each of them tested against the others before the index is written.
TESTED = 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, sorted by both."""
    begins, ends, at = word_spans(data, offsets, NOT_SPACE)
    words = word_hashes(data, begins, ends)
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)
    starts, hashes = [], []
    if len(words):
        full = np.flatnonzero(np.arange(len(words)) + k <= at[1:][doc])
        value = np.full(len(full), np.uint64(k))
        for o in range(k):
            value = value * MULTIPLIER + words[full + o]
        starts.append(doc[full])
        hashes.append(mix(value))
        for n in range(1, k):
            few = np.flatnonzero(counts == n)
            value = np.full(len(few), np.uint64(n))
            for o in range(n):
                value = value * MULTIPLIER + words[at[:-1][few] + o]
            starts.append(few)
            hashes.append(mix(value))
    own = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    return own[fresh], value[fresh]


def summed(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each of n documents; own is sorted."""
    out = np.zeros(n, np.uint64)
    if len(own):
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] = np.add.reduceat(values, first)
    return out.view(np.int64)


def features(docs: DataFrame, text: str, key: str, words: int = WORDS) -> DataFrame:
    """Rows of sets (key, n, fp1, fp2) and, with a slice's number instead of a key, of the sketch."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        counts, key_type = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            data, offsets = utf8(batch.column(1))
            sizes, one, two = [], [], []
            for i, j in steps(offsets):
                own, value = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                np.add.at(counts, (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                sizes.append(np.bincount(own, minlength=j - i))
                one.append(summed(mix(value + np.uint64(1)), own, j - i))
                two.append(summed(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), own, j - i))
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), flat(sizes), flat(one), flat(two), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], ["key", "n", "fp1", "fp2", "slice", "counts"])
        if key_type is not None:
            blobs = [zlib.compress(part.astype("<u4").tobytes(), 1) for part in counts.reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, key_type), none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["key", "n", "fp1", "fp2", "slice", "counts"])

    return written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, n long, fp1 long, fp2 long, slice int, counts binary"), "jaccard-sets")


def sketch(rows: DataFrame) -> np.ndarray:
    """The order's class of each bucket: its count, as the 16 leading bits of a float; 2^20 numbers, whatever the corpus."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
                total[s] = total[s] + part if s in total else part
        for s, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    got = rows.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(lean(run), "slice int, counts binary").collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for r in got:
        counts[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return (counts.reshape(-1).astype(np.float32).view(np.uint32) >> np.uint32(15)).astype(np.uint16)


def prefix_size(n, percent: int = PERCENT):
    """Shingles of which two linked sets share one: n - ceil(t n) + 1, at most n."""
    return n - (n * percent + 99) // 100 + 1


def prefixes(docs: DataFrame, order: np.ndarray, text: str, key: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n, whole, tokens): the prefix in the order's sequence; a token is the order's class and 48 bits of the hash."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        classes = shared.value.astype(np.uint64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                own, value = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                token = (classes[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(48)) | (value & np.uint64((1 << 48) - 1))
                by = np.lexsort((token, own))
                own, token = own[by], token[by]
                n = np.bincount(own, minlength=j - i)
                first = np.cumsum(n) - n
                keep = prefix_size(n, percent)
                inside = np.arange(len(own)) - first[own] < keep[own]
                own, token = own[inside], token[inside]
                ends = np.r_[0, np.cumsum(np.minimum(keep, n))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(summed(mix(token), own, j - i)), lists], ["key", "n", "whole", "tokens"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, n long, whole long, tokens array<long>")


def texts_of(docs: DataFrame, ids: DataFrame, text: str, key: str, repeated: bool) -> DataFrame:
    """(id, text) of the documents with the given ids."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(checked(ids), "id", "left_semi")
    return texts.dropDuplicates(["id", "text"]) if repeated else texts


def decided(docs: DataFrame, pairs: DataFrame, text: str, key: str, words: int = WORDS, percent: int = PERCENT, repeated: bool = True) -> DataFrame:
    """Those of pairs(a, b) whose sets link, by exact counts; many pairs may share their b."""
    kind = dict(docs.dtypes)[key]
    kept = pairs.groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")  # of two directions one
    pairs = written(kept, "jaccard-kept")
    # each side carries only the texts that stand on it: an exchange packs text to less than half of what hashes, which are random, take
    side = lambda c: texts_of(docs, written(pairs.select(F.col(c).alias("id")).distinct(), "jaccard-ids"), text, key, repeated).withColumnsRenamed({"id": c, "text": f"text_{c}"})
    joined = spread(pairs.join(side("a"), "a"), side("b"), ["b"], counted=pairs).select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            (data_a, at_a), (data_b, at_b) = utf8(batch.column(2)), utf8(batch.column(3))
            for i, j in steps(at_a + at_b):
                rows, values = zip(*(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words) for data, at in ((data_a, at_a), (data_b, at_b))), strict=True)
                row, value = np.concatenate(rows), np.concatenate(values)
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=j - i)
                linked[i:j] = (both > 0) & (100 * both >= percent * (np.bincount(row, minlength=j - i) - both))
            yield batch.filter(pa.array(linked)).select(["a", "b"])

    return written(joined.mapInArrow(lean(run), f"a {kind}, b {kind}").distinct(), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b); a component is named by its smallest node."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "jaccard-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "jaccard-labels")
    while True:
        near = spread(edges, labels.select(F.col("node").alias("b"), "component"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(spread(lower, jump, ["component"], "left", counted=labels).select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "jaccard-labels")
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def _placed(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(gid, node, component) of every member of every group; a node without links is its own component."""
    return written(nodes.join(known, "node", "left").select("gid", "node", F.coalesce("component", "node").alias("component")), "jaccard-nodes")


def _fits(n: str, m: str, overlap, percent: int):
    """Whether sets of so many shingles can link with an overlap of at most so many."""
    return ((100 + percent) * overlap >= percent * (F.col(n) + F.col(m))) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _starred(live: DataFrame, bounds: DataFrame, members: DataFrame, inner: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all nodes of live(gid, centre), centre a group, and of inner(a, b), that may link."""
    other = bounds.withColumnsRenamed({"gid": "centre", "n": "m", "end": "stop", "most": "top"})
    drawn = written(live.filter("gid <> centre").select("gid", "centre").distinct().join(bounds, "gid"), "jaccard-drawn")
    overlap = F.least(F.when(F.col("end") <= F.col("stop"), F.col("most")).otherwise(F.col("n")), F.when(F.col("stop") <= F.col("end"), F.col("top")).otherwise(F.col("m")))
    star = written(spread(drawn, other, ["centre"]).filter(_fits("n", "m", overlap, percent)).select("gid", "centre"), "jaccard-star")
    grown = spread(members, star, ["gid"]).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return star.select(F.col("gid").alias("a"), F.col("centre").alias("b")).unionByName(grown).unionByName(inner).filter("a <> b").distinct()


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row, by shingles of so many words and links of so many per cent."""
    rows = features(docs, text, key, words)
    order = sketch(rows)
    sets = rows.filter("slice IS NULL").select("key", "n", "fp1", "fp2")
    full = sets.filter("n > 0 AND key IS NOT NULL")
    repeated = full.count() > full.select("key").distinct().count()
    alike = written(full.groupBy("fp1", "fp2", "n").agg(F.min("key").alias("node")), "jaccard-alike")
    named = written(spread(full, alike, ["fp1", "fp2", "n"]).select("key", "n", "node"), "jaccard-named")
    copies = written(named.filter("key <> node").select("key").distinct(), "jaccard-copies")

    distinct = docs.filter(F.col(key).isNotNull())
    early = few(copies)  # else narrow prefixes are joined, not texts
    if early:
        distinct = distinct.join(F.broadcast(copies.withColumnRenamed("key", key)), key, "left_anti")
    prefix = prefixes(distinct, order, text, key, words, percent)
    prefix = prefix if early else prefix.join(copies, "key", "left_anti")
    prefix = written(prefix.dropDuplicates(["key", "n", "whole"]) if repeated else prefix, "jaccard-prefixes")
    groups = written(prefix.groupBy("n", "whole").agg(F.min("key").alias("gid"), F.count("*").alias("size")).filter("size > 1").select("n", "whole", "gid"), "jaccard-groups")
    members = written(spread(prefix.select("key", "n", "whole"), groups, ["n", "whole"]).filter("key <> gid").select("gid", F.col("key").alias("node")).distinct(), "jaccard-members")
    heads = prefix.join(checked(members.select(F.col("node").alias("key"))), "key", "left_anti")
    # end: the prefix's last token in the order of the tokens, which are unsigned
    end = F.get("tokens", F.size("tokens") - 1).bitwiseXOR(F.lit(-(1 << 63)))
    heads = heads.select(F.col("key").alias("gid"), "n", end.alias("end"), "tokens")
    live = written(_index(heads, percent), "jaccard-index")
    bounds = written(live.groupBy("gid").agg(*(F.max(c).alias(c) for c in ("n", "end", "most"))), "jaccard-bounds")
    within = members.select(F.col("node").alias("a"), F.col("gid").alias("b"))
    pairs = written(_starred(live, bounds, members, within, percent), "jaccard-pairs")
    links = decided(docs, pairs, text, key, words, percent, repeated)
    known = components(links)

    # the second round: of each shingle, and of each group, what the first centre's component doesn't hold has a centre of its own
    nodes = written(live.select("gid").distinct().select("gid", F.col("gid").alias("node")).unionByName(members), "jaccard-members")
    placed = _placed(nodes, known)
    table_ = _open_groups(live, placed)
    seconds = table_.filter("minor").groupBy("token").agg(F.min_by("gid", F.struct(F.xxhash64("gid"), "gid")).alias("second"))
    own = placed.filter("gid = node").select("gid", F.col("component").alias("of_gid"))
    lost = spread(placed, own, ["gid"]).filter("component <> of_gid")
    chosen = written(lost.groupBy("gid").agg(F.min("node").alias("second")), "jaccard-inner")
    inner = spread(placed, chosen, ["gid"]).select(F.col("node").alias("a"), F.col("second").alias("b"))
    again = _starred(spread(table_.select("token", "gid"), seconds, ["token"]).select("gid", F.col("second").alias("centre")), bounds, members, inner, percent)
    again = written(_untried(again, pairs), "jaccard-again")
    if again.limit(1).count():
        links = links.unionByName(decided(docs, again, text, key, words, percent, repeated))
        known = components(links)
        placed = _placed(nodes, known)
        pairs = pairs.unionByName(again)

    rest = written(_untried(_rest(_open_groups(live, placed), placed, chosen, percent), pairs), "jaccard-rest")
    if rest.limit(1).count():
        known = components(links.unionByName(decided(docs, rest, text, key, words, percent, repeated)))
    empty = sets.filter("n = 0 OR key IS NULL").select("key", "n", F.col("key").alias("node"))
    final = spread(named, known, ["node"], "left").select("key", "n", "node", "component").unionByName(empty.withColumn("component", F.col("key")))
    return final.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def _reach(n, end, reach, left, m, stop, far, rest, percent: int):
    """Whether sets of n and m shingles can link if a given shingle is the first that their prefixes share (for one of theirs it is).

    Of the prefix that ends first, shingles before it or that nothing else holds aren't in the overlap: it has at most
    ``reach`` (``far``); the other set has ``left`` (``rest``) shingles from this one on.
    """
    overlap = F.least(F.when(end <= stop, reach).otherwise(left), F.when(stop <= end, far).otherwise(rest))
    return ((100 + percent) * overlap >= percent * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _index(heads: DataFrame, percent: int) -> DataFrame:
    """(token, gid, n, end, most, pos, rank, centre) of the shingles over which two groups may link; the centre is the group where the shingle stands first.

    One exchange by token carries all prefixes, as narrow rows. A token's groups in order of their sizes fall into runs,
    where a size is too small for the next: no link crosses such a gap, so each run counts as a token of its own (named by
    its hash), and a group that is alone in its run is dropped. Then the bounds of each group are known (``most``: what its
    overlap can be with a group whose prefix doesn't end before its own, its size less the prefix shingles that nothing
    else holds; ``rank``: its shingles before this one that others hold too), and a second exchange keeps of a token's
    groups those that can link with another one of it, if it is the first that they share. Tokens of more than ``TESTED``
    groups keep all of theirs.

    Tokens of so many groups that they would fill a task are left out of both exchanges: there are at most twice as many
    as partitions, so their centres are broadcast. Only classes of the order that stand for so many sets can hold such a
    token, so only those are counted.
    """
    spark = heads.sparkSession
    rows = heads.select("gid", "n", F.posexplode("tokens").alias("pos", "token")).select("gid", (F.shiftleft("n", 32) + F.col("pos")).alias("at"), "token")
    fair = (heads.agg(F.sum(F.size("tokens"))).first()[0] or 0) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = hot_keys(rows.filter(F.shiftrightunsigned("token", 48) >= int(np.float32(fair).view(np.uint32) >> np.uint32(15))), ["token"])
    n = F.shiftright("at", 32)
    by_size = Window.partitionBy("token").orderBy("at")
    some = rows if hot is None else rows.join(F.broadcast(hot), "token", "left_anti")
    near = some.select("token", "gid", "at", F.coalesce(100 * F.lag(n).over(by_size) >= percent * n, F.lit(False)).alias("up"), F.coalesce(100 * n >= percent * F.lead(n).over(by_size), F.lit(False)).alias("down")).filter("up OR down")
    run = F.sum(F.when(F.col("up"), 0).otherwise(1)).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = near.select(F.xxhash64("token", run).alias("token"), "gid", "at", F.lit(False).alias("often"))
    if hot is not None:
        shared = shared.unionByName(rows.join(F.broadcast(hot), "token", "left_semi").select("token", "gid", "at", F.lit(True).alias("often")))
    own = Window.partitionBy("gid")
    ends = heads.groupBy("gid").agg(F.max("end").alias("end"))
    ranked = shared.select("token", "gid", n.alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), (F.row_number().over(own.orderBy("at")) - 1).alias("rank"), F.count("*").over(own).alias("held"), "often").join(ends, "gid")
    ranked = ranked.withColumn("most", F.col("n") - F.expr(f"n - (n * {percent} + 99) div 100 + 1") + F.col("held")).drop("held")
    ranked = ranked if hot is None else written(ranked, "jaccard-ranked")

    cells = ["gid", "n", "end", "most", "pos", "rank"]
    sides = lambda x: (x["n"], x["end"], x["most"] - x["rank"], x["n"] - x["pos"])
    may = lambda x, y: (x["gid"] != y["gid"]) & _reach(*sides(x), *sides(y), percent)
    tokens = ranked.filter(~F.col("often")).groupBy("token").agg(F.collect_list(F.struct(*cells)).alias("g"))
    kept = F.when(F.size("g") > TESTED, F.col("g")).otherwise(F.filter("g", lambda x: F.exists("g", lambda y: may(x, y))))
    tokens = tokens.select("token", kept.alias("g")).filter(F.size("g") > 1)
    first = lambda gid, pos: F.shiftleft(pos, 40) + F.xxhash64(gid).bitwiseAND(F.lit((1 << 40) - 1))
    centre = F.array_min(F.transform("g", lambda x: F.struct(first(x["gid"], x["pos"]).alias("first"), x["gid"].alias("gid"))))["gid"]
    out = tokens.select("token", centre.alias("centre"), F.inline("g"))
    if hot is not None:
        often = ranked.filter("often")
        centres = often.groupBy("token").agg(F.min_by("gid", first(F.col("gid"), F.col("pos"))).alias("centre"))
        out = out.unionByName(often.drop("often").join(F.broadcast(centres), "token"))
    return out


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """pairs less those tried in either direction."""
    both = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def _open_groups(live: DataFrame, placed: DataFrame) -> DataFrame:
    """live with each group's span of components and whether part of it is outside the component of the shingle's centre (then it is minor)."""
    span = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    out = written(live.join(span, "gid"), "jaccard-open")
    of_centre = placed.filter("gid = node").select(F.col("gid").alias("centre"), F.col("component").alias("of_centre"))
    held = (F.col("low") == F.col("high")) & (F.col("low") == F.col("of_centre"))
    return written(spread(out, of_centre, ["centre"]).withColumn("minor", ~held).drop("of_centre"), "jaccard-table")


def _rest(table_: DataFrame, placed: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that no centre has brought into one component."""
    table_ = table_.select("token", "gid", "n", "end", (F.col("most") - F.col("rank")).alias("reach"), (F.col("n") - F.col("pos")).alias("left"), "minor", "low", "high")
    kept = ["gid", "n", "end", "reach", "left", "minor", "low", "high"]
    one = written(table_.filter("minor"), "jaccard-minor")
    two = table_.join(checked(one.select("token").distinct()), "token", "left_semi").withColumnsRenamed({c: f"{c}_r" for c in kept})
    apart = ~((F.col("low") == F.col("high")) & (F.col("low_r") == F.col("high_r")) & (F.col("low") == F.col("low_r")))
    once = (F.col("gid") < F.col("gid_r")) | ~F.col("minor_r")
    fits = _reach(*(F.col(c) for c in ("n", "end", "reach", "left", "n_r", "end_r", "reach_r", "left_r")), percent)
    crossing = spread(one, two, ["token"]).filter((F.col("gid") != F.col("gid_r")) & apart & once & fits).select(F.col("gid").alias("g"), F.col("gid_r").alias("h"))
    crossing = written(crossing.unionByName(chosen.select(F.col("gid").alias("g"), F.col("gid").alias("h"))).distinct(), "jaccard-crossing")
    parts = written(placed.select("gid", "component").distinct(), "jaccard-parts")
    side = lambda g, c: parts.select(F.col("gid").alias(g), F.col("component").alias(c))
    halves = written(spread(crossing, side("g", "ca"), ["g"]), "jaccard-halves")
    across = written(spread(halves, side("h", "cb"), ["h"]).filter("ca <> cb"), "jaccard-across")
    node = lambda g, c, n: placed.select(F.col("gid").alias(g), F.col("component").alias(c), F.col("node").alias(n))
    left = written(spread(across, node("g", "ca", "a"), ["g", "ca"]), "jaccard-left")
    return spread(left, node("h", "cb", "b"), ["h", "cb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), words=WORDS, percent=PERCENT)


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 3], ' ') AS x FROM words, LATERAL unnest(generate_series(1, greatest(1, len(w) - 3))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM words d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest id stays; all columns stay, whatever their names.

    Null, empty and blank texts stay, as they link with nothing, and so do rows without an id; very long texts are read
    whole. Of repeated rows of an id that stays all stay. An empty table gives no rows.
    """
    found = join(docs.select("doc_id", "text"), words=STAGE_WORDS, percent=STAGE_PERCENT)
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)
