"""License scans by diagonal voting, in DataFrame operations only.

Every text's words give a rolling hash of k words at each place; a Spark join with the hashes of the template
texts (a few fixed texts, so of a fixed size) gives pairs of places. The difference of the two places is the
diagonal: a copied passage votes for one. Votes are counted by text and diagonal. Diagonals within ``NEAR`` of the
next (a word put in or left out moves the diagonal) form a band; of a band, stretches that touch are one span.

A span is verified by place: it holds the template's words that stand, at their places in order, on the span's
diagonals, in runs of k words at least. Their share of the template must reach ``MIN_SHARE``; of a span of ``LONG``
or more words, their share of the stretch of the template between its first and last such word, so that a part of
a notice counts. Scrambled words stand on no diagonal together. Licenses share sentences, so a verified span that
lies within another one's place in the text doesn't count, nor one at the same place with a smaller share. The others
give labels and a score.

Base labels come from three fixed phrases of consecutive words and always stay.

Null texts count as empty. Very long texts are scanned whole. Rows are told apart by id and text, so repeated
rows get equal results and a shared id with different texts gets each text's own. Equal votes need no order: all
spans count. Empty tables give no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.llm.license_texts import TEXTS

K = 3
NEAR = 3
MIN_VOTES = 2
MIN_SHARE = 0.6
#: Words of a span, and of its stretch of the template, from which the share counts by that stretch.
LONG = 12

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def rolling(w: Column, k: int = K) -> Column:
    """The hash of each run of k words, in order; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + o) for o in range(k)]))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def phrase_places(w: Column) -> Column:
    """(place, label) of every base phrase; only texts with the word all phrases share are looked through."""

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def stands(i: Column) -> Column:
            same = F.get(w, i) == parts[0]
            for o, part in enumerate(parts[1:], 1):
                same = same & (F.get(w, i + o) == part)
            return same

        starts = F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), stands)
        own = F.when(F.size(w) >= len(parts), starts).otherwise(F.array().cast("array<int>"))
        return F.transform(own, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))

    found = F.concat(*[places(phrase, label) for phrase, label in PHRASES.items()])
    return F.when(F.array_contains(w, "license"), found).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, t_size, t_place, hash) of the fixed texts."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEXTS)], "template int, label string, t string").select("template", "label", words(F.col("t")).alias("w"))
    return rows.select("template", "label", F.size("w").alias("t_size"), F.posexplode(rolling(F.col("w"))).alias("t_place", "hash"))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_hash, label, first, last, share) of every verified span; places are words from 0, last exclusive."""
    known = templates(docs.sparkSession)
    own = ["key", "text_hash", "template"]
    split = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("w"))
    hashes = split.select("key", "text_hash", F.posexplode(rolling(F.col("w"))).alias("place", "hash"))
    hits = hashes.join(F.broadcast(known.select("template", "t_place", "hash")), "hash").select(*own, (F.col("place") - F.col("t_place")).alias("diagonal"), "t_place")
    votes = hits.groupBy(*own, "diagonal").agg(F.collect_set("t_place").alias("t_places")).withColumns({"first": F.array_min("t_places") + F.col("diagonal"), "last": F.array_max("t_places") + F.col("diagonal") + K})
    by_diagonal = Window.partitionBy(*own).orderBy("diagonal")
    banded = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR).cast("int")).withColumn("band", F.sum(F.coalesce("new", F.lit(0))).over(by_diagonal))
    by_place = Window.partitionBy(*own, "band").orderBy("first", "diagonal")
    apart = F.col("first") > F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1)) + K + NEAR
    runs = banded.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("new").over(by_place))
    merged = runs.groupBy(*own, "band", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("t_places"))).alias("t_places"))
    sizes = F.broadcast(known.select("template", "label", "t_size").distinct())
    standing = F.size(F.array_distinct(F.flatten(F.transform("t_places", lambda p: F.sequence(p, p + (K - 1))))))
    stretch = F.array_max("t_places") + K - F.array_min("t_places")
    asked = F.when((F.col("last") - F.col("first") >= LONG) & (stretch >= LONG), stretch).otherwise(F.col("t_size"))
    verified = merged.filter(F.size("t_places") >= MIN_VOTES).join(sizes, "template").withColumn("share", standing / asked)
    verified = verified.filter(F.col("share") >= MIN_SHARE)
    earlier = F.max("last").over(Window.partitionBy("key", "text_hash").orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    longer = F.max("last").over(Window.partitionBy("key", "text_hash", "first"))
    best = F.max("share").over(Window.partitionBy("key", "text_hash", "first", "last"))
    outer = verified.withColumns({"earlier": earlier, "longer": longer, "best": best}).filter((F.coalesce("earlier", F.lit(-1)) < F.col("last")) & (F.col("longer") == F.col("last")) & (F.col("share") == F.col("best")))
    return outer.select("key", "text_hash", "label", "first", "last", "share")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("w"))
    base = rows.select("key", "text_hash", F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w")).alias("base"))
    found = spans(docs, text, key).groupBy("key", "text_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = base.join(found.withColumnsRenamed({"key": "k", "text_hash": "h"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    own = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>"))))
    places = F.transform("base", lambda b: b["place"])
    return both.select(
        F.col("key").alias(key),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{' '.join(re.findall('[a-z0-9]+', text.lower()))}')" for i, (label, text) in enumerate(TEXTS))
PLACES = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM one WHERE " + " AND ".join(f"w[i + {o}] = '{part}'" for o, part in enumerate(phrase.split())) for phrase, label in PHRASES.items())
ORACLE = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
one AS (SELECT doc_id, w, i FROM words, LATERAL unnest(generate_series(1, len(w))) AS t(i) WHERE list_contains(w, 'license')),
places AS ({PLACES}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
known AS (SELECT template, label, string_split(t, ' ') AS w FROM (VALUES {TEMPLATE_ROWS}) AS v(template, label, t)),
grams AS (SELECT doc_id, i - 1 AS place, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM words, LATERAL unnest(generate_series(1, len(w) - 2)) AS t(i)),
t_grams AS (SELECT template, i - 1 AS t_place, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM known, LATERAL unnest(generate_series(1, len(w) - 2)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, template, place - t_place AS diagonal, t_place FROM grams JOIN t_grams USING (g)),
votes AS (SELECT doc_id, template, diagonal, min(t_place) + diagonal AS first, max(t_place) + diagonal + {K} AS last FROM hits GROUP BY 1, 2, 3),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {NEAR} THEN 1 ELSE 0 END AS new FROM votes WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
bands AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM steps),
gaps AS (SELECT *, CASE WHEN first > max(last) OVER (PARTITION BY doc_id, template, band ORDER BY first, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {K + NEAR} THEN 1 ELSE 0 END AS new FROM bands),
runs AS (SELECT doc_id, template, diagonal, first, last, band, sum(new) OVER (PARTITION BY doc_id, template, band ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
standing AS (SELECT r.doc_id, r.template, band, run, min(first) AS first, max(last) AS last, count(DISTINCT t_place) AS n, min(t_place) AS low, max(t_place) + {K} AS high FROM runs r JOIN hits h ON h.doc_id = r.doc_id AND h.template = r.template AND h.diagonal = r.diagonal GROUP BY 1, 2, 3, 4),
covered AS (SELECT r.doc_id, r.template, band, run, count(DISTINCT t_place + o) AS n_words FROM runs r JOIN hits h ON h.doc_id = r.doc_id AND h.template = r.template AND h.diagonal = r.diagonal, LATERAL unnest(generate_series(0, {K - 1})) AS t(o) GROUP BY 1, 2, 3, 4),
shares AS (SELECT s.doc_id, s.first, s.last, k.label, n_words / CASE WHEN s.last - s.first >= {LONG} AND high - low >= {LONG} THEN high - low ELSE len(k.w) END AS share FROM standing s JOIN covered USING (doc_id, template, band, run) JOIN known k USING (template) WHERE n >= {MIN_VOTES}),
verified AS (SELECT * FROM shares WHERE share >= {MIN_SHARE}),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM verified v WHERE NOT EXISTS (SELECT 1 FROM verified o WHERE o.doc_id = v.doc_id AND (o.first < v.first AND o.last >= v.last OR o.first = v.first AND (o.last > v.last OR o.last = v.last AND o.share > v.share))) GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, unnest(labels) AS label FROM more UNION ALL SELECT doc_id, label FROM places) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
CAST(greatest(coalesce(m.share, 0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS score FROM words d LEFT JOIN base b USING (doc_id) LEFT JOIN every e USING (doc_id) LEFT JOIN more m USING (doc_id)
"""
