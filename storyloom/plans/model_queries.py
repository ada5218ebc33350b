"""Ingest, signal, candidate, cost, inbox and coverage queries over the model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import briefs, candidates, costs, coverage, detail, feedback, inbox, ingest, signals, trending
from storyloom.plans import board_sql as B
from storyloom.plans import run as scoring
from storyloom.plans.catalog import query
from storyloom.plans.text_queries import HALF_LIFE, HASHED, hashed, quoted
from storyloom.plans.vector_queries import GATE, gated
from storyloom.schemas import BUCKETS, DEAREST, DOMAINS, PRICES, TRANSPORT_DOMAINS
from storyloom.sources.lens import AS_OF, EVENTS_AS_OF, model, stream_of
from storyloom.sources.shared import new_path, written
from storyloom.streaming import jobs

at = lambda text: F.expr(text)
NOW, EVENTS_NOW = AS_OF, EVENTS_AS_OF


def m(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [model(spark, sf, n) for n in names]


# ---- ingest -------------------------------------------------------------------------------------------------

@query("ingest_hash_dedup", f"""WITH {HASHED}, known AS (SELECT * FROM h WHERE raw_id % 7 = 0), new AS (SELECT * FROM h WHERE raw_id % 7 <> 0),
folded AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY source_id, url_hash, title_hash ORDER BY raw_id) = 1),
fresh AS (SELECT * FROM folded f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.url_hash = f.url_hash) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.title_hash = f.title_hash AND k.published_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY)
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source_id = f.source_id AND k.external_id = f.external_id))
SELECT raw_id, source_id, external_id FROM fresh QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY raw_id) = 1""")
def ingest_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = hashed(model(spark, sf, "raw_items"))
    return ingest.hash_dedup(rows.filter("raw_id % 7 <> 0"), rows.filter("raw_id % 7 = 0"), at("TIMESTAMP '2024-01-15 00:00:00'")).select("raw_id", "source_id", "external_id")


@query("new_vs_known_keys", """WITH known AS (SELECT DISTINCT source_id, external_id FROM {raw_items} WHERE raw_id % 7 = 0), new AS (SELECT DISTINCT source_id, external_id FROM {raw_items} WHERE raw_id % 7 <> 0)
SELECT source_id, external_id, CASE WHEN known.source_id IS NULL THEN 'new' WHEN new.source_id IS NULL THEN 'known_only' ELSE 'both' END AS state FROM known FULL JOIN new USING (source_id, external_id)""")
def new_vs_known_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = model(spark, sf, "raw_items").select("raw_id", "source_id", "external_id")
    new, known = keys.filter("raw_id % 7 <> 0").drop("raw_id"), keys.filter("raw_id % 7 = 0").drop("raw_id")
    named = lambda rows, name: rows.withColumn("state", F.lit(name))
    return named(new.subtract(known), "new").unionByName(named(new.intersect(known), "both")).unionByName(named(known.subtract(new), "known_only"))


@query("pending_raw_items", "SELECT raw_id, attempts FROM {raw_items} WHERE NOT processed AND attempts < 3 ORDER BY fetched_at, raw_id LIMIT 20")
def pending_raw_items(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pending(model(spark, sf, "raw_items")).select("raw_id", "attempts")


@query("raw_item_state", "SELECT raw_id, CASE WHEN processed AND raw_id % 4 = 0 THEN 'normal' WHEN processed THEN 'dedup_hit' WHEN attempts >= 3 THEN 'poisoned' ELSE 'pending' END AS state FROM {raw_items}")
def raw_item_state(spark: SparkSession, sf: str) -> DataFrame:
    raw = model(spark, sf, "raw_items")
    done = raw.filter("raw_id % 4 = 0").select("raw_id", F.lit(True).alias("done"))
    return raw.join(done, "raw_id", "left").select("raw_id", ingest.state(F.col("processed"), F.col("attempts"), F.coalesce("done", F.lit(False))).alias("state"))


@query("backfill_processed_at", "SELECT raw_id, CASE WHEN processed THEN fetched_at WHEN raw_id % 4 = 0 THEN published_at + INTERVAL 3 HOUR END AS processed_at FROM {raw_items}")
def backfill_processed_at(spark: SparkSession, sf: str) -> DataFrame:
    raw = model(spark, sf, "raw_items").withColumn("processed_at", F.expr("CASE WHEN processed THEN fetched_at END"))
    items = model(spark, sf, "raw_items").filter("raw_id % 4 = 0").select("raw_id", F.expr("published_at + INTERVAL 3 HOUR").alias("created_at"))
    return raw.join(items, "raw_id", "left").select("raw_id", F.coalesce("processed_at", "created_at").alias("processed_at"))


@query("host_allowlist", """SELECT raw_id FROM {raw_items} WHERE source_id % 2 = 1 OR regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', ''), '(^|\\.)example\\.(com|org)$')""")
def host_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf, "raw_items").withColumn("feed_url", F.when(F.col("source_id") % 2 == 1, "https://other.example/rss").otherwise("https://hnrss.org/best?points=100"))
    return ingest.trusted_items(rows, hosts=["example.com", "example.org"]).select("raw_id")


META_JSON = """CASE WHEN raw_id % 3 = 0 THEN NULL WHEN raw_id % 3 = 1 THEN concat('[["feed":"', external_id, '","kept":[1,2]', CASE WHEN raw_id % 5 = 2 THEN ',"last_processing_error":"old"' ELSE '' END, ']]') ELSE '[[]]' END"""
braced = lambda sql: F.expr(sql.replace("[[", "{").replace("]]", "}"))
OUTCOMES = f"""o AS (SELECT raw_id, fetched_at, CASE WHEN raw_id % 4 = 0 THEN 'skip' WHEN raw_id % 10 = 7 THEN 'failed' WHEN raw_id % 6 = 1 THEN 'dedup_hit' ELSE 'normal' END AS outcome, attempts + CASE WHEN raw_id % 4 <> 0 AND raw_id % 10 = 7 THEN 1 ELSE 0 END AS attempts,
CASE WHEN raw_id % 4 <> 0 AND raw_id % 10 = 7 THEN substr(title, 1, 240) END AS error, {META_JSON} AS raw_meta FROM {{raw_items}})"""


def attempted(spark: SparkSession, sf: str) -> DataFrame:
    raw = model(spark, sf, "raw_items").withColumn("raw_meta", braced(META_JSON))
    return ingest.outcomes(raw, raw.filter("raw_id % 4 = 0"), raw.filter("raw_id % 6 = 1"), raw.filter("raw_id % 10 = 7").select("raw_id", F.col("title").alias("error")), "raw_meta")


@query("process_outcomes", f"WITH {OUTCOMES} SELECT raw_id, outcome, attempts, error, CASE WHEN error IS NULL THEN raw_meta ELSE CAST(json_merge_patch(CAST(coalesce(raw_meta, '[[]]') AS JSON), json_object('last_processing_error', error)) AS VARCHAR) END AS raw_meta FROM o")
def process_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return attempted(spark, sf)


@query("process_ticks", f"WITH {OUTCOMES} SELECT CAST(CAST(fetched_at AS DATE) AS STRING) AS tick, count(*) AS pulled, count(*) FILTER (outcome IN ('normal', 'skip')) AS normal, count(*) FILTER (outcome = 'dedup_hit') AS dedup, count(*) FILTER (outcome = 'failed') AS failures FROM o GROUP BY 1")
def process_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """A tick a day of fetching."""
    days = model(spark, sf, "raw_items").select("raw_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("tick"))
    return ingest.ticks(attempted(spark, sf).join(days, "raw_id"))


@query("stream_outcomes", "SELECT raw_id, attempts, CASE WHEN processed THEN CASE WHEN raw_id % 2 = 0 THEN 'normal' ELSE 'dedup_hit' END END AS outcome, CASE WHEN attempts > 0 THEN concat('error ', CAST(attempts AS STRING)) END AS error FROM {raw_items} WHERE attempts > 0 OR processed")
def stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of attempts, each of which comes twice: some fail, then a processed row is settled, and once more after that."""
    raw = stream_of(spark, "raw_items", documents=jobs.source(spark, sf, "documents"), pages=model(spark, sf, "pages"))
    tries = raw.select("raw_id", "attempts", "processed", F.explode(F.flatten(F.array_repeat(F.sequence(F.lit(1), F.col("attempts") + 2), 2))).alias("attempt"))
    settled = F.when(F.col("raw_id") % 2 == 0, "normal").otherwise("dedup_hit")
    outcome = F.when(F.col("attempt") <= F.col("attempts"), "failed").when(F.col("processed"), settled)
    error = F.when(outcome == "failed", F.concat(F.lit("error "), F.col("attempt").cast("string")))
    return jobs.processed(tries.select("raw_id", "attempt", outcome.alias("outcome"), error.alias("error")).filter("outcome IS NOT NULL"))


@query("feed_items", """SELECT raw_id, CASE WHEN raw_id % 5 = 2 THEN url ELSE concat('guid-', CAST(raw_id AS STRING)) END AS external_id, trim(title) AS title, url, CASE WHEN raw_id % 4 = 1 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE published_at END AS published_at,
CAST(to_json(struct_pack(feedTitle := concat('Feed ', CAST(source_id AS STRING)), categories := CASE WHEN raw_id % 3 > 0 THEN list_slice(['one', 'two'], 1, raw_id % 3) END, enclosure := CASE WHEN raw_id % 7 = 0 THEN struct_pack(url := 'https://media.example/a.mp3', type := 'audio/mpeg') END)) AS VARCHAR) AS raw_meta FROM {raw_items} WHERE raw_id % 9 <> 5 AND trim(title) <> ''""")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds, landed from the raw items as documents of XML and read back: a document for each source and 50 ids."""
    from storyloom.sources.feeds import feeds_of, items_of

    rows = model(spark, sf, "raw_items")
    esc = lambda c: T.escaped(c, "&apos;", True)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    link = F.when(F.col("raw_id") % 9 == 5, "").otherwise(tag("link", esc(F.col("url"))))
    date = F.when(F.col("raw_id") % 4 == 1, "not a date").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    guid = F.when(F.col("raw_id") % 5 == 2, "").otherwise(F.concat(F.lit("guid-"), F.col("raw_id").cast("string")))
    categories = F.concat_ws("", F.when(F.col("raw_id") % 3 > 0, tag("category", F.lit("one"))), F.when(F.col("raw_id") % 3 == 2, tag("category", F.lit("two"))))
    enclosure = F.when(F.col("raw_id") % 7 == 0, '<enclosure url="https://media.example/a.mp3" type="audio/mpeg"/>').otherwise("")
    entry = tag("item", F.concat(tag("title", esc(F.col("title"))), link, tag("guid", guid), tag("isoDate", date), categories, enclosure, tag("creator", F.col("raw_id").cast("string"))))
    feeds = rows.groupBy("source_id", F.floor(F.col("raw_id") / 50).alias("page")).agg(F.array_join(F.collect_list(entry), "").alias("items"))
    path = new_path(spark, "feeds")
    feeds.select(tag("channel", F.concat(tag("title", F.concat(F.lit("Feed "), F.col("source_id").cast("string"))), F.col("items"))).alias("value")).write.text(path)
    found = items_of(feeds_of(spark.read.text(path)), at("TIMESTAMP '2024-02-01 00:00:00'"))
    return found.select(F.col("author").cast("long").alias("raw_id"), "external_id", "title", "url", "published_at", F.to_json("raw_meta", {"ignoreNullFields": "false"}).alias("raw_meta"))


VIDEO = """user_id AS competitor_id, CASE WHEN event_id % 41 <> 7 THEN CAST(event_id % 3000 AS STRING) END AS external_id, ts AS published_at, CASE WHEN event_id % 43 <> 8 THEN concat('https://video.example/', CAST(event_id AS STRING)) END AS url, CASE WHEN event_id % 47 = 9 THEN '  ' ELSE concat(' Video ', CAST(event_id AS STRING), ' ') END AS title,
CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '["first","second"]' ELSE concat('"about ', CAST(event_id AS STRING), '"') END WHEN event_id % 3 = 1 THEN '""' END AS media, CASE WHEN event_id % 5 = 0 THEN 'content' END AS content, CASE WHEN event_id % 7 = 0 THEN 'snippet' END AS snippet"""


@query("competitor_videos", f"""WITH v AS (SELECT event_id, {VIDEO} FROM {{events}}), known AS (SELECT * FROM v WHERE event_id % 4 = 0 AND external_id IS NOT NULL),
good AS (SELECT event_id, competitor_id, external_id, published_at, url, trim(title) AS title, coalesce(CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'first' WHEN event_id % 3 = 0 THEN concat('about ', CAST(event_id AS STRING)) END, content, snippet) AS description FROM v WHERE external_id IS NOT NULL AND url IS NOT NULL AND trim(title) <> ''),
new AS (SELECT * FROM good n WHERE event_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.competitor_id = n.competitor_id AND k.external_id = n.external_id) QUALIFY row_number() OVER (PARTITION BY competitor_id, external_id ORDER BY event_id) = 1),
old AS (SELECT competitor_id, max(published_at) AS last_video_at FROM known GROUP BY 1), fresh AS (SELECT competitor_id, max(published_at) AS seen, count(*) AS n, count(description) AS described, max(description) AS last_description FROM new GROUP BY 1)
SELECT competitor_id, coalesce(greatest(seen, last_video_at), seen, last_video_at) AS last_video_at, coalesce(n, 0) AS inserted, coalesce(described, 0) AS described, last_description FROM old FULL JOIN fresh USING (competitor_id)""")
def competitor_videos(spark: SparkSession, sf: str) -> DataFrame:
    from storyloom.sources.feeds import new_videos, videos_of

    v = spark.sql(f"SELECT event_id, {VIDEO} FROM {{events}}", events=model(spark, sf, "events"))
    known = v.filter("event_id % 4 = 0 AND external_id IS NOT NULL")
    new = new_videos(videos_of(v.filter("event_id % 4 <> 0")), known)
    old = known.groupBy("competitor_id").agg(F.max("published_at").alias("last"))
    fresh = new.groupBy("competitor_id").agg(F.max("published_at").alias("at"), F.count("*").alias("n"), F.count("description").alias("described"), F.max("description").alias("last_description"))
    return old.join(fresh, "competitor_id", "full_outer").select("competitor_id", F.greatest("at", "last").alias("last_video_at"), F.coalesce("n", F.lit(0)).alias("inserted"), F.coalesce("described", F.lit(0)).alias("described"), "last_description")


PLAYLISTED = "SELECT event_id AS video_id, user_id AS channel_id, ts AS published_at FROM {events} WHERE event_id % 8 <> 3 AND event_id % 10 <> 4 AND ts >= TIMESTAMP '2024-01-10 00:00:00'"


def playlist(spark: SparkSession, sf: str) -> DataFrame:
    """Paged playlist answers as JSON texts, built from events, exploded to videos."""
    from storyloom.sources.feeds import playlist_items

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    own = F.when(F.col("event_id") % 8 != 3, F.col("event_id").cast("string"))
    item = F.struct(F.struct(own.alias("videoId"), F.when(F.col("event_id") % 10 == 4, "bad").when(F.col("event_id") % 2 == 0, iso).alias("videoPublishedAt")).alias("contentDetails"), F.struct(F.col("user_id").cast("string").alias("channelId"), F.lit("t").alias("title"), F.when(F.col("event_id") % 10 == 4, "bad").otherwise(iso).alias("publishedAt")).alias("snippet"))
    pages = model(spark, sf, "events").groupBy("user_id", F.expr("floor(event_id / 50)").alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("raw"))
    return playlist_items(pages, at("TIMESTAMP '2024-01-10 00:00:00'")).select(F.col("video_id").cast("long").alias("video_id"), F.col("channel_id").cast("long").alias("channel_id"), "published_at")


@query("playlist_videos", PLAYLISTED)
def playlist_videos(spark: SparkSession, sf: str) -> DataFrame:
    return playlist(spark, sf)


@query("playlist_corpus", f"SELECT channel_id, count(*) AS videos, min(published_at) AS oldest, max(published_at) AS newest FROM ({PLAYLISTED}) GROUP BY 1")
def playlist_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return playlist(spark, sf).groupBy("channel_id").agg(F.count("*").alias("videos"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"))


# ---- signals ------------------------------------------------------------------------------------------------

EXCL = """first AS (SELECT cluster_id, source_id, min(published_at) AS t0 FROM {items} GROUP BY 1, 2), two AS (SELECT *, row_number() OVER w AS n, lead(t0) OVER w AS nxt FROM first WINDOW w AS (PARTITION BY cluster_id ORDER BY t0, source_id)),
excl AS (SELECT t.cluster_id, t.source_id, s.authority_score AS authority, round(date_diff('second', t0, nxt) / 3600.0, 6) AS gap_hours, coalesce(s.authority_score >= 75 AND date_diff('second', t0, nxt) > 14400, false) AS is_exclusive FROM two t JOIN {sources} s USING (source_id) WHERE n = 1)"""


@query("exclusive_clusters", f"WITH {EXCL} SELECT * FROM excl")
def exclusive_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return signals.exclusive(*m(spark, sf, "items", "sources"))


def traj(hours: int, pool: str) -> str:
    edge, before = f"({NOW} - INTERVAL {hours} HOUR)", f"({NOW} - INTERVAL {2 * hours} HOUR)"
    return f"""counts AS (SELECT cluster_id, count(*) FILTER (published_at > {edge}) AS a, count(*) FILTER (published_at > {before} AND published_at <= {edge}) AS b FROM {{items}} GROUP BY 1),
ratios AS (SELECT c.cluster_id, c.first_seen_at >= {edge} AS young, CASE WHEN c.first_seen_at >= {edge} THEN 0 ELSE coalesce(a, 0) / greatest(coalesce(b, 0), 1) END AS r FROM {pool} c LEFT JOIN counts USING (cluster_id)),
moves AS (SELECT cluster_id, CAST(round(r, 6) AS DOUBLE) AS ratio, CASE WHEN young THEN 'new' WHEN r > 1.5 THEN 'rising' WHEN r >= 0.7 THEN 'peaking' ELSE 'declining' END AS trajectory FROM ratios)"""


@query("trajectory", f"WITH {traj(720, '{clusters}')} SELECT * FROM moves")
def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return signals.trajectory(*m(spark, sf, "items", "clusters"), at(NOW), 720)


#: Mean similarity of a cluster's vectors; three neighbouring vectors are a cluster's.
SIMS = """sims AS (SELECT a.vec_id // 3 AS cluster_id, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS similarity FROM {vectors} a JOIN {vectors} b ON a.vec_id // 3 = b.vec_id // 3 AND a.vec_id < b.vec_id GROUP BY 1)"""


def similarities(spark: SparkSession, sf: str) -> DataFrame:
    from storyloom.operators.vectors import mean_pair_similarity

    return mean_pair_similarity(model(spark, sf, "vectors").select(F.expr("vec_id div 3").alias("cluster_id"), "embedding"), "cluster_id", "embedding")


def heat(loud: float, alike: float) -> str:
    return f"""{SIMS}, other AS (SELECT a.cluster_id, any_value(a.item_count) AS n, count(b.cluster_id) AS c, avg(b.item_count) AS mean, coalesce(stddev_samp(b.item_count), 0) AS sd FROM {{clusters}} a LEFT JOIN {{clusters}} b ON a.primary_domain = b.primary_domain AND a.cluster_id <> b.cluster_id AND b.status = 'active' AND b.first_seen_at >= {NOW} - INTERVAL 3650 DAY GROUP BY 1),
zs AS (SELECT cluster_id, CASE WHEN c = 0 THEN 0 ELSE (n - mean) / greatest(sd, sqrt(greatest(mean, 1))) END AS z FROM other), heat AS (SELECT cluster_id, CAST(round(z, 6) AS DOUBLE) AS z, CASE WHEN z >= {loud} AND similarity > {alike} THEN 'over_saturated' WHEN z < 0 THEN 'cold' WHEN z < 1 THEN 'warm' ELSE 'hot' END AS temperature FROM zs LEFT JOIN sims USING (cluster_id))"""


HEAT = heat(2.5, 0.75)


@query("temperature", f"WITH {heat(0.5, 0.1)} SELECT * FROM heat")
def temperature(spark: SparkSession, sf: str) -> DataFrame:
    return signals.temperature(model(spark, sf, "clusters"), at(NOW), 3650, similarities(spark, sf), 0.5, 0.1)


COVER = "cover AS (SELECT * FROM {coverage} QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY fetched_at DESC, coverage_id DESC) = 1)"


@query("latest_coverage", f"WITH {COVER} SELECT cluster_id, coverage_id, country_count, language_count, total_article_count, fetched_at FROM cover")
def latest_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return signals.latest_coverage(model(spark, sf, "coverage"))


LOOKUP = """c AS (SELECT sha256(concat('topic ', CAST(user_id % 40 AS VARCHAR))) AS query_hash, ts AS fetched_at, max(event_id) AS coverage_id FROM {events} WHERE event_id % 3 <> 0 GROUP BY 1, 2),
r AS (SELECT event_id AS request_id, sha256(concat('topic ', CAST(user_id % 40 AS VARCHAR))) AS query_hash, ts AS requested_at FROM {events} WHERE event_id % 3 = 0)"""


@query("coverage_lookup", f"""WITH {LOOKUP}, l AS (SELECT r.request_id, c.coverage_id, c.fetched_at, coalesce(c.fetched_at >= r.requested_at - INTERVAL 6 HOUR, false) AS hit FROM r ASOF LEFT JOIN c ON r.query_hash = c.query_hash AND r.requested_at >= c.fetched_at)
SELECT request_id, CASE WHEN hit THEN coverage_id END AS coverage_id, CASE WHEN hit THEN fetched_at END AS fetched_at, hit FROM l""")
def coverage_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every third event asks for the coverage of its topic, the others are what was fetched."""
    events = model(spark, sf, "events").withColumn("query_hash", F.sha2(F.concat(F.lit("topic "), (F.col("user_id") % 40).cast("string")), 256))
    requests = events.filter("event_id % 3 = 0").select(F.col("event_id").alias("request_id"), "query_hash", F.col("ts").alias("requested_at"))
    return coverage.lookups(requests, events.filter("event_id % 3 <> 0").select("query_hash", F.col("ts").alias("fetched_at"), F.col("event_id").alias("coverage_id")))


WEIGHT = "CASE c.primary_domain " + " ".join(f"WHEN '{n}' THEN {w}" for n, (_, w, _) in DOMAINS.items()) + " ELSE 1.0 END"
SCORE = f"""sums AS (SELECT cluster_id, CAST(sum(coalesce(authority_weighted, authority_score)) AS DOUBLE) AS auth, bool_and(kind = 'arxiv') AS arxiv_only FROM {{items}} JOIN {{sources}} USING (source_id) GROUP BY 1),
heur AS (SELECT c.cluster_id, coalesce(auth, 0) AS authority, CAST(greatest(0, least(1, coalesce(country_count / 5.0, 0))) AS DOUBLE) AS geo, coalesce(arxiv_only, false) AS arxiv_only,
 round(ln(1 + coalesce(auth, 0)) * {WEIGHT} * (1 + 0.5 * CAST(greatest(0, least(1, coalesce(country_count / 5.0, 0))) AS DOUBLE)) * CASE WHEN coalesce(e.is_exclusive, false) THEN 1.5 ELSE 1.0 END * CASE WHEN coalesce(arxiv_only, false) THEN 0.5 ELSE 1.0 END, 6) AS score
 FROM {{clusters}} c LEFT JOIN sums USING (cluster_id) LEFT JOIN cover USING (cluster_id) LEFT JOIN excl e USING (cluster_id))"""


def heur(spark: SparkSession, sf: str) -> DataFrame:
    items, clusters, sources, coverage = m(spark, sf, "items", "clusters", "sources", "coverage")
    return signals.heuristic(signals.facts(items, sources, at(NOW)), clusters, coverage)


@query("heuristic_score", f"WITH {EXCL}, {COVER}, {SCORE} SELECT * FROM heur")
def heuristic_score(spark: SparkSession, sf: str) -> DataFrame:
    return heur(spark, sf)


@query("arxiv_only_filter", "SELECT cluster_id, status FROM {clusters} c WHERE NOT EXISTS (SELECT 1 FROM {items} i JOIN {sources} s USING (source_id) WHERE i.cluster_id = c.cluster_id GROUP BY i.cluster_id HAVING bool_and(s.kind = 'arxiv'))")
def arxiv_only_filter(spark: SparkSession, sf: str) -> DataFrame:
    items, clusters, sources = m(spark, sf, "items", "clusters", "sources")
    only = items.join(sources.select("source_id", "kind"), "source_id").groupBy("cluster_id").agg(F.bool_and(F.col("kind") == "arxiv").alias("only")).filter("only")
    return clusters.join(only, "cluster_id", "left_anti").select("cluster_id", "status")


POOL = f"status = 'active' AND last_seen_at > {NOW} - INTERVAL 30 DAY"


@query("top_clusters", f"""WITH {EXCL}, {COVER}, {SCORE}, pool AS (SELECT * FROM {{clusters}} WHERE {POOL}), {traj(24, "pool")}, {HEAT}, best AS (SELECT h.* FROM heur h JOIN pool USING (cluster_id) ORDER BY score DESC, cluster_id LIMIT 200)
SELECT b.*, ratio, trajectory, z, temperature, is_exclusive FROM best b JOIN moves USING (cluster_id) JOIN heat USING (cluster_id) JOIN excl USING (cluster_id)""")
def top_clusters(spark: SparkSession, sf: str) -> DataFrame:
    items, sources, coverage = m(spark, sf, "items", "sources", "coverage")
    return scoring.scored(items, state(spark, sf), sources, coverage, at(NOW), heat_days=3650, similarity=similarities(spark, sf))


def state(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters as the stored table that they are: the lens makes them from the items, once."""
    return written(model(spark, sf, "clusters"), "clusters")


UPSERT = f"""per AS (SELECT cluster_id, bool_or(status IN ('picked', 'passed') AND expires_at > {NOW}) AS decided, max(CASE WHEN status = 'new' THEN [['t': created_at, 'i': candidate_id]] END) AS n, max(CASE WHEN status = 'deferred' AND expires_at > {NOW} THEN [['t': created_at, 'i': candidate_id]] END) AS d FROM {{candidates}} GROUP BY 1),
saved AS (SELECT c.cluster_id, CASE WHEN decided THEN 'skipped_decided' WHEN coalesce(n, d) IS NOT NULL THEN 'superseded' ELSE 'inserted' END AS outcome, CASE WHEN NOT coalesce(decided, false) THEN coalesce(n, d).i END AS candidate_id, CASE WHEN NOT coalesce(decided, false) THEN {NOW} + to_hours({HALF_LIFE}) END AS expires_at FROM curated c LEFT JOIN per USING (cluster_id))"""


#: Model calls of a run: which fail, what they cost and are projected to cost, and the run's ceiling, in millionths of a dollar.
FAILED = "CASE WHEN b.cluster_id % 13 = 4 THEN 'summarise' WHEN b.cluster_id % 17 = 5 THEN 'curate' END"
MICROS = ("CAST(b.cluster_id % 50 * 100 + 100 AS BIGINT)", "CAST(b.cluster_id % 70 * 100 + 100 AS BIGINT)")
PROJECTED, RUN_CEILING = (5000, 7000), 900_000


PASS = f"""{EXCL}, {COVER}, {SCORE}, pool AS (SELECT * FROM {{clusters}} WHERE {POOL}), {traj(24, "pool")}, {HEAT}, best AS (SELECT h.* FROM heur h JOIN pool USING (cluster_id) ORDER BY score DESC, cluster_id LIMIT 200), {GATE},
gated AS (SELECT b.*, p.primary_domain, CAST((b.cluster_id * 31) % 100 AS DOUBLE) AS curation_score, coalesce(overlap, 0) AS overlap, coalesce(decision, 'pass') AS decision, {FAILED} AS failed, {MICROS[0]} AS sm, {MICROS[1]} AS cm FROM best b JOIN pool p USING (cluster_id) LEFT JOIN gate g ON g.id = b.cluster_id),
going AS (SELECT *, failed IS DISTINCT FROM 'summarise' AND decision <> 'drop' AS goes FROM gated),
spending AS (SELECT *, coalesce(sum(sm + CASE WHEN goes THEN cm ELSE 0 END) OVER (ORDER BY score DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM going),
stops AS (SELECT *, sofar + {PROJECTED[0]} >= {RUN_CEILING} AS s1, goes AND sofar + sm + {PROJECTED[1]} >= {RUN_CEILING} AS s2 FROM spending),
charged AS (SELECT *, coalesce(bool_or(s1 OR s2) OVER (ORDER BY score DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM stops),
reach AS (SELECT *, CASE WHEN over OR s1 THEN 0 WHEN s2 THEN sm ELSE sm + CASE WHEN goes THEN cm ELSE 0 END END AS micros, CASE WHEN over OR s1 OR s2 THEN 'halted' WHEN failed = 'summarise' THEN 'failed_summarise' WHEN decision = 'drop' THEN 'archived' WHEN failed = 'curate' THEN 'failed_curate' WHEN curation_score < 60 THEN 'below_cutoff' END AS reached FROM charged),
curated AS (SELECT cluster_id, primary_domain FROM reach WHERE reached IS NULL), {UPSERT},
staged AS (SELECT g.*, outcome, candidate_id, coalesce(reached, CASE WHEN outcome = 'skipped_decided' THEN 'decided' ELSE 'saved' END) AS stage FROM reach g LEFT JOIN saved USING (cluster_id)),
passed AS (SELECT s.cluster_id, score, temperature, trajectory, round(overlap, 4) AS overlap, decision, curation_score, stage, outcome, candidate_id, CASE WHEN stage = 'saved' AND row_number() OVER (PARTITION BY stage ORDER BY curation_score DESC, s.cluster_id) <= 5 THEN row_number() OVER (PARTITION BY stage ORDER BY curation_score DESC, s.cluster_id) END AS pulse_rank, CAST(micros AS BIGINT) AS micros
FROM staged s JOIN moves USING (cluster_id) JOIN heat USING (cluster_id))"""


def one_pass(spark: SparkSession, sf: str) -> DataFrame:
    clusters = state(spark, sf)
    calls = [at(FAILED.replace("b.", "")).alias("failed"), *(at(t.replace("b.", "")).alias(n) for t, n in zip(MICROS, ("summarise_micros", "curate_micros"), strict=True))]
    curations = clusters.select("cluster_id", ((F.col("cluster_id") * 31) % 100).cast("double").alias("curation_score"), *calls)
    items, sources, coverage, rows = m(spark, sf, "items", "sources", "coverage", "candidates")
    gate = lambda best: gated(spark, sf, best.withColumnRenamed("cluster_id", "id")).withColumnRenamed("id", "cluster_id")
    return scoring.run(items, clusters, sources, coverage, rows, curations, at(NOW), heat_days=3650, similarity=similarities(spark, sf), gate=gate, ceiling=RUN_CEILING, projected=PROJECTED).withColumn("overlap", F.round("overlap", 4))


@query("scoring_run", f"WITH {PASS} SELECT * FROM passed")
def scoring_run(spark: SparkSession, sf: str) -> DataFrame:
    return one_pass(spark, sf)


@query("cluster_domains", """SELECT cluster_id, string_agg(d, ',' ORDER BY d) AS domains FROM (SELECT DISTINCT cluster_id, CASE part_id % 5 WHEN 0 THEN 'economy' WHEN 1 THEN 'economics' WHEN 2 THEN 'scitech' WHEN 3 THEN 'geopolitics' ELSE 'national' END AS d FROM {items}) GROUP BY 1""")
def cluster_domains(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("CASE part_id % 5 WHEN 0 THEN 'economy' WHEN 1 THEN 'economics' WHEN 2 THEN 'scitech' WHEN 3 THEN 'geopolitics' ELSE 'national' END")
    return model(spark, sf, "items").groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("domains"))


@query("cluster_timeline", """SELECT cluster_id, source_id, published_at, row_number() OVER w AS position, coalesce(date_diff('second', lag(published_at) OVER w, published_at), 0) AS gap_seconds, row_number() OVER w = 1 AS is_first, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY published_at, order_id, line, part_id) AS repeat_no
FROM {items} WINDOW w AS (PARTITION BY cluster_id ORDER BY published_at, source_id, order_id, line, part_id)""")
def cluster_timeline(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("published_at", "source_id", "order_id", "line", "part_id")
    own = Window.partitionBy("cluster_id", "source_id").orderBy("published_at", "order_id", "line", "part_id")
    gap = F.unix_seconds("published_at") - F.unix_seconds(F.lag("published_at").over(w))
    return model(spark, sf, "items").select("cluster_id", "source_id", "published_at", F.row_number().over(w).alias("position"), F.coalesce(gap, F.lit(0)).alias("gap_seconds"), (F.row_number().over(w) == 1).alias("is_first"), F.row_number().over(own).alias("repeat_no"))


FIRSTS = "firsts AS (SELECT cluster_id, source_id, min(published_at) AS t0, count(*) AS n FROM {items} GROUP BY 1, 2), listed AS (SELECT cluster_id, CAST(sum(f.n) AS BIGINT) AS n_rows, count(*) AS n_sources, min(t0) AS first_at, string_agg(concat(s.name, ':', CAST(s.authority_score AS STRING)), ',' ORDER BY t0, source_id) AS sources FROM firsts f JOIN {sources} s USING (source_id) GROUP BY 1)"


def named(listed: str) -> Column:
    return F.array_join(F.transform(listed, lambda x: F.concat(x["name"], F.lit(":"), x["authority"].cast("string"))), ",")


@query("cluster_sources", f"WITH {FIRSTS} SELECT cluster_id, n_rows, n_sources, sources FROM listed")
def cluster_sources(spark: SparkSession, sf: str) -> DataFrame:
    return detail.source_list(*m(spark, sf, "items", "sources")).select("cluster_id", "n_rows", "n_sources", named("listed").alias("sources"))


@query("cluster_source_rows", "SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, source_id, order_id, line, part_id) AS position, source_id, name, title, url, published_at FROM {items} JOIN {sources} USING (source_id)")
def cluster_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    return detail.source_rows(*m(spark, sf, "items", "sources"))


# ---- candidates ---------------------------------------------------------------------------------------------

BEST = "curation_score DESC, created_at DESC, candidate_id"


@query("active_candidates", f"SELECT candidate_id, cluster_id, curation_score, substr(headline, 1, 80) AS preview FROM {{candidates}} WHERE status = 'new' AND expires_at > {NOW} ORDER BY {BEST} LIMIT 30")
def active_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.active(model(spark, sf, "candidates"), at(NOW)).select("candidate_id", "cluster_id", "curation_score", F.substring("headline", 1, 80).alias("preview"))


@query("today_list", f"""WITH best AS (SELECT *, row_number() OVER (ORDER BY {BEST}) AS n FROM (SELECT * FROM {{candidates}} WHERE status = 'new' AND expires_at > {NOW} ORDER BY {BEST} LIMIT 30))
SELECT primary_domain, count(*) AS n, min(n) AS first_rank, string_agg(CAST(candidate_id AS STRING), ',' ORDER BY n) AS candidates FROM best GROUP BY 1""")
def today_list(spark: SparkSession, sf: str) -> DataFrame:
    best = candidates.active(model(spark, sf, "candidates"), at(NOW))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("curation_score"), F.desc("created_at"), "candidate_id")))  # 30 rows
    return ranked.groupBy("primary_domain").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x["candidate_id"].cast("string")), ",").alias("candidates"))


ARCHIVE_JSON = """CASE WHEN candidate_id % 4 = 0 THEN NULL WHEN candidate_id % 4 = 1 THEN '[[ "overlap": 0.1 ]]' ELSE concat('[[ "overlap": 0.4, "links": [ [[ "title": "A', CAST(candidate_id AS STRING), '", "url": "https://archive.example/a", "similarity": 0.5 ]], 7, [[ "title": ', CASE WHEN candidate_id % 3 = 0 THEN '7' ELSE '"B"' END, ', "url": "https://archive.example/b", "similarity": ', CASE WHEN candidate_id % 5 = 0 THEN '"high"' ELSE '0.25' END, ' ]] ] ]]') END"""
LINKED = f"""entry AS (SELECT candidate_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT candidate_id, CAST(json_extract({ARCHIVE_JSON}, '$.links') AS JSON[]) AS l FROM {{candidates}})),
linked AS (SELECT candidate_id, concat('[', string_agg(CAST(to_json(struct_pack(title := json_extract_string(e, '$.title'), url := json_extract_string(e, '$.url'), similarity := CAST(json_extract(e, '$.similarity') AS DOUBLE))) AS VARCHAR), ',' ORDER BY i), ']') AS archive_links
 FROM entry WHERE json_type(e, '$.title') = 'VARCHAR' AND json_type(e, '$.url') = 'VARCHAR' AND json_type(e, '$.similarity') IN ('DOUBLE', 'UBIGINT', 'BIGINT') GROUP BY 1)"""


def with_archive(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "candidates").withColumn("archive_payload", braced(ARCHIVE_JSON))


@query("candidate_detail", f"""WITH {EXCL}, {FIRSTS}, {LINKED}, own AS (SELECT i.* FROM {{items}} i JOIN excl e USING (cluster_id, source_id) WHERE e.is_exclusive QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, order_id, line, part_id) = 1)
SELECT candidate_id, coalesce(n_rows, 0) AS n_rows, first_at, l.sources, o.source_id AS exclusive_source, s.name AS exclusive_name, o.title AS exclusive_title, o.url AS exclusive_url, o.published_at AS exclusive_at, coalesce(archive_links, '[]') AS archive_links
FROM {{candidates}} c LEFT JOIN listed l ON l.cluster_id = c.cluster_id LEFT JOIN own o ON o.cluster_id = c.cluster_id LEFT JOIN {{sources}} s ON s.source_id = o.source_id LEFT JOIN linked USING (candidate_id)""")
def candidate_detail(spark: SparkSession, sf: str) -> DataFrame:
    found = detail.details(with_archive(spark, sf), *m(spark, sf, "items", "sources"))
    alone = [F.col(f"exclusive.{n}").alias(f"exclusive_{as_}") for n, as_ in (("source_id", "source"), ("name", "name"), ("title", "title"), ("url", "url"), ("published_at", "at"))]
    return found.select("candidate_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_at", named("listed").alias("sources"), *alone, F.to_json("archive_links").alias("archive_links"))


@query("latest_new_per_cluster", "SELECT candidate_id, CASE WHEN status = 'new' AND row_number() OVER (PARTITION BY cluster_id, status ORDER BY created_at DESC, candidate_id DESC) > 1 THEN 'expired' ELSE status END AS status FROM {candidates}")
def latest_new_per_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.newest_new(model(spark, sf, "candidates"))


@query("retire_decided_dups", f"SELECT candidate_id, CASE WHEN status = 'new' AND EXISTS (SELECT 1 FROM {{candidates}} d WHERE d.cluster_id = c.cluster_id AND d.status IN ('picked', 'passed') AND d.expires_at > {NOW}) THEN 'expired' ELSE status END AS status FROM {{candidates}} c")
def retire_decided_dups(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.retire_decided(model(spark, sf, "candidates"), at(NOW))


@query("upsert_candidates", f"WITH curated AS (SELECT cluster_id, primary_domain FROM {{clusters}}), {UPSERT} SELECT * FROM saved")
def upsert_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.upsert(model(spark, sf, "clusters").select("cluster_id", "primary_domain"), model(spark, sf, "candidates"), at(NOW))


@query("decisions_apply", """SELECT feedback_id, f.candidate_id, CASE WHEN n = 1 AND c.status = 'new' THEN 'applied' ELSE 'already_decided' END AS result, CASE WHEN n = 1 AND c.status = 'new' THEN CASE action WHEN 'pick' THEN 'picked' WHEN 'pass' THEN 'passed' ELSE 'deferred' END ELSE c.status END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at, feedback_id) AS n FROM {feedback}) f JOIN {candidates} c USING (candidate_id)""")
def decisions_apply(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.decide(*m(spark, sf, "feedback", "candidates"))


@query("feeds_out", f"""WITH pool AS (SELECT * FROM {{candidates}} WHERE status = 'new' AND expires_at > {NOW}), every AS (SELECT 'master' AS feed, * FROM pool UNION ALL SELECT primary_domain AS feed, * FROM pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY {BEST}) AS rank FROM every), words AS (SELECT feed, rank, w, min(i) AS i FROM (SELECT feed, rank, unnest(keywords || tags) AS w, generate_subscripts(keywords || tags, 1) AS i FROM ranked WHERE rank <= 50) GROUP BY 1, 2, 3),
cats AS (SELECT feed, rank, string_agg(w, ',' ORDER BY i) AS categories FROM words GROUP BY 1, 2), names AS (SELECT unnest([{quoted(["master", *DOMAINS])}]) AS feed) SELECT feed, rank, candidate_id, categories FROM names LEFT JOIN (SELECT * FROM ranked JOIN cats USING (feed, rank)) USING (feed)""")
def feeds_out(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.feeds(model(spark, sf, "candidates"), at(NOW))


PULSE = f"""fresh AS (SELECT *, CASE WHEN day(created_at) % 2 = 0 THEN 'morning' ELSE 'afternoon' END AS run_kind, CAST(CAST(created_at AS DATE) AS STRING) AS run_id, CASE WHEN candidate_id % 6 = 0 THEN ' ' ELSE concat(' why ', CAST(candidate_id AS STRING)) END AS rationale FROM {{candidates}}),
loud AS (SELECT *, max(is_exclusive OR (temperature = 'hot' AND trajectory IN ('rising', 'new'))) OVER (PARTITION BY run_id) AS loud FROM fresh), ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY curation_score DESC, candidate_id) AS rank FROM loud WHERE run_kind = 'morning' OR loud),
lives AS (SELECT *, least(created_at + to_hours({HALF_LIFE}), CASE WHEN status <> 'new' THEN updated_at END) - INTERVAL 1 MICROSECOND AS until FROM {{candidates}} WHERE cluster_id NOT IN {B.ARXIV}),
pool AS (SELECT CAST(CAST(day AS DATE) AS STRING) AS run, * EXCLUDE (day, until) FROM (SELECT *, unnest(generate_series(CAST(CAST(created_at AS DATE) AS TIMESTAMP), CAST(CAST(until AS DATE) AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM lives)), {B.STORIES}, {B.board("themes", "tags", 1, 6)}, {B.board("words", "keywords", 2, 10)},
lines AS (SELECT run, string_agg(concat(term, ' · ', CAST(clusters AS STRING), ' clusters · ', split_part(domains, ',', 1)), chr(10) ORDER BY rank) AS t FROM themes GROUP BY 1), named AS (SELECT run, string_agg(term, ' · ' ORDER BY rank) AS w FROM words GROUP BY 1),
waves AS (SELECT run AS run_id, concat_ws(concat(chr(10), chr(10)), t, 'Keywords: ' || w) AS description FROM lines FULL JOIN named USING (run) WHERE run IN (SELECT run_id FROM fresh WHERE run_kind = 'morning')),
pulse AS (SELECT run_id, 'candidate' AS kind, rank, candidate_id, headline AS title, concat(CASE WHEN trim(rationale) <> '' THEN concat('↳ ', trim(rationale), chr(10)) ELSE '' END, primary_domain, ' · score ', CAST(CAST(floor(curation_score + 0.5) AS BIGINT) AS STRING), ' · ', trajectory, CASE WHEN is_exclusive THEN ' · exclusive' ELSE '' END) AS description FROM ranked WHERE rank <= 5
 UNION ALL SELECT run_id, 'waves', NULL, NULL, concat('Waves — ', run_id), description FROM waves)"""


def fresh(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.dayofmonth("created_at") % 2 == 0, "morning").otherwise("afternoon")
    why = F.when(F.col("candidate_id") % 6 == 0, " ").otherwise(F.concat(F.lit(" why "), F.col("candidate_id").cast("string")))
    return model(spark, sf, "candidates").withColumns({"run_kind": kind, "run_id": F.date_format("created_at", "yyyy-MM-dd"), "rationale": why})


def entries(spark: SparkSession, sf: str, newest: int | None = None) -> DataFrame:
    """A run a day; its board is of what was new at the day's end: unexpired by the domain's half-life and not decided (at ``updated_at``) yet.

    With ``newest`` of the runs that can be among so many newest entries alone.
    """
    items, sources, rows = m(spark, sf, "items", "sources", "candidates")
    runs = fresh(spark, sf)
    since = None
    if newest is not None:
        since = candidates.oldest_needed(runs, newest)
        runs = runs.filter(F.lit(since is None) | (F.col("run_id") >= F.lit(since)))
    expiry = F.col("created_at") + F.make_dt_interval(F.lit(0), T.half_life(F.col("primary_domain")).cast("int"))
    dated = rows.withColumns({"expires_at": expiry, "decided_at": F.when(F.col("status") != "new", F.col("updated_at"))})
    pools = trending.without_arxiv(trending.pooled(dated, since), items, sources)
    mornings = runs.filter(F.col("run_kind") == "morning").select("run_id")
    stories = written(trending.daily_stories(pools, only=mornings).join(rows, "candidate_id"), "stories")
    return candidates.pulse_entries(runs, trending.waves(stories))


@query("pulse_selection", f"WITH RECURSIVE {PULSE} SELECT * FROM pulse")
def pulse_selection(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf)


@query("pulse_feed", f"WITH RECURSIVE {PULSE} SELECT run_id, kind, rank, candidate_id, coalesce('https://feeds.example/c/' || CAST(candidate_id AS STRING), 'https://feeds.example/') AS link FROM pulse ORDER BY run_id DESC, rank NULLS LAST LIMIT 50")
def pulse_feed(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.newest_entries(entries(spark, sf, 50))


@query("run_digest", "SELECT CAST(CAST(created_at AS DATE) AS STRING) AS run_id, primary_domain, count(*) AS n, count(*) FILTER (is_exclusive) AS exclusives FROM {candidates} GROUP BY 1, 2")
def run_digest(spark: SparkSession, sf: str) -> DataFrame:
    return fresh(spark, sf).groupBy("run_id", "primary_domain").agg(F.count("*").alias("n"), F.count_if("is_exclusive").alias("exclusives"))


@query("run_funnel", f"""WITH {PASS} SELECT 'run 1' AS run_id, count(*) AS considered, count(*) FILTER (micros > 0) AS advanced, count(*) FILTER (stage = 'archived') AS dropped, count(*) FILTER (decision = 'flag' AND stage NOT IN ('halted', 'failed_summarise')) AS flagged,
count(*) FILTER (stage = 'failed_summarise') AS failed_summarise, count(*) FILTER (stage = 'failed_curate') AS failed_curate, count(*) FILTER (stage = 'halted') AS halted, count(*) FILTER (stage = 'below_cutoff') AS below_cutoff,
count(*) FILTER (stage = 'decided') AS skipped, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'superseded') AS superseded, CAST(sum(micros) AS DOUBLE) / 1000000 AS usd FROM passed""")
def run_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.funnel(one_pass(spark, sf).withColumn("run_id", F.lit("run 1")))


TODAY = "CAST(TIMESTAMP '2001-08-01 00:00:00' AS DATE)"


@query("run_status", f"""SELECT (SELECT count(*) FROM {{raw_items}} WHERE NOT processed AND attempts < 3) AS pending, (SELECT count(*) FROM {{raw_items}} WHERE NOT processed AND attempts >= 3) AS poisoned, (SELECT count(*) FROM {{raw_items}} WHERE processed) AS processed,
(SELECT count(*) FROM {{items}}) AS items, (SELECT count(*) FROM {{clusters}} WHERE status = 'active') AS active_clusters, (SELECT count(*) FROM {{candidates}} WHERE status = 'new' AND expires_at > {NOW}) AS live_pool, (SELECT max(started_at) FROM {{runs}}) AS last_run,
(SELECT max(started_at) FROM {{runs}} WHERE kind IN ('morning', 'afternoon', 'manual')) AS last_scoring_run, (SELECT count(*) FROM {{runs}} WHERE CAST(started_at AS DATE) = {TODAY}) AS runs_today, (SELECT count(*) FROM {{runs}} WHERE CAST(started_at AS DATE) = {TODAY} AND status = 'failed') AS failed_today""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    raw, items, clusters, rows, runs = m(spark, sf, "raw_items", "items", "clusters", "candidates", "runs")
    one = raw.agg(F.count_if(~F.col("processed") & (F.col("attempts") < 3)).alias("pending"), F.count_if(~F.col("processed") & (F.col("attempts") >= 3)).alias("poisoned"), F.count_if("processed").alias("processed"))
    today, scoring_kind = F.to_date("started_at") == F.expr(TODAY), F.col("kind").isin("morning", "afternoon", "manual")
    of_runs = runs.agg(F.max("started_at").alias("last_run"), F.max(F.when(scoring_kind, F.col("started_at"))).alias("last_scoring_run"), F.count_if(today).alias("runs_today"), F.count_if(today & (F.col("status") == "failed")).alias("failed_today"))
    for part in (items.agg(F.count("*").alias("items")), clusters.agg(F.count_if(F.col("status") == "active").alias("active_clusters")), rows.agg(F.count_if(candidates.live(at(NOW))).alias("live_pool")), of_runs):
        one = one.join(F.broadcast(part))  # one row each
    return one


@query("brief_upsert", """WITH weeks AS (SELECT date_trunc('week', created_at) AS week_of, min(candidate_id) AS brief_id, count(*) AS n FROM {candidates} GROUP BY 1), old AS (SELECT * FROM weeks WHERE brief_id % 3 <> 0), new AS (SELECT week_of, brief_id + 1000000 AS brief_id, n + 1 AS n FROM weeks WHERE brief_id % 2 = 0)
SELECT CAST(CAST(week_of AS DATE) AS STRING) AS week_of, coalesce(old.brief_id, new.brief_id) AS brief_id, coalesce(new.n, old.n) AS text, CASE WHEN row_number() OVER (ORDER BY week_of DESC) <= 12 THEN row_number() OVER (ORDER BY week_of DESC) END AS feed_rank FROM old FULL JOIN new USING (week_of)""")
def brief_upsert(spark: SparkSession, sf: str) -> DataFrame:
    weeks = model(spark, sf, "candidates").groupBy(F.date_trunc("week", "created_at").alias("week_of")).agg(F.min("candidate_id").alias("brief_id"), F.count("*").alias("text"))
    new = weeks.filter("brief_id % 2 = 0").select("week_of", (F.col("brief_id") + 1_000_000).alias("brief_id"), (F.col("text") + 1).alias("text"))
    stored = briefs.upsert(weeks.filter("brief_id % 3 <> 0"), new)
    feed = briefs.latest(stored).select("week_of", F.col("rank").alias("feed_rank"))
    return stored.join(F.broadcast(feed), "week_of", "left").withColumn("week_of", F.date_format("week_of", "yyyy-MM-dd"))  # 12 rows


WEEK = ("TIMESTAMP '2001-07-26 00:00:00'", "TIMESTAMP '2001-08-03 00:00:00'")
INSIDE = lambda c: f"({c} >= {WEEK[0]} AND {c} < {WEEK[1]})"
MOVED = "f.created_at - INTERVAL 8200 DAY"  # decisions are made 8200 days after candidates in the given tables


@query("brief_context", f"""WITH {LINKED}, pool AS (SELECT *, row_number() OVER (ORDER BY {BEST}) AS rank FROM (SELECT * FROM {{candidates}} WHERE {INSIDE("created_at")} OR {INSIDE("updated_at")} ORDER BY {BEST} LIMIT 80)),
newest AS (SELECT candidate_id, title, url, row_number() OVER (PARTITION BY candidate_id ORDER BY published_at DESC, source_id, part_id, order_id, line) AS n FROM pool JOIN {{items}} USING (cluster_id)), listed AS (SELECT candidate_id, concat('[', string_agg(CAST(to_json(struct_pack(title := title, url := url)) AS VARCHAR), ',' ORDER BY n), ']') AS sources FROM newest WHERE n <= 5 GROUP BY 1)
SELECT 'candidate' AS kind, rank, candidate_id AS id, status, headline, sources, coalesce(archive_links, '[]') AS archive_links, NULL AS reason, CAST(NULL AS TIMESTAMP) AS decided_at FROM pool LEFT JOIN listed USING (candidate_id) LEFT JOIN linked USING (candidate_id)
UNION ALL SELECT 'decision', NULL, feedback_id, action, headline, NULL, NULL, reason, {MOVED} FROM {{feedback}} f JOIN {{candidates}} c USING (candidate_id) WHERE {INSIDE(MOVED)}""")
def brief_context(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the week and its decisions."""
    rows, (start, end) = with_archive(spark, sf), map(at, WEEK)
    pool = briefs.context(rows, model(spark, sf, "items"), start, end)
    made = briefs.decisions(model(spark, sf, "feedback").alias("f").withColumn("created_at", at(MOVED)), rows, start, end)
    pool = pool.select(F.lit("candidate").alias("kind"), "rank", F.col("candidate_id").alias("id"), "status", "headline", F.to_json("sources").alias("sources"), F.to_json("archive_links").alias("archive_links"))
    made = made.select(F.lit("decision").alias("kind"), F.col("feedback_id").alias("id"), F.col("action").alias("status"), "headline", "reason", F.col("created_at").alias("decided_at"))
    return pool.unionByName(made, allowMissingColumns=True)


# ---- feedback and costs -------------------------------------------------------------------------------------


@query("recalibrate_authority", f"""WITH votes AS (SELECT DISTINCT f.feedback_id, f.action, i.source_id FROM {{feedback}} f JOIN {{candidates}} c USING (candidate_id) JOIN {{items}} i USING (cluster_id) WHERE action IN ('pick', 'pass') AND f.created_at >= {EVENTS_NOW} - INTERVAL 30 DAY),
n AS (SELECT source_id, count(*) FILTER (action = 'pick') AS p, count(*) FILTER (action = 'pass') AS f FROM votes GROUP BY 1)
SELECT source_id, coalesce(p, 0) AS picks, coalesce(f, 0) AS passes, CAST(greatest(1, least(100, floor(100 * ((5.0 * authority_score_seed / 100 + coalesce(p, 0)) / (5.0 + coalesce(p, 0) + coalesce(f, 0))) + 0.5))) AS INT) AS authority_score FROM {{sources}} LEFT JOIN n USING (source_id) WHERE enabled""")
def recalibrate_authority(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.recalibrated(*m(spark, sf, "sources", "feedback", "candidates", "items"), at(EVENTS_NOW))


def rate(i: int) -> str:
    return "CASE model " + " ".join(f"WHEN '{n}' THEN {round(p[i] * 100)}" for n, p in PRICES.items()) + f" ELSE {round(PRICES[DEAREST][i] * 100)} END"


STAGE_BUCKET = "CASE stage " + " ".join(f"WHEN '{s}' THEN '{b}'" for s, b in BUCKETS.items()) + " END"
BRIEF_CEILING = 1.0
CEILING, SHARES = 12.0, {"normalize": 0.6, "orchestrator": 0.8}


@query("cost_ledger_rows", f"SELECT id, CASE WHEN input_tokens >= 0 AND output_tokens >= 0 THEN coalesce(CAST(given_usd AS DOUBLE), CAST(floor((input_tokens * {rate(0)} + output_tokens * {rate(1)} + 50) / 100) / 1000000 AS DOUBLE)) END AS usd, {STAGE_BUCKET} AS bucket, input_tokens >= 0 AND output_tokens >= 0 AS valid FROM {{costs}}")
def cost_ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    return costs.priced(model(spark, sf, "costs")).withColumn("usd", F.col("usd").cast("double"))


DAYS = f"c AS (SELECT *, CAST(occurred_at AS DATE) AS day, {STAGE_BUCKET} AS bucket FROM {{costs}})"


@query("cost_daily", f"""WITH {DAYS}, s AS (SELECT day, 'all' AS bucket, CAST(sum(usd) AS DOUBLE) AS usd FROM c GROUP BY 1 UNION ALL SELECT day, bucket, CAST(sum(usd) AS DOUBLE) FROM c WHERE bucket IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, usd / CASE bucket WHEN 'all' THEN {CEILING} WHEN 'normalize' THEN {CEILING * 0.6}e0 WHEN 'brief' THEN {BRIEF_CEILING}e0 ELSE {CEILING * 0.8}e0 END AS x FROM s) SELECT day, bucket, usd, CAST(round(x, 6) AS DOUBLE) AS pct, x + 1e-9 >= 0.8 AS alert, x + 1e-9 >= 1.0 AS hit FROM p""")
def cost_daily(spark: SparkSession, sf: str) -> DataFrame:
    return costs.daily(model(spark, sf, "costs"), CEILING, SHARES, {"brief": BRIEF_CEILING})


@query("cost_alert_days", f"""WITH {DAYS}, r AS (SELECT day, id, occurred_at, CAST(sum(usd) OVER (PARTITION BY day ORDER BY occurred_at, id) AS DOUBLE) / {CEILING}e0 AS x FROM c) SELECT day, id, CAST(round(least(9.9999, x), 4) AS DOUBLE) AS pct FROM r WHERE x + 1e-9 >= 0.8 QUALIFY row_number() OVER (PARTITION BY day ORDER BY occurred_at, id) = 1""")
def cost_alert_days(spark: SparkSession, sf: str) -> DataFrame:
    return costs.alerts(model(spark, sf, "costs"), CEILING)


@query("budget_gate", f"""WITH {DAYS}, b AS (SELECT *, CAST(coalesce(sum(usd) OVER (PARTITION BY day ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS d, CAST(coalesce(sum(usd) OVER (PARTITION BY day, bucket ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS o FROM c),
j AS (SELECT *, CASE WHEN bucket = 'normalize' AND o + usd::DOUBLE + 1e-9 >= {CEILING * 0.6}e0 OR bucket = 'orchestrator' AND o + usd::DOUBLE + 1e-9 >= {CEILING * 0.8}e0 THEN 'bucket' WHEN d + usd::DOUBLE + 1e-9 >= {CEILING} THEN 'day' END AS scope FROM b),
k AS (SELECT *, sum(CASE WHEN scope IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM j) SELECT id, nth = 0 AS admitted, CASE WHEN nth = 1 THEN scope END AS scope FROM k""")
def budget_gate(spark: SparkSession, sf: str) -> DataFrame:
    return costs.gate(model(spark, sf, "costs"), CEILING, SHARES)


# ---- inbox --------------------------------------------------------------------------------------------------

MAP = "one AS (SELECT row_id, match_field, lower(match_value) AS match_value, slug FROM {sender_map} QUALIFY row_number() OVER (PARTITION BY match_field, lower(match_value) ORDER BY created_at, row_id) = 1)"


@query("sender_map_dedup", f"WITH {MAP} SELECT * FROM one")
def sender_map_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.deduplicated_map(model(spark, sf, "sender_map"))


@query("resolve_sender", f"""WITH {MAP} SELECT s.sender_id, coalesce(a.slug, b.slug, c.slug) AS slug FROM {{senders}} s LEFT JOIN one a ON a.match_field = 'list_id' AND a.match_value = lower(s.list_id) LEFT JOIN one b ON b.match_field = 'from_addr' AND b.match_value = lower(s.from_addr)
LEFT JOIN one c ON c.match_field = 'from_domain' AND c.match_value = lower(split_part(s.from_addr, '@', 2))""")
def resolve_sender(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.resolved(*m(spark, sf, "senders", "sender_map"))


SEEDS = "SELECT CAST(s_suppkey AS INT) AS seed_order, concat('seed-', CAST(s_suppkey AS STRING)) AS seed_slug, concat('MAIL', CAST(s_suppkey % 15 AS STRING), '.example.', CASE WHEN s_suppkey % 4 < 2 THEN 'com' ELSE 'org' END) AS hint, CAST(50 + s_suppkey % 40 AS INT) AS authority FROM {supplier} WHERE s_suppkey % 3 = 1"


@query("match_seeded_publisher", f"""WITH seeds AS ({SEEDS}), s AS (SELECT sender_id, lower(split_part(from_addr, '@', 2)) AS d FROM {{senders}} WHERE from_addr IS NOT NULL)
SELECT sender_id, seed_slug AS slug, authority FROM s JOIN seeds ON d = lower(hint) OR ends_with(d, '.' || lower(hint)) WHERE d NOT IN ({quoted(TRANSPORT_DOMAINS)}) QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY seed_order) = 1""")
def match_seeded_publisher(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.seeded(model(spark, sf, "senders"), spark.sql(SEEDS, supplier=model(spark, sf, "supplier")))


@query("unmatched_senders", """WITH per AS (SELECT list_id, from_addr, min(subject) AS subject, min(headers) AS headers FROM {senders} GROUP BY 1, 2), k AS (SELECT list_id, from_addr, CASE WHEN from_addr LIKE '%@%' THEN lower(split_part(from_addr, '@', 2)) END AS from_domain, subject, headers, CASE WHEN list_id IS NOT NULL THEN 'list_id' WHEN from_addr IS NOT NULL THEN 'from_addr' END AS match_field, lower(coalesce(list_id, from_addr)) AS match_value FROM per)
SELECT * FROM k WHERE match_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {sender_map} s WHERE s.match_field = k.match_field AND lower(s.match_value) = k.match_value)""")
def unmatched_senders(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.unmatched(*m(spark, sf, "senders", "sender_map"))


@query("chosen_link", """WITH l AS (SELECT message_id, url AS link, message_id % 3 AS pos, CASE WHEN message_id % 5 = 0 THEN 'masthead' ELSE 'article' END AS kind FROM {inbox} WHERE message_id % 4 <> 3 UNION ALL SELECT message_id, concat(url, '&second') AS link, 1 AS pos, CASE WHEN message_id % 2 = 0 THEN 'article' ELSE 'social' END AS kind FROM {inbox} WHERE message_id % 4 <> 3),
best AS (SELECT message_id, link FROM l QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY kind <> 'article', pos, link) = 1), newest AS (SELECT * FROM {inbox} QUALIFY row_number() OVER (PARTITION BY slug ORDER BY received_at DESC, message_id) <= 50),
flat AS (SELECT *, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS t FROM newest)
SELECT message_id, coalesce(link, concat('https://inbox.example/items/', slug, '/', CAST(message_id AS STRING))) AS link, CASE WHEN message_id % 6 = 0 THEN '(no subject)' ELSE url END AS title, CASE WHEN length(t) <= 480 THEN t ELSE concat(substr(t, 1, 479), '…') END AS text FROM flat LEFT JOIN best USING (message_id)""")
def chosen_link(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf, "inbox").withColumn("subject", F.when(F.col("message_id") % 6 != 0, F.col("url"))).withColumnRenamed("html", "body")
    some = rows.filter("message_id % 4 <> 3")
    links = some.select("message_id", F.col("url").alias("link"), (F.col("message_id") % 3).alias("pos"), F.expr("CASE WHEN message_id % 5 = 0 THEN 'masthead' ELSE 'article' END").alias("kind")).unionByName(some.select("message_id", F.concat("url", F.lit("&second")).alias("link"), F.lit(1).cast("long").alias("pos"), F.expr("CASE WHEN message_id % 2 = 0 THEN 'article' ELSE 'social' END").alias("kind")))
    return inbox.chosen_links(rows, links)


# ---- coverage -----------------------------------------------------------------------------------------------


@query("coverage_sample", """WITH a AS (SELECT user_id AS query_id, event_type AS outlet, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 23 AS STRING) END AS country, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 7 AS STRING) END AS lang FROM {events}),
o AS (SELECT query_id, outlet, count(*) AS n FROM a GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, outlet) <= 20), l AS (SELECT query_id, string_agg(outlet, ',' ORDER BY n DESC, outlet) AS outlets FROM o GROUP BY 1)
SELECT query_id, count(*) AS samples, count(DISTINCT nullif(country, '')) AS countries, count(DISTINCT nullif(lang, '')) AS languages, any_value(outlets) AS outlets FROM a JOIN l USING (query_id) GROUP BY 1""")
def coverage_sample(spark: SparkSession, sf: str) -> DataFrame:
    from storyloom.operators.coverage import sample_summary

    rows = model(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("outlet"), F.expr("CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 23 AS STRING) END").alias("country"), F.expr("CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 7 AS STRING) END").alias("language"))
    return sample_summary(rows)


@query("coverage_timeline", """SELECT user_id AS query_id, CAST(sum(CASE WHEN event_id % 6 <> 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS total, min(CASE WHEN event_id % 6 <> 0 AND floor(value) > 0 AND event_id % 9 <> 2 THEN date_trunc('second', ts) END) AS first_seen FROM {events} GROUP BY 1""")
def coverage_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Timelines as JSON texts of both shapes, built from events."""
    from storyloom.operators.coverage import timeline_summary

    stamp = F.when(F.col("event_id") % 9 == 2, "no date").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    value = F.when(F.col("event_id") % 6 == 0, -1).otherwise(F.floor("value"))
    point = F.struct(stamp.alias("date"), value.alias("value"))
    rows = model(spark, sf, "events").groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 2 == 0).alias("nested")).agg(F.collect_list(point).alias("p"))
    nested = F.to_json(F.struct(F.array(F.struct(F.lit("volume").alias("series"), F.col("p").alias("data"))).alias("timeline")))
    return timeline_summary(rows.select("query_id", F.when(F.col("nested"), nested).otherwise(F.to_json(F.struct(F.col("p").alias("timeline")))).alias("raw")))


