"""Scalar functions over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import urls as U
from storyloom.operators.briefs import TEXTS, valid_pitches
from storyloom.plans.catalog import query
from storyloom.schemas import BOILERPLATE, DOMAINS, LINK_TRACKING_NAMES, MASTHEAD_LINKS, SOCIAL_HOSTS, TAGS, TRACKING_LINKS, TRACKING_NAMES, TRACKING_PREFIXES
from storyloom.sources.lens import model

quoted = lambda names: ", ".join(f"'{n}'" for n in names)
either = lambda patterns: "|".join(f"(?:{p})" for p in patterns).replace("{4}", "{{4}}")
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"

CANONICAL = rf"""u AS (SELECT *, regexp_extract(trim(url), '{URL}', 1) AS s, regexp_extract(trim(url), '{URL}', 2) AS a, regexp_extract(trim(url), '{URL}', 3) AS p, regexp_extract(trim(url), '{URL}', 4) AS q FROM {{pages}}),
parts AS (SELECT page_id, unnest(string_split(substr(q, 2), '&')) AS x, generate_subscripts(string_split(substr(q, 2), '&'), 1) AS i FROM u WHERE q <> ''),
joined AS (SELECT page_id, string_agg(replace(x, '%20', '+'), '&' ORDER BY string_split(x, '=')[1], i) AS q FROM parts
  WHERE x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({quoted(TRACKING_NAMES)}) AND NOT regexp_matches(lower(string_split(x, '=')[1]), '^({"|".join(TRACKING_PREFIXES)})') GROUP BY page_id),
canon AS (SELECT u.page_id, u.url, CASE WHEN s = '' THEN trim(url) ELSE concat(lower(s), '://', regexp_replace(lower(a), '^www\.', ''), CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END, CASE WHEN j.q IS NULL THEN '' ELSE concat('?', j.q) END) END AS c FROM u LEFT JOIN joined j USING (page_id))"""


HASHED = CANONICAL + r""", h AS (SELECT r.raw_id, r.source_id, r.external_id, r.published_at, sha256(c.c) AS url_hash, sha256(trim(regexp_replace(regexp_replace(lower(r.title), '[\p[[P]]\p[[S]]]+', ' ', 'g'), '\s+', ' ', 'g'))) AS title_hash
 FROM {raw_items} r JOIN (SELECT DISTINCT url, c FROM canon) c ON c.url = r.url)"""


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("raw_id", "source_id", "external_id", "published_at", T.url_hash(F.col("url")).alias("url_hash"), T.title_hash(F.col("title")).alias("title_hash"))


@query("canonical_url", f"WITH {CANONICAL} SELECT page_id, c AS canonical_url FROM canon")
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"))


@query("normalise_title", r"SELECT raw_id, trim(regexp_replace(regexp_replace(lower(title), '[\p[[P]]\p[[S]]]+', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM {raw_items}")
def normalise_title(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "raw_items").select("raw_id", T.normalised_title(F.col("title")).alias("title"))


@query("url_title_hash", rf"WITH {CANONICAL} SELECT r.raw_id, sha256(c.c) AS url_hash, sha256(trim(regexp_replace(regexp_replace(lower(r.title), '[\p[[P]]\p[[S]]]+', ' ', 'g'), '\s+', ' ', 'g'))) AS title_hash FROM {{raw_items}} r JOIN canon c ON c.url = r.url GROUP BY ALL")
def url_title_hash(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "raw_items").select("raw_id", T.url_hash(F.col("url")).alias("url_hash"), T.title_hash(F.col("title")).alias("title_hash"))


@query("normalise_headline", r"SELECT candidate_id, trim(regexp_replace(lower(headline), '[^\p[[L]]\p[[N]]]+', ' ', 'g')) AS headline FROM {candidates}")
def normalise_headline(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "candidates").select("candidate_id", T.normalised_headline(F.col("headline")).alias("headline"))


@query("query_hash", """SELECT candidate_id, sha256(concat('[[', '"query":"', lower(headline), '","startDate":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z'), '","endDate":"', strftime(expires_at, '%Y-%m-%dT%H:%M:%S.000Z'), '"]]')) AS query_hash, strftime(created_at, '%Y%m%d%H%M%S') AS start_compact FROM {candidates}""")
def query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "candidates").select("candidate_id", T.query_hash(F.concat(F.lit("  "), "headline"), F.col("created_at"), F.col("expires_at")).alias("query_hash"), F.date_format("created_at", "yyyyMMddHHmmss").alias("start_compact"))


BODY = "concat(CASE WHEN raw_id % 4 = 0 THEN concat('View this email in your browser', chr(10)) ELSE '' END, content, chr(10), CASE WHEN raw_id % 3 = 0 THEN concat('  Unsubscribe here', chr(10), 'tail') ELSE CASE WHEN raw_id % 5 = 0 THEN concat('© 2024 someone', chr(10), 'Copyright © someone') ELSE 'the end' END END, '  ')"


@query("strip_boilerplate", rf"""WITH lines AS (SELECT raw_id, unnest(string_split({BODY}, chr(10))) AS x, generate_subscripts(string_split({BODY}, chr(10)), 1) AS i FROM {{raw_items}}),
flags AS (SELECT *, regexp_matches(lower(x), '{either(BOILERPLATE).replace("{{4}}", "[[4]]")}') AS footer FROM lines),
first AS (SELECT raw_id, min(i) AS c FROM flags WHERE trim(x) <> '' AND NOT footer GROUP BY raw_id),
cut AS (SELECT f.raw_id, min(i) AS k FROM flags f JOIN first USING (raw_id) WHERE footer AND i > c GROUP BY f.raw_id)
SELECT raw_id, regexp_replace(string_agg(x, chr(10) ORDER BY i), '\s+$', '') AS body FROM lines LEFT JOIN cut USING (raw_id) WHERE i < coalesce(k, 1000000000) GROUP BY raw_id""")
def strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf, "raw_items").withColumn("raw", F.expr(BODY.replace("'© 2024", "'© 2024")))
    return rows.select("raw_id", T.without_boilerplate(F.col("raw")).alias("body"))


LINKS = r"""found AS (SELECT page_id, url, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS l FROM {pages})),
good AS (SELECT page_id, url, trim(link) AS link, min(i) AS i FROM found WHERE trim(link) <> '' AND NOT regexp_matches(trim(link), '^(#|mailto:|javascript:|tel:)') AND NOT regexp_matches(link, '(?i)\b(unsubscribe|email[-_ ]?preferences|opt[-_ ]?out)\b') GROUP BY 1, 2, 3),
links AS (SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM good)"""


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "pages").select("page_id", "url", F.posexplode(T.links(F.col("html"), F.lit(None).cast("string"))).alias("pos", "link"))


@query("extract_links", f"WITH {LINKS} SELECT page_id, pos, link FROM links")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(spark, sf).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


KIND = rf"""CASE WHEN NOT regexp_matches(l, '{URL}') THEN 'other'
 WHEN regexp_replace(lower(regexp_extract(l, '{URL}', 2)), '^www\.', '') IN ({quoted(SOCIAL_HOSTS)}) THEN 'social'
 WHEN regexp_matches(lower(concat(regexp_extract(l, '{URL}', 3), regexp_extract(l, '{URL}', 4))), '{either(TRACKING_LINKS)}') THEN 'tracking'
 WHEN regexp_matches(lower(concat(regexp_extract(l, '{URL}', 3), regexp_extract(l, '{URL}', 4))), '{either(MASTHEAD_LINKS)}') THEN 'masthead'
 WHEN regexp_extract(l, '{URL}', 3) IN ('', '/') AND len([x FOR x IN string_split(substr(regexp_extract(l, '{URL}', 4), 2), '&') IF x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({quoted(LINK_TRACKING_NAMES)})]) = 0 THEN 'masthead' ELSE 'article' END"""
TRIED = """all_links AS (SELECT page_id, pos, link AS l FROM links UNION ALL SELECT page_id, pos + 1000, concat(regexp_extract(url, '^https?://[^/?#]+'), link) FROM links UNION ALL SELECT page_id, -1, url FROM {pages}
 UNION ALL SELECT page_id, -2, concat(regexp_extract(url, '^https?://[^/?#]+'), CASE page_id % 4 WHEN 0 THEN '/?utm_source=a&mc_cid=b' WHEN 1 THEN '/view-in-browser?x=1' WHEN 2 THEN '/open.gif' ELSE '?id=1' END) FROM {pages}
 UNION ALL SELECT page_id, -3, concat('https://www.', CASE page_id % 3 WHEN 0 THEN 'x.com/a' WHEN 1 THEN 't.me/b' ELSE 'example.com/x.com' END) FROM {pages})"""


@query("classify_link", f"WITH {LINKS}, {TRIED} SELECT page_id, pos, l AS link, {KIND} AS kind FROM all_links")
def classify_link(spark: SparkSession, sf: str) -> DataFrame:
    links, pages = page_links(spark, sf), model(spark, sf, "pages")
    root = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    tail = F.expr("CASE page_id % 4 WHEN 0 THEN '/?utm_source=a&mc_cid=b' WHEN 1 THEN '/view-in-browser?x=1' WHEN 2 THEN '/open.gif' ELSE '?id=1' END")
    share = F.expr("concat('https://www.', CASE page_id % 3 WHEN 0 THEN 'x.com/a' WHEN 1 THEN 't.me/b' ELSE 'example.com/x.com' END)")
    tried = links.select("page_id", "pos", "link").unionByName(links.select("page_id", (F.col("pos") + 1000).alias("pos"), F.concat(root, "link").alias("link")))
    for at, link in ((-1, F.col("url")), (-2, F.concat(root, tail)), (-3, share)):
        tried = tried.unionByName(pages.select("page_id", F.lit(at).alias("pos"), link.alias("link")))
    return tried.select("page_id", F.col("pos").cast("long").alias("pos"), "link", U.link_kind(F.col("link")).alias("kind"))


@query("message_id", """SELECT message_id AS row_id, CASE WHEN message_id % 3 = 0 THEN concat('<m', CAST(message_id AS STRING), '@host>') ELSE concat('<synth-', substr(sha256(concat(url, chr(10), slug, chr(10), '', chr(10), substr(html, 1, 4096))), 1, 32), '@inbox.example>') END AS message_id FROM {inbox}""")
def message_ids(spark: SparkSession, sf: str) -> DataFrame:
    header = F.when(F.col("message_id") % 3 == 0, F.concat(F.lit("<m"), F.col("message_id").cast("string"), F.lit("@host>")))
    return model(spark, sf, "inbox").select(F.col("message_id").alias("row_id"), T.message_id(header, F.col("url"), F.col("slug"), F.lit(None).cast("string"), F.lit(""), F.col("html")).alias("message_id"))


@query("embedding_input", """SELECT raw_id, concat(title, chr(10), chr(10), url, CASE WHEN raw_id % 2 = 0 THEN concat(chr(10), 'Entities: ', external_id, ', ', CAST(source_id AS STRING)) ELSE '' END) AS input FROM {raw_items}""")
def embedding_input(spark: SparkSession, sf: str) -> DataFrame:
    entities = F.when(F.col("raw_id") % 2 == 0, F.array(F.col("external_id"), F.col("source_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return model(spark, sf, "raw_items").select("raw_id", T.embedding_input(F.col("title"), F.col("url"), entities).alias("input"))


HALF_LIFE = "CASE primary_domain " + " ".join(f"WHEN '{n}' THEN {h}" for n, (h, _, _) in DOMAINS.items()) + " END"


@query("recency_decay", f"""SELECT cluster_id, source_id, part_id, line, order_id, round(CASE WHEN h <= 0 THEN 1 ELSE exp(-ln(2) * h / {HALF_LIFE}) END, 9) AS decay, round(authority_score * CASE WHEN h <= 0 THEN 1 ELSE exp(-ln(2) * h / {HALF_LIFE}) END, 7) AS authority_weighted
FROM (SELECT i.*, s.authority_score, date_diff('second', published_at, TIMESTAMP '2001-08-01 00:00:00') / 3600.0 AS h FROM {{items}} i JOIN {{sources}} s USING (source_id))""")
def recency_decay(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf, "items").join(model(spark, sf, "sources").select("source_id", "authority_score"), "source_id")
    decay = T.recency_decay(F.col("published_at"), F.expr("TIMESTAMP '2001-08-01 00:00:00'"), F.col("primary_domain"))
    return rows.select("cluster_id", "source_id", "part_id", "line", "order_id", F.round(decay, 9).alias("decay"), F.round(F.col("authority_score") * decay, 7).alias("authority_weighted"))


@query("candidate_expiry", f"SELECT candidate_id, created_at + to_hours({HALF_LIFE}) AS expires_at FROM {{candidates}}")
def candidate_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "candidates").select("candidate_id", (F.col("created_at") + F.make_dt_interval(F.lit(0), T.half_life(F.col("primary_domain")).cast("int"))).alias("expires_at"))


ITEM_JSON = """CASE raw_id % 9 WHEN 6 THEN 'not json at all' WHEN 8 THEN '[1, 2]' ELSE concat(CASE WHEN raw_id % 9 = 4 THEN concat('```json', chr(10)) ELSE '' END, '[[', CASE WHEN raw_id % 9 = 1 THEN '' ELSE '"summary_en": "a summary", ' END, '"context_en": "c", "entities": ["e"], "domains": ["economy", "', CASE WHEN raw_id % 9 = 2 THEN 'sports' ELSE 'scitech' END, '"], "primary_domain": "', CASE WHEN raw_id % 9 = 5 THEN 'national' ELSE 'economy' END, '", "keywords": ', CASE raw_id % 9 WHEN 3 THEN '["a", "b"]' WHEN 7 THEN '["a", 2, "c"]' ELSE '["a", "b", "c"]' END, ']]', CASE WHEN raw_id % 9 = 4 THEN concat(chr(10), '```') ELSE '' END) END"""
CLEAN = r"trim(regexp_replace(regexp_replace(j, '(?i)^\s*```[a-z0-9]*\s*\n?', ''), '```\s*$', ''))"
STRINGS = lambda p: f"(json_type(v, '{p}') = 'ARRAY' AND len([x FOR x IN CAST(json_extract(v, '{p}[*]') AS JSON[]) IF json_type(x) <> 'VARCHAR']) = 0)"
TEXT = lambda p: f"(json_type(v, '{p}') = 'VARCHAR' AND length(json_extract_string(v, '{p}')) > 0)"


@query("validate_items", f"""WITH raw AS (SELECT raw_id, {ITEM_JSON} AS j FROM {{raw_items}}), parsed AS (SELECT raw_id, CASE WHEN json_valid({CLEAN}) THEN CAST({CLEAN} AS JSON) END AS v FROM raw)
SELECT raw_id, CASE WHEN v IS NULL THEN 'json' WHEN json_type(v) <> 'OBJECT' THEN 'object' WHEN NOT coalesce({TEXT('$.summary_en')} AND {TEXT('$.context_en')} AND {TEXT('$.primary_domain')}, false) THEN 'text'
 WHEN NOT coalesce({STRINGS('$.entities')} AND {STRINGS('$.domains')} AND {STRINGS('$.keywords')}, false) THEN 'list'
 WHEN len([x FOR x IN CAST(json_extract_string(v, '$.domains[*]') AS VARCHAR[]) IF x NOT IN ({quoted(DOMAINS)})]) > 0 THEN 'domain'
 WHEN NOT list_contains(CAST(json_extract_string(v, '$.domains[*]') AS VARCHAR[]), json_extract_string(v, '$.primary_domain')) THEN 'primary'
 WHEN json_array_length(v, '$.keywords') NOT BETWEEN 3 AND 7 THEN 'keywords' END AS failure FROM parsed""")
def validate_items(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "raw_items").select("raw_id", T.item_failure(F.expr(ITEM_JSON.replace("[[", "{").replace("]]", "}"))).alias("failure"))


SUMMARY_JSON = """concat('[[', '"headline": "', CASE WHEN candidate_id % 8 = 1 THEN '' ELSE 'h' END, '", "context_summary": "c", "keywords": ["a", "b", "c", "d"', CASE WHEN candidate_id % 8 = 2 THEN '' ELSE ', "e"' END, '], "tags": ', CASE candidate_id % 8 WHEN 3 THEN '"ai-safety"' WHEN 4 THEN '["geopolitics", "ai-safety", "ai-safety", "inequality", "biosecurity", "climate-policy"]' WHEN 5 THEN '[]' ELSE '["inequality", "sports"]' END, ']]')"""


@query("validate_summaries", f"""WITH parsed AS (SELECT candidate_id, CAST({SUMMARY_JSON} AS JSON) AS v FROM {{candidates}}),
judged AS (SELECT candidate_id, v, CASE WHEN NOT coalesce({TEXT('$.headline')} AND {TEXT('$.context_summary')}, false) THEN 'text' WHEN NOT coalesce({STRINGS('$.keywords')} AND {STRINGS('$.tags')}, false) THEN 'list' WHEN json_array_length(v, '$.keywords') NOT BETWEEN 5 AND 8 THEN 'keywords' END AS failure FROM parsed),
tags AS (SELECT candidate_id, t, min(i) AS i FROM (SELECT candidate_id, unnest(CAST(json_extract_string(v, '$.tags[*]') AS VARCHAR[])) AS t, generate_subscripts(CAST(json_extract_string(v, '$.tags[*]') AS VARCHAR[]), 1) AS i FROM judged WHERE failure IS NULL) WHERE t IN ({quoted(TAGS)}) GROUP BY 1, 2),
kept AS (SELECT candidate_id, string_agg(t, ',' ORDER BY i) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY i) AS r FROM tags) WHERE r <= 3 GROUP BY 1)
SELECT j.candidate_id, failure, CASE WHEN failure IS NULL THEN coalesce(tags, '') END AS tags, CASE WHEN failure IS NULL THEN CAST(len([x FOR x IN CAST(json_extract_string(v, '$.tags[*]') AS VARCHAR[]) IF x NOT IN ({quoted(TAGS)})]) AS BIGINT) END AS dropped FROM judged j LEFT JOIN kept USING (candidate_id)""")
def validate_summaries(spark: SparkSession, sf: str) -> DataFrame:
    failure, tags, dropped = T.summary_failure(F.expr(SUMMARY_JSON.replace("[[", "{").replace("]]", "}")))
    return model(spark, sf, "candidates").select("candidate_id", failure.alias("failure"), F.when(failure.isNull(), F.array_join(tags, ",")).alias("tags"), F.when(failure.isNull(), dropped.cast("long")).alias("dropped"))


CURATION_JSON = """CASE WHEN candidate_id % 7 = 6 THEN 'nope' ELSE concat('[[', '"curation_score": ', CASE candidate_id % 7 WHEN 1 THEN '"80"' WHEN 2 THEN '101' WHEN 3 THEN '55.5' ELSE CAST(candidate_id % 100 AS STRING) END, ', "curation_rationale": "', CASE WHEN candidate_id % 7 = 4 THEN '' ELSE 'why' END, '"', CASE WHEN candidate_id % 7 = 5 THEN ',' ELSE '' END, ' ]]') END"""


@query("validate_curations", rf"""WITH raw AS (SELECT candidate_id, {CURATION_JSON} AS j FROM {{candidates}}), parsed AS (SELECT candidate_id, CASE WHEN json_valid(j) THEN CAST(j AS JSON) WHEN json_valid(regexp_replace(j, ',(\s*[]]\x5D])', '\1', 'g')) THEN CAST(regexp_replace(j, ',(\s*[]]\x5D])', '\1', 'g') AS JSON) END AS v FROM raw),
judged AS (SELECT *, CASE WHEN v IS NULL THEN 'json' WHEN json_type(v, '$.curation_score') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN CAST(json_extract(v, '$.curation_score') AS DOUBLE) NOT BETWEEN 0 AND 100 THEN 'range' WHEN NOT coalesce({TEXT('$.curation_rationale')}, false) THEN 'text' END AS failure FROM parsed)
SELECT candidate_id, failure, CASE WHEN failure IS NULL THEN CAST(json_extract(v, '$.curation_score') AS DOUBLE) END AS score FROM judged""")
def validate_curations(spark: SparkSession, sf: str) -> DataFrame:
    failure, score = T.curation_failure(F.expr(CURATION_JSON.replace("[[", "{").replace("]]", "}")))
    return model(spark, sf, "candidates").select("candidate_id", failure.alias("failure"), score.alias("score"))


@query("curation_cutoff", """SELECT primary_domain, count(*) FILTER (curation_score >= 60) AS kept, count(*) FILTER (curation_score < 60) AS below FROM {candidates} GROUP BY 1""")
def curation_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "candidates").groupBy("primary_domain").agg(F.count_if(F.col("curation_score") >= 60).alias("kept"), F.count_if(F.col("curation_score") < 60).alias("below"))


PUBLISHER_JSON = """concat('Sure: [[', '"slug": "', CASE WHEN source_id % 6 = 1 THEN 'Bad Slug' ELSE concat('Pub-', CAST(source_id AS STRING)) END, '", "name": "', CASE WHEN source_id % 6 = 2 THEN '' ELSE name END, '", "primary_domain": "economy", "domains": ["sports", "', CASE WHEN source_id % 6 = 3 THEN 'scitech' ELSE 'economy' END, '", "national"], "authority": ', CASE WHEN source_id % 6 = 4 THEN '"high"' ELSE concat(CAST(authority_score + 10 AS STRING), '.5') END, ', "language": "', CASE WHEN source_id % 6 = 5 THEN '' ELSE 'de' END, '", "reasoning": ', CASE WHEN source_id % 7 = 3 THEN '12' ELSE concat('"', repeat('r', CAST(480 + source_id % 40 AS INT)), '"') END, ' ]] done')"""


@query("validate_publishers", f"""WITH parsed AS (SELECT source_id, CAST(regexp_extract({PUBLISHER_JSON}, '(?s)(\\[[.*\\]])', 1) AS JSON) AS v FROM {{sources}}),
judged AS (SELECT source_id, v, [x FOR x IN CAST(json_extract_string(v, '$.domains[*]') AS VARCHAR[]) IF x IN ({quoted(DOMAINS)})] AS ds FROM parsed),
final AS (SELECT *, CASE WHEN NOT regexp_matches(lower(json_extract_string(v, '$.slug')), '^[a-z0-9][a-z0-9-]*$') THEN 'slug' WHEN json_extract_string(v, '$.primary_domain') NOT IN ({quoted(DOMAINS)}) THEN 'domain' WHEN len(ds) = 0 OR ds[1] <> json_extract_string(v, '$.primary_domain') THEN 'domains' WHEN json_type(v, '$.authority') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'authority' WHEN NOT {TEXT('$.name')} THEN 'name' END AS failure FROM judged)
SELECT source_id, failure, CASE WHEN failure IS NULL THEN greatest(0, least(100, CAST(floor(CAST(json_extract(v, '$.authority') AS DOUBLE) + 0.5) AS INT))) END AS authority, CASE WHEN failure IS NULL THEN CASE WHEN {TEXT('$.language')} THEN json_extract_string(v, '$.language') ELSE 'en' END END AS language,
CASE WHEN failure IS NULL THEN lower(json_extract_string(v, '$.slug')) END AS slug, CASE WHEN failure IS NULL THEN json_extract_string(v, '$.name') END AS name, CASE WHEN failure IS NULL THEN array_to_string(ds, ',') END AS domains, CASE WHEN failure IS NULL THEN CASE WHEN {TEXT('$.reasoning')} THEN substr(json_extract_string(v, '$.reasoning'), 1, 500) ELSE '' END END AS reasoning FROM final""")
def validate_publishers(spark: SparkSession, sf: str) -> DataFrame:
    rows = model(spark, sf, "sources").select("source_id", T.publisher(F.expr(PUBLISHER_JSON.replace("[[", "{").replace("]]", "}"))).alias("p"))
    return rows.select("source_id", *(f"p.{n}" for n in ("failure", "authority", "language", "slug", "name")), F.array_join("p.domains", ",").alias("domains"), "p.reasoning")


@query("week_window", """SELECT candidate_id, CAST(w AS STRING) AS week_of, w - 6 AS first_day, w + 1 AS last_day, CASE WHEN candidate_id % 10 = 3 THEN false ELSE true END AS valid FROM (SELECT candidate_id, CAST(created_at AS DATE) AS w FROM {candidates})""".replace("CAST(w AS STRING) AS week_of", "CASE WHEN candidate_id % 10 = 3 THEN '2001-02-30' ELSE CAST(w AS STRING) END AS week_of").replace("w - 6 AS first_day, w + 1 AS last_day", "CASE WHEN candidate_id % 10 <> 3 THEN CAST(w - 6 AS STRING) END AS first_day, CASE WHEN candidate_id % 10 <> 3 THEN CAST(w + 1 AS STRING) END AS last_day"))
def week_window(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("candidate_id") % 10 == 3, "2001-02-30").otherwise(F.date_format("created_at", "yyyy-MM-dd"))
    rows = model(spark, sf, "candidates").select("candidate_id", given.alias("week_of")).withColumn("day", F.try_to_date("week_of", "yyyy-MM-dd"))
    rows = rows.withColumn("valid", F.coalesce(F.date_format("day", "yyyy-MM-dd") == F.col("week_of"), F.lit(False)))
    bound = lambda days: F.when(F.col("valid"), F.date_format(F.date_add("day", days), "yyyy-MM-dd"))
    return rows.select("candidate_id", "week_of", bound(-6).alias("first_day"), bound(1).alias("last_day"), "valid")


ESCAPES = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '{}')"


@query("text_escape", "SELECT page_id, sha256(" + ESCAPES.format("html", "&#39;").replace("html", "html") + ") AS html_sha, sha256(" + ESCAPES.format(r"regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')", "&apos;") + ") AS xml_sha FROM {pages}")
def text_escape(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "pages").select("page_id", F.sha2(T.escaped(F.col("html"), "&#39;", False), 256).alias("html_sha"), F.sha2(T.escaped(F.col("html"), "&apos;", True), 256).alias("xml_sha"))


PITCH_JSON = """concat('[[ "hook": " ', headline, '", "thesis": " t ", "steelman": "s", "break": "b", "why_now": "w", "fit": "', CASE WHEN candidate_id % 11 = 10 THEN ' ' ELSE ' fits' END, '", "collision": ', CASE candidate_id % 3 WHEN 0 THEN '" "' WHEN 1 THEN '" clash "' ELSE 'null' END,
 ', "evidence": [ [[ "title": "made up", "url": "https://none.example/" ]], [[ "title": "own", "url": "https://news.example/', CAST(candidate_id AS STRING), CASE WHEN candidate_id % 13 = 5 THEN '/none' ELSE '/1' END, '" ]], [[ "title": 3, "url": "https://news.example/', CAST(candidate_id AS STRING), '/2" ]], [[ "title": "third", "url": "https://news.example/', CAST(candidate_id AS STRING), '/3" ]] ], "candidate_ids": [ "none", "', CAST(candidate_id + 1 AS STRING), '", ', CAST(candidate_id AS STRING), ', "', CAST(candidate_id AS STRING), '" ] ]]')"""
FULL = lambda name: f"nullif(trim(CASE WHEN json_type(v, '$.{name}') = 'VARCHAR' THEN json_extract_string(v, '$.{name}') END), '')"


@query("validate_pitches", f"""WITH raw AS (SELECT cluster_id AS response_id, CAST(concat('[[ "pitches": [ ', string_agg({PITCH_JSON}, ', ' ORDER BY candidate_id), ' ] ]]') AS JSON) AS j FROM {{candidates}} GROUP BY 1),
pitch AS (SELECT response_id, unnest(l) AS v, generate_subscripts(l, 1) AS n FROM (SELECT response_id, CAST(json_extract(j, '$.pitches') AS JSON[]) AS l FROM raw)),
entry AS (SELECT response_id, n, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT response_id, n, CAST(json_extract(v, '$.evidence') AS JSON[]) AS l FROM pitch)),
kept AS (SELECT response_id, n, concat('[', string_agg(CAST(to_json(struct_pack(title := json_extract_string(e, '$.title'), url := json_extract_string(e, '$.url'))) AS VARCHAR), ',' ORDER BY i), ']') AS evidence FROM entry WHERE json_type(e, '$.title') = 'VARCHAR' AND EXISTS (SELECT 1 FROM {{items}} k WHERE k.cluster_id = response_id AND k.url = json_extract_string(e, '$.url')) GROUP BY 1, 2),
named AS (SELECT response_id, n, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT response_id, n, CAST(json_extract(v, '$.candidate_ids') AS JSON[]) AS l FROM pitch)),
ids AS (SELECT response_id, n, count(*) AS m, concat('[', string_agg(CAST(e AS VARCHAR), ',' ORDER BY i), ']') AS candidate_ids FROM named WHERE json_type(e) = 'VARCHAR' AND EXISTS (SELECT 1 FROM {{candidates}} k WHERE k.cluster_id = response_id AND CAST(k.candidate_id AS STRING) = json_extract_string(e, '$')) GROUP BY 1, 2),
clean AS (SELECT p.response_id, n, coalesce(m, 0) AS m, evidence IS NOT NULL AND {" AND ".join(f"{FULL(x)} IS NOT NULL" for x in TEXTS)} AS good,
 CAST(to_json(struct_pack({", ".join(f'"{x}" := {FULL(x)}' for x in (*TEXTS, "collision"))}, evidence := CAST(evidence AS JSON), candidate_ids := CAST(coalesce(candidate_ids, '[]') AS JSON))) AS VARCHAR) AS text FROM pitch p LEFT JOIN kept USING (response_id, n) LEFT JOIN ids USING (response_id, n))
SELECT response_id, bool_and(good) AND count(*) <= 6 AS valid, count(*) AS pitches, CAST(sum(m) AS BIGINT) AS known_ids, CASE WHEN bool_and(good) AND count(*) <= 6 THEN concat('[', string_agg(text, ',' ORDER BY n), ']') END AS cleaned FROM clean GROUP BY 1""")
def validate_pitches(spark: SparkSession, sf: str) -> DataFrame:
    """A response for each cluster, with a pitch for each of its candidates: evidence must be an item of the cluster, ids its candidates."""
    one = F.expr(PITCH_JSON.replace("[[", "{").replace("]]", "}"))
    rows = model(spark, sf, "candidates").withColumnRenamed("cluster_id", "response_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", one.alias("text")))), lambda x: x["text"])
    responses = rows.groupBy("response_id").agg(F.concat(F.lit('{ "pitches": [ '), F.array_join(listed, ", "), F.lit(" ] }")).alias("raw"))
    urls = model(spark, sf, "items").select(F.col("cluster_id").alias("response_id"), "url")
    return valid_pitches(responses, urls, rows.select("response_id", F.col("candidate_id").cast("string").alias("id")))
