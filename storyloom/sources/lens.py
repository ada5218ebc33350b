"""The given tables seen as the news-signal model: one text for each model table, in Spark's or DuckDB's dialect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from storyloom.schemas import TAGS

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def hours(self, x: str) -> str:
        return f"to_hours(CAST({x} AS BIGINT))" if self.duck else f"make_dt_interval(0, CAST({x} AS INT), 0, 0)"

    def array(self, *parts: str) -> str:
        return f"{'list_value' if self.duck else 'array'}({', '.join(parts)})"

    def element(self, array: str, at: str) -> str:
        return f"{'list_extract' if self.duck else 'element_at'}({array}, CAST({at} AS INT))"

    def paged(self) -> str:
        """Documents d with their pages p. Spark would meet documents and pages by a filter on both before it joins their number, all pairs: there the page's key is a column of its own."""
        n = "(SELECT count(*) AS n FROM {pages}) k"
        if self.duck:
            return f"FROM {{documents}} d CROSS JOIN {n} JOIN {{pages}} p ON p.page_id = d.doc_id % k.n"
        return f"FROM (SELECT x.*, x.doc_id % k.n AS page FROM {{documents}} x CROSS JOIN {n}) d JOIN {{pages}} p ON p.page_id = d.page"


def domain(x: str) -> str:
    return f"CASE CAST({x} AS BIGINT) % 5 WHEN 0 THEN 'economy' WHEN 1 THEN 'economics' WHEN 2 THEN 'scitech' WHEN 3 THEN 'geopolitics' ELSE 'national' END"


def texts(d: Dialect) -> dict[str, str]:
    h = d.hours
    tag = lambda x: d.element(d.array(*(f"'{t}'" for t in TAGS)), f"{x} % 12 + 1")
    word = lambda k: f"concat('kw-', CAST((o_orderkey * {k}) % 97 AS STRING))"
    cluster = "CAST(floor(o_orderkey / 3) AS BIGINT)"
    return {
        "sources": """SELECT s_suppkey AS source_id, s_name AS name, CASE WHEN s_suppkey % 5 < 3 THEN 'arxiv' WHEN s_suppkey % 5 = 3 THEN 'rss' ELSE 'email_bridge' END AS kind,
            CAST(40 + (s_suppkey * 37) % 60 AS INT) AS authority_score, CAST(30 + (s_suppkey * 53) % 70 AS INT) AS authority_score_seed, s_suppkey % 10 <> 9 AS enabled FROM {supplier}""",
        "items": f"""SELECT CAST(floor(l_orderkey / 3) AS BIGINT) AS cluster_id, l_suppkey AS source_id, l_shipdate + {h("l_partkey % 24")} AS published_at, l_partkey AS part_id, l_orderkey AS order_id, l_linenumber AS line, concat('Item ', CAST(l_partkey AS STRING)) AS title, concat('https://news.example/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS url,
            l_shipdate + {h("l_partkey % 24 + l_orderkey % 48")} AS observed_at, {domain("floor(l_orderkey / 3)")} AS primary_domain, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 50 AS DOUBLE) END AS authority_weighted FROM {{lineitem}} WHERE l_shipdate + {h("l_partkey % 24")} <= {AS_OF}""",
        "clusters": """SELECT cluster_id, min(published_at) AS first_seen_at, max(published_at) AS last_seen_at, count(*) AS item_count, min(primary_domain) AS primary_domain,
            CASE WHEN cluster_id % 11 = 0 THEN 'merged' WHEN cluster_id % 13 = 0 THEN 'archived' ELSE 'active' END AS status FROM {items} GROUP BY cluster_id""",
        "candidates": f"""SELECT o_orderkey AS candidate_id, {cluster} AS cluster_id, concat('Story ', CAST((o_orderkey * 31) % 4000 AS STRING)) AS headline, {domain(cluster)} AS primary_domain,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'hot' WHEN '2-HIGH' THEN 'over_saturated' WHEN '5-LOW' THEN 'cold' ELSE 'warm' END AS temperature,
            CASE o_orderkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'rising' WHEN 2 THEN 'peaking' ELSE 'declining' END AS trajectory, o_orderkey % 17 = 0 AS is_exclusive,
            CAST((o_orderkey * 7919) % 10000 AS DOUBLE) / 100 AS curation_score, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'passed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'picked' ELSE 'deferred' END END AS status,
            o_orderdate + {h("o_orderkey % 24")} AS created_at, o_orderdate + {h("o_orderkey % 24 + 21600")} AS expires_at, o_orderdate + {h("o_orderkey % 24 + o_orderkey % 9 * 120")} AS updated_at,
            {d.array(word(3), word(5), word(7))} AS keywords, {d.array(tag("o_orderkey"), tag("(o_orderkey * 5 + 1)"))} AS tags FROM {{orders}}""",
        "runs": """SELECT date_trunc('hour', created_at) AS started_at, CASE hour(created_at) % 4 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' WHEN 2 THEN 'manual' ELSE 'backfill' END AS kind,
            CASE WHEN hour(created_at) % 6 = 5 THEN 'failed' ELSE 'done' END AS status, count(*) AS fresh FROM {candidates} GROUP BY 1, 2, 3""",
        "feedback": """SELECT event_id AS feedback_id, (event_id * 13) % k.n AS candidate_id, CASE event_type WHEN 'purchase' THEN 'pick' WHEN 'error' THEN 'pass' ELSE 'defer' END AS action,
            concat('reason ', CAST(event_id % 7 AS STRING)) AS reason, ts AS created_at FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {orders}) k WHERE event_type IN ('purchase', 'error', 'signup')""",  # k is one row
        "costs": """SELECT event_id AS id, ts AS occurred_at, CAST(value / 1000 AS DECIMAL(10, 6)) AS usd, CASE event_type WHEN 'click' THEN 'normalise' WHEN 'view' THEN 'embed' WHEN 'signup' THEN 'stage4_summarise' WHEN 'purchase' THEN 'stage6_curate' ELSE CASE WHEN event_id % 2 = 0 THEN 'weekly_brief' ELSE 'mcp_search' END END AS stage,
            CASE event_id % 7 WHEN 0 THEN 'text-embedding-3-small' WHEN 1 THEN 'claude-sonnet-4.5' WHEN 2 THEN 'claude-haiku-4.5' WHEN 3 THEN 'gemini-2.5-flash-lite' WHEN 4 THEN 'gemini-3.1-flash-lite' WHEN 5 THEN 'gemini-3.5-flash' ELSE 'no-such-model' END AS model,
            CASE WHEN event_id % 501 = 500 THEN -1 ELSE event_id % 5000 END AS input_tokens, event_id % 700 AS output_tokens, CASE WHEN event_id % 10 = 3 THEN CAST(event_id % 900 / 1000.0 AS DECIMAL(10, 6)) END AS given_usd FROM {events}""",
        "raw_items": f"""SELECT d.doc_id AS raw_id, split_part(d.text, chr(10), 1) AS title, d.text AS content, CAST(substr(d.source, 4) AS INT) AS source_id, concat('x-', CAST(d.doc_id % 700 AS STRING)) AS external_id, p.url AS url,
            TIMESTAMP '2024-01-01 00:00:00' + {h("d.doc_id")} AS published_at, TIMESTAMP '2024-01-01 00:00:00' + {h("d.doc_id + 1")} AS fetched_at, CAST(d.doc_id % 5 AS INT) AS attempts, d.doc_id % 3 = 0 AS processed
            {d.paged()}""",
        "inbox": f"""SELECT page_id AS message_id, regexp_extract(url, '^https?://([^./]+)', 1) AS slug, url, html, TIMESTAMP '2024-01-01 00:00:00' + {h("page_id")} AS received_at FROM {{pages}}""",
        "senders": """SELECT s_suppkey AS sender_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('List-', upper(substr(s_name, 1, 4)), CAST(s_suppkey % 40 AS STRING), '.News') END AS list_id,
            CASE WHEN s_suppkey % 7 <> 6 THEN concat('Editor', CAST(s_suppkey % 50 AS STRING), '@Mail', CAST(s_suppkey % 12 AS STRING), '.Example.', CASE WHEN s_suppkey % 2 = 0 THEN 'Com' ELSE 'org' END) END AS from_addr, concat('Issue ', CAST(s_suppkey AS STRING)) AS subject, concat('X-Id: ', CAST((s_suppkey * 29) % 97 AS STRING)) AS headers FROM {supplier}""",
        "sender_map": f"""SELECT c_custkey AS row_id, CASE c_custkey % 3 WHEN 0 THEN 'list_id' WHEN 1 THEN 'from_addr' ELSE 'from_domain' END AS match_field,
            CASE c_custkey % 3 WHEN 0 THEN concat('LIST-supp', CAST(c_custkey % 35 AS STRING), '.news') WHEN 1 THEN concat('editor', CAST(c_custkey % 20 AS STRING), '@MAIL', CAST(c_custkey % 12 AS STRING), '.example.com') ELSE concat('Mail', CAST(c_custkey % 9 AS STRING), '.example.org') END AS match_value,
            concat('slug-', CAST(c_custkey % 60 AS STRING)) AS slug, TIMESTAMP '2024-01-01 00:00:00' + {h("(c_custkey * 17) % 400")} AS created_at FROM {{customer}}""",
        "vectors": f"""SELECT vec_id, embedding, label, {domain("label")} AS primary_domain, TIMESTAMP '2024-01-01 00:00:00' + {h("vec_id")} AS published_at FROM {{embeddings}}""",
        "coverage": """SELECT event_id AS coverage_id, user_id AS cluster_id, CAST(floor(value) AS INT) % 9 AS country_count, CAST(floor(value) AS INT) % 4 AS language_count, CAST(floor(value) AS INT) AS total_article_count, ts AS fetched_at, event_type AS query_key FROM {events}""",
    }


def zoned(rows: DataFrame) -> DataFrame:
    """Timestamps without a zone as timestamps of the session's zone, UTC."""
    return rows.withColumns({c: rows[c].cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def needs(text: str) -> list[str]:
    """Names in braces, in order of appearance."""
    found, at = [], 0
    while (a := text.find("{", at)) >= 0:
        b = text.index("}", a)
        if text[a + 1 : b] not in found:
            found.append(text[a + 1 : b])
        at = b
    return found


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table as a lazy DataFrame over the Parquet files."""
    if name in BASE:
        return zoned(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    text = texts(Dialect(False))[name]
    return spark.sql(text, **{n: model(spark, sf_dir, n) for n in needs(text)})


def stream_of(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """A model table over the given tables, of which one may be a stream."""
    return spark.sql(texts(Dialect(False))[name], **tables)


def oracle(query: str) -> str:
    """A query over model tables in braces as DuckDB SQL with those tables as common table expressions."""
    known = texts(Dialect(True))
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needs(text):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(query)
    plain = lambda text: text.format(**{n: n for n in needs(text)}).replace("[[", "{").replace("]]", "}")  # noqa: E731  [[ and ]] are braces of the SQL itself
    heads = ", ".join(f"{n} AS ({plain(known[n])})" for n in order)
    body = plain(query).strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[14:]}"
    return f"WITH {heads}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {heads} {body}"
