"""SQL of the trending board and its greedy selection of stories, for the oracle."""

from __future__ import annotations

from storyloom.schemas import HEAT_RANK, HEAT_WEIGHT, TRAJECTORY_WEIGHT


def case(column: str, values: dict, default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


#: CTEs from pool(run, candidate columns) to stories: a recursion of rounds. A round takes rows that come first by both keys, and drops rows that share a key with those.
STORIES = r"""keyed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY created_at DESC, candidate_id) AS o, coalesce(nullif(trim(regexp_replace(lower(headline), '[^\p[[L]]\p[[N]]]+', ' ', 'g')), ''), concat('#', CAST(candidate_id AS STRING))) AS h FROM pool),
rounds AS (SELECT run, candidate_id, cluster_id, h, o, 0 AS state FROM keyed
 UNION ALL SELECT run, candidate_id, cluster_id, h, o, CASE WHEN first THEN 1 WHEN bool_or(first) OVER (PARTITION BY run, cluster_id) OR bool_or(first) OVER (PARTITION BY run, h) THEN 2 ELSE 0 END
 FROM (SELECT *, o = min(o) OVER (PARTITION BY run, cluster_id) AND o = min(o) OVER (PARTITION BY run, h) AS first FROM rounds WHERE state = 0)),
stories AS MATERIALIZED (SELECT k.* FROM keyed k JOIN rounds r USING (run, candidate_id) WHERE r.state = 1)"""


def board(name: str, term: str, least: int, rows: int) -> str:
    """CTEs up to ``name``(run, rank, term, clusters, score, mean_heat, domains, headline)."""
    weight = f"{case('temperature', HEAT_WEIGHT, 1.0)} * {case('trajectory', TRAJECTORY_WEIGHT, 1.0)}"
    return f"""{name}_terms AS (SELECT DISTINCT run, candidate_id, o, primary_domain, headline, CAST({weight} AS DOUBLE) AS weight, {case('temperature', HEAT_RANK, 1)} AS heat, trim(t) AS term FROM (SELECT *, unnest({term}) AS t FROM stories) WHERE trim(t) <> ''),
{name}_domains AS (SELECT run, term, primary_domain, count(*) AS n, sum(weight) AS w, sum(heat) AS heat FROM {name}_terms GROUP BY ALL),
{name}_heads AS (SELECT run, term, headline FROM {name}_terms QUALIFY row_number() OVER (PARTITION BY run, term ORDER BY weight DESC, o) = 1),
{name}_sums AS (SELECT run, term, CAST(sum(n) AS BIGINT) AS clusters, round(sum(w), 2) AS score, round(CAST(sum(heat) AS DOUBLE) / sum(n), 6) AS mean_heat, string_agg(primary_domain, ',' ORDER BY w DESC, primary_domain) AS domains FROM {name}_domains GROUP BY ALL),
{name} AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY score DESC, clusters DESC, term) AS rank, term, clusters, score, mean_heat, domains, headline FROM {name}_sums JOIN {name}_heads USING (run, term) WHERE clusters >= {least} QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, clusters DESC, term) <= {rows})"""


#: Clusters that have items, all of them from arXiv.
ARXIV = "(SELECT cluster_id FROM {items} JOIN {sources} USING (source_id) GROUP BY 1 HAVING bool_and(kind = 'arxiv'))"
