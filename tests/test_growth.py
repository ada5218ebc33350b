"""Plans and operators that must not grow with pairs of rows, and results that no part size or arrival changes."""

from contextlib import redirect_stdout
from io import StringIO

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storyloom.operators import briefs, candidates, clusters, inbox, trending, vectors
from storyloom.operators.ingest import hash_dedup
from storyloom.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    with redirect_stdout(out := StringIO()):
        df.explain()
    return out.getvalue()


def test_raw_items_never_meet_all_pages(spark):
    for name in ("host_allowlist", "ingest_hash_dedup"):
        plan = plan_of(entry.queries()[name](spark, SMALL))
        assert "CartesianProduct" not in plan and "HashJoin [page" in plan


def test_ingest_is_the_batchs_for_any_micro_batches(spark, tmp_path):
    """Files of one row, in two orders and one file a batch: other sources' twins stay, the smallest raw_id wins."""
    kind = "raw_id long, source_id int, external_id string, published_at timestamp, url_hash string, title_hash string"
    at = "TIMESTAMP '2024-01-14 00:00:00'"
    rows = [(1, 1, "a", "u1", "t1"), (2, 2, "a", "u1", "t1"), (3, 1, "b", "u1", "t1"), (4, 1, "a", "u2", "t2"), (5, 1, "c", "u3", "t1"), (6, 3, "k", "u4", "t4"), (7, 3, "z", "u4", "t4"), (8, 1, None, "u5", None), (9, 1, None, "u5", None)]
    made = lambda some: spark.createDataFrame([(i, s, e, None, u, t) for i, s, e, u, t in some], kind).withColumn("published_at", F.expr(at))
    known, as_of = made([(100, 3, "k", "u9", "t9")]), F.expr("TIMESTAMP '2024-01-15 00:00:00'")
    want = sorted(r.raw_id for r in hash_dedup(made(rows), known, as_of).collect())
    assert want == [1, 2, 5, 8]
    for name, order in (("up", rows), ("down", rows[::-1])):
        for row in order:
            made([row]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(made(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        assert sorted(r.raw_id for r in jobs.ingested(stream, known, as_of).collect()) == want


def joined_rows(df):
    """The most rows that any join of the executed plan made."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        inner = [getattr(node, name)() for name in ("executedPlan", "plan") if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",) and name == "executedPlan" or node.getClass().getSimpleName().endswith("QueryStageExec") and name == "plan"]
        children = node.children()
        plan += inner + [children.apply(i) for i in range(children.size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_senders_meet_a_hints_first_seed_alone(spark):
    senders = spark.createDataFrame([(i, f"x@a.Mail{i % 2}.example") for i in range(40)], "sender_id long, from_addr string")
    seeds = spark.createDataFrame([(50 - i, f"s{50 - i}", f"MAIL{i % 2}.example", i) for i in range(50)], "seed_order int, seed_slug string, hint string, authority int")
    found = inbox.seeded(senders, seeds)
    assert joined_rows(found) == 40  # a row for each sender, not for each of its 25 seeds
    assert {(r.sender_id % 2, r.slug, r.authority) for r in found.collect()} == {(0, "s2", 48), (1, "s1", 49)}


def test_a_groups_product_is_taken_in_strips():
    for rows, width in ((4096, 4096), (5, 10**7), (4096, 3), (1, 1)):
        strips = vectors._strips(rows, width)
        assert [i for s in strips for i in range(rows)[s]] == list(range(rows))
        assert all(len(range(rows)[s]) == 1 or len(range(rows)[s]) * width <= vectors.CELLS for s in strips)


@pytest.mark.parametrize("k", [1, 3])
def test_matching_by_lists_equals_the_loop_over_all_pairs(spark, k):
    """Random directions with copies, a chain ordered along itself, rows without a tag or a vector."""
    rng = np.random.default_rng(3)
    angles = np.cumsum(0.3 + 0.001 * np.arange(16))
    made = [[float(x) for x in v] + [0.0, 0.0] for v in rng.normal(size=(50, 3))]
    made += made[:4]
    made += [[0.0, 0.0, 0.0, float(np.cos(a)), float(np.sin(a))] for a in angles]
    tags = [[f"e{i % 3}", f"f{i % 4}"] if i < 54 else ["chain"] for i in range(len(made))]
    rows = [(i, v, t, "d") for i, (v, t) in enumerate(zip(made, tags, strict=True))] + [(900, made[0], [], "d"), (901, None, ["e0"], "d"), (902, made[0], ["e0"], "other")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, tags array<string>, primary_domain string")
    u = np.array(made) / np.linalg.norm(made, axis=1, keepdims=True)
    far = 1 - u @ u.T
    edges = sorted((round(far[a, b], 12), a, b) for a in range(len(made)) for b in range(a + 1, len(made)) if far[a, b] < 0.5 and set(tags[a]) & set(tags[b]))
    for part in (9, 4096):
        assert {(r.id, r.other) for r in vectors.sharing_pairs(df, "primary_domain", 0.5, part_rows=part).collect()} == {(a, b) for _, a, b in edges}
    used, want = set(), []
    for _, a, b in edges:
        if used.isdisjoint((a, b)):
            used |= {a, b}
            want.append((a, b))
    assert sorted((r.a, r.b) for r in clusters.greedy_matching(df, 0.5, k=k, few=5).collect()) == sorted(want)


def test_merge_pairs_leave_the_join_alone_as_they_are(spark):
    """No pair is written or joined after it was found."""
    plan = plan_of(entry.queries()["merge_candidates"](spark, SMALL))
    assert "FlatMapCoGroups" in plan and "Join" not in plan[: plan.index("FlatMapCoGroups")]


def test_the_feed_reads_no_older_runs_than_it_needs(spark):
    from storyloom.plans import model_queries

    fresh = model_queries.fresh(spark, SMALL)
    since = candidates.oldest_needed(fresh, 50)
    newest = [r.run_id for r in candidates.newest_entries(candidates.pulse(fresh), 50).collect()]
    assert since == min(newest) > fresh.agg(F.min("run_id")).first()[0]
    assert candidates.oldest_needed(fresh.limit(3), 50) is None


def test_pitches_are_parsed_once(spark):
    responses = spark.createDataFrame([(1, '{"pitches": []}')], "response_id long, raw string")
    plan = plan_of(briefs.valid_pitches(responses, spark.createDataFrame([], "response_id long, url string"), spark.createDataFrame([], "response_id long, id string")))
    assert "parse_json" not in plan.lower()


@pytest.mark.parametrize("parts", [1, 5])
def test_stories_of_days_equal_those_of_the_pools(spark, parts):
    """Clusters and headlines in common, blank and missing ones, lives over blocks of days and before 1970; one headline's rows are in several parts."""
    rng = np.random.default_rng(parts)
    titles = ["One Tale", "one tale!", "two", "three", " ", None]
    rows = [(i, None if rng.random() < 0.05 else int(rng.integers(150)), titles[int(rng.integers(6))], int(rng.integers(-50, 50)), int(rng.integers(1, 40 if i % 9 else 90))) for i in range(220)]
    made = spark.createDataFrame(rows, "candidate_id long, cluster_id long, headline string, first int, life int")
    dated = made.selectExpr("*", "timestamp_seconds(first * 86400L + 3600) AS created_at", "timestamp_seconds((first + life) * 86400L) AS expires_at", "CAST(NULL AS timestamp) AS decided_at")
    days = trending.pooled(dated)
    want = trending.one_per_story(trending.daily_pools(dated), "run_id").select("run_id", "candidate_id").collect()
    got = trending.daily_stories(days, parts=parts)
    assert sorted(map(tuple, got.select("run_id", "candidate_id").collect())) == sorted(map(tuple, want))
    some = [(r,) for r in sorted({r.run_id for r in want})[::3]]
    assert {tuple(r) for r in trending.daily_stories(days, only=spark.createDataFrame(some, "run_id string"), parts=parts).select("run_id", "candidate_id").collect()} == {tuple(r) for r in want if (r.run_id,) in some}


def test_the_boards_loop_gets_rows_in_doubt_alone(spark, monkeypatch):
    """Not all pools of all days go through the rounds."""
    from storyloom.plans import model_queries

    sizes, loop = [], trending.first_wins

    def counted(rows, *rest):
        sizes.append(rows.count())
        return loop(rows, *rest)

    monkeypatch.setattr(trending, "first_wins", counted)
    stories = model_queries.entries(spark, SMALL).filter("kind = 'waves'").count()
    assert stories > 100 and sizes[0] < 500  # the pools have thousands of rows


def test_a_runs_rows_never_come_together(spark):
    """The best of a run are found before the exchange by run, and no window is over all of its rows."""
    from storyloom.plans import model_queries

    plan = plan_of(candidates.pulse(model_queries.fresh(spark, SMALL)))
    assert "WindowGroupLimit" in plan and "Window [max(" not in plan


def test_details_take_items_twice_and_parse_behind_the_joins(spark):
    """The list of a cluster's sources says which is exclusive, without a window or the items for a third time."""
    plan = plan_of(entry.queries()["candidate_detail"](spark, SMALL))
    assert plan.count("lineitem.parquet") == 2 and "Window" not in plan
    assert "parseJson" in plan[: plan.index("Join")] and "parseJson" not in plan[plan.index("Join") :]
