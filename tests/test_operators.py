"""Boundary facts and invariants of the library's operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import briefs, candidates, clusters, costs, feedback, ingest, models, signals, trending, vectors
from storyloom.operators.greedy import first_wins
from storyloom.sources.lens import model

T0 = dt.datetime(2024, 1, 10)
now = lambda: F.expr("TIMESTAMP '2024-01-10 00:00:00'")
hours = lambda n: T0 + dt.timedelta(hours=n)


def test_exclusive_needs_authority_and_more_than_four_hours(spark):
    sources = spark.createDataFrame([(1, 75), (2, 90), (3, 74)], "source_id long, authority_score int")
    rows = [(1, 1, 0), (1, 2, 4), (2, 1, 0), (2, 2, 5), (3, 3, 0), (3, 2, 9), (4, 1, 0), (4, 1, 9), (5, 1, 0), (5, 1, 1), (5, 2, 6)]
    items = spark.createDataFrame([(c, s, hours(h)) for c, s, h in rows], "cluster_id long, source_id long, published_at timestamp")
    got = {r["cluster_id"]: r["is_exclusive"] for r in signals.exclusive(items, sources).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_temperature_floors(spark):
    rows = [(1, "a", 10), (2, "b", 4), (3, "b", 4), (4, "b", 4), (5, "b", 12)]
    df = spark.createDataFrame([(i, d, n, "active", T0) for i, d, n in rows], "cluster_id long, primary_domain string, item_count long, status string, first_seen_at timestamp")
    z = {r["cluster_id"]: r["z"] for r in signals.temperature(df, now()).collect()}
    assert z[1] == 0.0  # no others
    assert z[5] == 4.0  # zero spread: (12 - 4) / sqrt(4)


def test_trajectory_of_young_and_idle_clusters(spark):
    items = spark.createDataFrame([(1, hours(-1)), (2, hours(-1)), (2, hours(-2)), (2, hours(-30)), (3, hours(-100))], "cluster_id long, published_at timestamp")
    cl = spark.createDataFrame([(1, hours(-1)), (2, hours(-30)), (3, hours(-100))], "cluster_id long, first_seen_at timestamp")
    got = {r["cluster_id"]: (r["ratio"], r["trajectory"]) for r in signals.trajectory(items, cl, now()).collect()}
    assert got == {1: (0.0, "new"), 2: (2.0, "rising"), 3: (0.0, "declining")}


def candidate(i, cluster, status, created, expires=100, **more):
    return (i, cluster, status, hours(created), hours(expires), "economy", more.get("score", 50.0))


def test_upsert_outcomes(spark):
    rows = [candidate(1, 1, "picked", -5), candidate(2, 1, "new", -4), candidate(3, 2, "new", -9, -8), candidate(4, 3, "deferred", -3), candidate(5, 4, "deferred", -3, -1), candidate(6, 5, "passed", -3, 0)]
    df = spark.createDataFrame(rows, "candidate_id long, cluster_id long, status string, created_at timestamp, expires_at timestamp, primary_domain string, curation_score double")
    curated = spark.createDataFrame([(i, "economy") for i in (1, 2, 3, 4, 5, 6)], "cluster_id long, primary_domain string")
    got = {r["cluster_id"]: (r["outcome"], r["candidate_id"]) for r in candidates.upsert(curated, df, now()).collect()}
    assert got == {1: ("skipped_decided", None), 2: ("superseded", 3), 3: ("superseded", 4), 4: ("inserted", None), 5: ("inserted", None), 6: ("inserted", None)}


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_equals_the_sequential_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(30)), None if rng.random() < 0.2 else int(rng.integers(30))) for i in range(120)]
    seen: list[set] = [set(), set()]
    want = []
    for i, a, b in rows:
        if a in seen[0] or (b is not None and b in seen[1]):
            continue
        want.append(i)
        seen[0].add(a)
        seen[1].add(b)
    got = first_wins(spark.createDataFrame(rows, "o long, a int, b int"), "o", ["a", "b"])
    assert sorted(r["o"] for r in got.collect()) == want


def test_trending_one_row_per_story(spark):
    rows = [(1, 1, "Story A", 5), (2, 1, "Story B", 4), (3, 2, "story b!", 3), (4, 3, "", 2), (5, 4, "", 1)]
    df = spark.createDataFrame([(i, c, h, hours(t), "economy", "hot", "new", ["k"], [" t ", "t"]) for i, c, h, t in rows], "candidate_id long, cluster_id long, headline string, created_at timestamp, primary_domain string, temperature string, trajectory string, keywords array<string>, tags array<string>")
    stories = trending.one_per_story(df)
    assert sorted(r["candidate_id"] for r in stories.collect()) == [1, 3, 4, 5]  # 2 shares a cluster with 1; 3 only shares a headline with the dropped 2
    board = trending.board(stories, "tags", 1).collect()
    assert [(r["term"], r["clusters"], r["score"]) for r in board] == [("t", 4, 12.0)]


def test_blocked_cosine_equals_numpy_for_any_part_size(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], "ab"[i % 2]) for i in range(60)] + [(99, [0.0] * 8, "a"), (98, None, "b")], "id long, vector array<double>, block string")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(60) for j in range(60) if i % 2 == j % 2 and s[i, j] >= 0.4}
    for part in (7, 4096):
        assert {(r["l_id"], r["r_id"]) for r in vectors.cosine_pairs(df, df, "block", at_least=0.4, part_rows=part).collect()} == want
    best = {(r["l_id"], r["rank"]): r["r_id"] for r in vectors.cosine_pairs(df, df, "block", k=3, part_rows=7).collect()}
    for i in range(60):
        own = [j for j in np.argsort(-s[i], kind="stable") if j % 2 == i % 2][:3]
        assert [best[i, r] for r in (1, 2, 3)] == own


def test_mean_pair_similarity(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("a", [3.0, 0.0]), ("b", [1.0, 1.0])]
    got = {r["k"]: r["similarity"] for r in vectors.mean_pair_similarity(spark.createDataFrame(rows, "k string, v array<double>"), "k", "v").collect()}
    assert abs(got["a"] - 1 / 3) < 1e-12 and got["b"] is None


def test_compaction_does_not_chain_and_keeps_counts(spark):
    angles = {1: 0.0, 2: 0.2, 3: 0.41}
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], "d", n, T0, T0, "active") for (i, a), n in zip(angles.items(), (5, 2, 1), strict=True)], "id long, vector array<double>, primary_domain string, item_count long, first_seen_at timestamp, last_seen_at timestamp, status string")
    entities = spark.createDataFrame([(1, "e"), (2, "e"), (3, "e")], "id long, entity string")
    pairs = clusters.merge_pairs(df, entities, now(), 0.05)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (2, 3)}
    merges = clusters.compaction(pairs, df)
    assert [(r["source"], r["target"]) for r in merges.collect()] == [(2, 1)]
    state = {r["id"]: r for r in clusters.compacted(df, merges).collect()}
    assert sum(r["item_count"] for r in state.values() if r["status"] == "active") == 8
    assert clusters.merge_pairs(df, entities.filter("id <> 2"), now(), 0.05).count() == 0


def test_survivors_follow_long_chains(spark):
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)] + [(100, None)], "id long, merged_into long")
    assert {r["id"]: r["survivor"] for r in clusters.survivors(parents).collect()} == {**dict.fromkeys(range(50), 0), 100: 100}


def test_hash_dedup_boundaries(spark):
    known = spark.createDataFrame([(1, "x0", "u1", "old", hours(-24 * 8)), (1, "x1", "u2", "edge", hours(-24 * 7))], "source_id int, external_id string, url_hash string, title_hash string, published_at timestamp")
    new = spark.createDataFrame([(1, 1, "a", "u1", "n1"), (2, 1, "b", "u9", "old"), (3, 1, "c", "u8", "edge"), (4, 1, "d", "u7", "t"), (5, 1, "e", "u7", "t"), (6, 1, "d", "u6", "t6"), (7, 1, "f", "u7", "other")], "raw_id long, source_id int, external_id string, url_hash string, title_hash string")
    assert sorted(r["raw_id"] for r in ingest.hash_dedup(new, known, now()).collect()) == [2, 4, 7]


def test_gate_counts_equal_as_a_hit(spark):
    rows = [(1, 0.4), (2, 0.5), (3, 0.1), (4, 0.01)]
    df = spark.createDataFrame([(i, hours(i), u, "embed") for i, u in rows], "id long, occurred_at timestamp, usd double, stage string").withColumn("usd", F.col("usd").cast("decimal(10,6)"))
    got = {r["id"]: (r["admitted"], r["scope"]) for r in costs.gate(df, 1.0, {}).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "day"), 4: (False, None)}


def test_recalibration_clamps_and_ignores(spark):
    sources = spark.createDataFrame([(1, 0, True), (2, 100, True), (3, 50, False), (4, 50, True)], "source_id long, authority_score_seed int, enabled boolean")
    fb = spark.createDataFrame([(1, 1, "pass", hours(-1)), (2, 2, "pick", hours(-1)), (3, 4, "defer", hours(-1)), (4, 4, "pick", hours(-24 * 31))], "feedback_id long, candidate_id long, action string, created_at timestamp")
    cand = spark.createDataFrame([(1, 1), (2, 2), (4, 4)], "candidate_id long, cluster_id long")
    items = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (4, 4)], "cluster_id long, source_id long")
    got = {r["source_id"]: (r["picks"], r["passes"], r["authority_score"]) for r in feedback.recalibrated(sources, fb, cand, items, now()).collect()}
    assert got == {1: (0, 1, 1), 2: (1, 0, 100), 4: (0, 0, 50)}


def test_brief_keeps_its_first_id(spark):
    old = spark.createDataFrame([("w1", 1, "a")], "week_of string, brief_id long, text string")
    new = spark.createDataFrame([("w1", 9, "b"), ("w2", 8, "c")], "week_of string, brief_id long, text string")
    assert {tuple(r) for r in briefs.upsert(old, new).collect()} == {("w1", 1, "b"), ("w2", 8, "c")}


def test_model_stage_bills_failures_and_skips_blanks(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, " "), (4, "x 9")], "id long, text string")
    got = {r["id"]: (r["output"], r["input_tokens"], r["error"]) for r in models.model_stage(df, "id", "text", models.first_words).collect()}
    assert got == {1: ("a b c", 3, None), 2: (None, 0, None), 3: (None, 0, None), 4: (None, 2, "digit")}


def test_model_words_are_told_apart_where_split_differs():
    import re

    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert spaces == set(models.SPACES) | set(models.SPLIT) and not set(models.SPACES) & set(models.SPLIT)
    assert set(re.findall(r"[\t\n\f\r \x1c-\x1f\x85\xa0]", "".join(map(chr, range(0x110000))))) == set(models.SPACES)


def test_model_stage_equals_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = [None, "", " ", "\n\t", "\x1f\x85 ", "\x0b", "\u3000", "a\x0bb", "a\u3000b", "a\u2028b", "\u2003 a", "a\x85b\xa0c\x1cd", "x\xb2 y", "x\u0661", "\u2167 \xbd", "a\x00b c", "\ufeffa b", "a b c d e 9", "a b c d 9", " a\rb\x0cc"]
    rows = [(2**53 + 2 * i + 1, t) for i, t in enumerate(texts)] + [(None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in entry.queries()["model_stage"](spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(c.execute(entry.oracle_sql()["model_stage"]).fetchall(), key=repr)
    assert (rows[1][0], "") in got and (rows[7][0], "a\x0bb") in got and (rows[12][0], "x\xb2 y") in got


def test_compact_clusters_and_pitches_read_all_rows(spark):
    from storyloom.plans import text_queries, vector_queries
    from storyloom.sources.lens import model

    sf = "/root/testdata/sf0.001"
    ids = lambda df, c: sorted(r[c] for r in df.select(c).distinct().collect())
    assert ids(vector_queries.compact_clusters(spark, sf), "id") == ids(model(spark, sf, "vectors"), "vec_id")
    seen = text_queries.validate_pitches(spark, sf).select("response_id").distinct().collect()
    assert {r["response_id"] for r in seen} == set(ids(model(spark, sf, "candidates"), "cluster_id"))


def test_stream_cost_daily_keeps_days_of_any_file_order(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from storyloom.plans.vector_queries import stream_cost_daily

    folder, days = tmp_path / "events.parquet", [40, 3, 25, 60, 10, 3, 55, 1, 30, 2, 60, 12]  # one a file, four files a batch
    for i, day in enumerate(days):
        rows = [(dt.datetime(2024, 1, 1, h) + dt.timedelta(days=day), float(1000 * i + h)) for h in range(5)]
        spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(folder))
    want = spark.read.parquet(str(folder)).groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("value") / 1000).alias("usd"), F.count("*").alias("calls"))
    plain = lambda df: sorted((r["day"], round(r["usd"], 6), r["calls"]) for r in df.collect())
    assert plain(stream_cost_daily(spark, str(tmp_path))) == plain(want)


def test_streams_equal_batches(spark, sf):
    import __spark_entry__ as entry

    q = entry.queries()
    events = model(spark, sf, "events")
    days = {(r["day"], r["calls"]) for r in q["stream_cost_daily"](spark, sf).collect()}
    assert days == {(r["d"], r["n"]) for r in events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    keys = lambda name: sorted(r["raw_id"] for r in q[name](spark, sf).collect())
    assert keys("stream_ingest") == keys("ingest_hash_dedup")
