"""Running values, as-of lookups, streams that hold no state, existence joins, greedy loops and compaction."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import clusters, costs, coverage, running, vectors
from storyloom.operators.greedy import first_wins
from storyloom.streaming import jobs

T0 = dt.datetime(2024, 1, 10)
hours = lambda n: T0 + dt.timedelta(hours=float(n))


@pytest.mark.parametrize("parts", [1, 6])
def test_running_values_equal_a_loop(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}", int(t), i, None if i % 4 == 0 else int(rng.integers(9))) for i, t in enumerate(rng.integers(0, 50, 400))]
    order = ["k", "t", "id"]
    dealt = running.ranged(spark.createDataFrame(rows, "k string, t int, id long, v long").repartition(3), order, parts)
    got = running.last_known(running.before(dealt, ["k"], order, F.col("v"), "spent"), ["k"], order, F.col("v"), "last")
    spent, last, want = {}, {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = [spent.get(k, 0)]
        spent[k] = spent.get(k, 0) + (v or 0)
        last[k] = last.get(k) if v is None else v
        want[i].append(last[k])
    assert {r.id: [r.spent, r.last] for r in got.collect()} == want
    if parts > 1:  # the hot key is in several parts
        assert dealt.filter("k = 'hot'").select(running.PART).distinct().count() > 1


def test_gate_and_alerts_of_one_day_over_many_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, T0 + dt.timedelta(seconds=int(s)), round(float(u), 6), str(rng.choice(["normalise", "embed", "mcp_search", "stage6_curate"]))) for i, (s, u) in enumerate(zip(rng.integers(0, 80_000, 300), rng.random(300) / 100, strict=True))]
    df = spark.createDataFrame(rows, "id long, occurred_at timestamp, usd double, stage string").withColumn("usd", F.col("usd").cast("decimal(10,6)"))
    got = {r.id: (r.admitted, r.scope) for r in costs.gate(df, 1.0, {"normalize": 0.6}, parts=8).collect()}
    day, own, halted, want = 0.0, {}, False, {}
    for i, _, usd, stage in sorted(rows, key=lambda r: (r[1], r[0])):
        b = costs.BUCKETS.get(stage)
        scope = "bucket" if b == "normalize" and own.get(b, 0) + usd + 1e-9 >= 0.6 else "day" if day + usd + 1e-9 >= 1.0 else None
        want[i] = (not halted and scope is None, scope if scope and not halted else None)
        halted = halted or scope is not None
        day, own[b] = day + usd, own.get(b, 0) + usd
    assert got == want
    total, first = 0.0, None
    for i, _, usd, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        total += usd
        first = i if first is None and total + 1e-9 >= 0.8 else first
    assert [r.id for r in costs.alerts(df, 1.0, parts=8).collect()] == [first]


@pytest.mark.parametrize("parts", [1, 5])
def test_lookups_by_hand(spark, parts):
    cached = [("a", 0, 1), ("a", 0, 2), ("a", 10, 3), ("b", 5, 4)]
    asked = [("a", 0, 10), ("a", 6, 11), ("a", 6.001, 12), ("a", 9.9, 13), ("a", 16, 14), ("b", 4, 15), ("b", 5.5, 16), ("c", 1, 17)]
    cover = spark.createDataFrame([(q, hours(h), i) for q, h, i in cached], "query_hash string, fetched_at timestamp, coverage_id long")
    requests = spark.createDataFrame([(q, hours(h), i) for q, h, i in asked], "query_hash string, requested_at timestamp, request_id long")
    got = {r.request_id: (r.coverage_id, r.hit) for r in coverage.lookups(requests, cover, parts=parts).collect()}
    assert got == {10: (2, True), 11: (2, True), 12: (None, False), 13: (None, False), 14: (3, True), 15: (None, False), 16: (4, True), 17: (None, False)}


def _files(spark, rows, schema, folder, n=8):
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_sessions_of_shuffled_files_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(c), hours(h)) for c, h in zip(rng.integers(0, 6, 160), rng.integers(0, 4000, 160), strict=True)]
    rows += [(50, hours(0)), (50, hours(24)), (50, hours(49)), (51, hours(0)), (51, hours(40)), (51, hours(20))]  # exactly the gap; a bridge
    rng.shuffle(rows := [tuple(r) for r in rows])
    rows = [(int(c), h) for c, h in rows]
    schema = "cluster_id long, observed_at timestamp"
    plain = lambda df: sorted(map(tuple, df.select("cluster_id", "started", "ended", "n").collect()))
    want = plain(jobs.sessions(spark.createDataFrame(rows, schema), "24 hours"))
    assert plain(jobs.sessions(_files(spark, rows, schema, tmp_path), "24 hours")) == want
    assert [r[3] for r in want if r[0] == 51] == [3]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, 0), (1, 24)], [(1, 0, 48, 2)]),  # exactly the gap
        ([(2, 0), (2, 24.001)], [(2, 0, 24, 1), (2, 24.001, 48.001, 1)]),
        ([(3, 0), (3, 48), (3, 24)], [(3, 0, 72, 3)]),  # the middle comes last
        ([(5, 0), (5, 30), (5, 30)], [(5, 0, 24, 1), (5, 30, 54, 2)]),  # items of one time stay together
        ([(4, 0), (4, None), (None, None), (None, 5), (None, None)], [(4, 0, 24, 1), (4, None, None, 1), (None, 5, 29, 1), (None, None, None, 1), (None, None, None, 1)]),
    ],
)
def test_sessions_that_meet_are_one_in_any_files(spark, tmp_path, rows, want):
    at = lambda h: None if h is None else hours(h)
    rows, want = [(c, at(h)) for c, h in rows], sorted(((c, at(a), at(b), n) for c, a, b, n in want), key=repr)
    schema = "cluster_id long, observed_at timestamp"
    for items in (spark.createDataFrame(rows, schema), _files(spark, rows, schema, tmp_path, len(rows))):
        assert sorted(map(tuple, jobs.sessions(items, "24 hours").select("cluster_id", "started", "ended", "n").collect()), key=repr) == want


def test_activity_of_any_file_order_equals_the_batch_and_tells_corrections(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(c), hours(h)) for c, h in zip(rng.integers(0, 4, 200), rng.integers(0, 1000, 200), strict=True)]
    schema = "cluster_id long, published_at timestamp"
    got = {(r.cluster_id, r.window_start): (r.n, r.corrected) for r in jobs.activity_windows(_files(spark, rows, schema, tmp_path / "any"), late=dt.timedelta(hours=30)).collect()}
    want = {(r.cluster_id, r.w.start): r.n for r in spark.createDataFrame(rows, schema).groupBy("cluster_id", F.window("published_at", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    assert sum(c for _, c in got.values()) > 0 and all(c <= n for n, c in got.values())
    rows = [(0, hours(0)), (0, hours(20)), (0, hours(100)), (0, hours(1))]  # the last comes when its windows have closed
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/own/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/own/*")
    got = {r.window_start: (r.n, r.corrected) for r in jobs.activity_windows(stream, late=dt.timedelta(hours=30)).collect()}
    assert got[hours(0)] == (3, 1) and got[hours(-12)] == (2, 1) and got[hours(96)] == (1, 0)


def test_existence_join_equals_numpy_for_any_part_size(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(80, 6))
    v[70:] = v[:10]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], "ab"[i % 2]) for i in range(80)] + [(99, [0.0] * 6, "a"), (98, None, "b")], "id long, vector array<double>, block string")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (1 - u @ u.T < 0.25) & (np.arange(80)[:, None] % 2 == np.arange(80) % 2) & ~np.eye(80, dtype=bool)
    for part in (7, 4096):
        assert sorted(r.id for r in vectors.near_ids(df, df, "block", 0.25, part_rows=part, step=5).collect()) == np.flatnonzero(near.any(axis=1)).tolist()


@pytest.mark.parametrize("loop_rows", [3, 10**6])
def test_greedy_loops_equal_the_sequential_loop(spark, loop_rows):
    """A path ordered along itself, and an edge list at random."""
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(24)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 25, (60, 2)) if a != b]
    rows = [(o, [a, b]) for o, (a, b) in enumerate(edges)]
    used, want = set(), []
    for o, ends in rows:
        if used.isdisjoint(ends):
            used.update(ends)
            want.append(o)
    got = first_wins(spark.createDataFrame(rows, "o long, ends array<int>"), "o", ["ends"], loop_rows)
    assert sorted(r.o for r in got.collect()) == want


def _clusters(spark, vectors_, counts):
    kind = "id long, vector array<double>, primary_domain string, item_count long, first_seen_at timestamp, last_seen_at timestamp, status string, domains array<string>"
    return spark.createDataFrame([(i, v, "d", n, hours(i), hours(20 - i), "active", [f"x{i}"]) for i, (v, n) in enumerate(zip(vectors_, counts, strict=True))], kind)


def test_compaction_keeps_weights_domains_and_items_and_stops_at_a_fixed_point(spark):
    now = F.expr("TIMESTAMP '2024-01-11 00:00:00'")
    # the second merge of a pass would use a stale distance: the moved centroid is farther from the third
    chain = [[1.0, 0.0, 0.0], [0.87, (1 - 0.87**2) ** 0.5, 0.0], [0.86, 0.0, (1 - 0.86**2) ** 0.5]]
    df = _clusters(spark, chain, (3, 3, 3))
    shared = spark.createDataFrame([(i, "e") for i in range(3)], "id long, entity string")
    items = spark.createDataFrame([(10 * c + k, c) for c in range(3) for k in range(3)], "item_id long, cluster_id long")
    after, merges, pointed = clusters.compact(df, shared, now, 0.15, items=items)
    assert [(r.source, r.target) for r in merges.collect()] == [(1, 0)]
    state = {r.id: r for r in after.collect()}
    assert (state[0].item_count, state[0].domains, state[0].last_seen_at, state[1].status, state[1].merged_into, state[2].status) == (6, ["x0", "x1"], hours(20), "merged", 0, "active")
    assert state[0].vector == pytest.approx(np.mean(chain[:2], axis=0))
    assert sorted((r.item_id, r.cluster_id) for r in pointed.collect()) == [(10 * c + k, 0 if c == 1 else c) for c in range(3) for k in range(3)]
    # four on one line merge in two passes, the weights being the counts
    line = [[1.0, 0.0], [0.99, 0.14], [0.97, 0.24], [0.94, 0.34]]
    df = _clusters(spark, line, (1, 2, 3, 4))
    after, merges, _ = clusters.compact(df, spark.createDataFrame([(i, "e") for i in range(4)], "id long, entity string"), now, 0.15, passes=None)
    left = [r for r in after.collect() if r.status == "active"]
    assert merges.count() == 3 and len(left) == 1 and left[0].item_count == 10
    assert left[0].vector == pytest.approx(np.average(line, axis=0, weights=(1, 2, 3, 4)))


def test_search_gives_each_query_as_many_as_it_wants(spark):
    centroids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id long, vector array<double>")
    candidates = spark.createDataFrame([(30, 1), (31, 1), (32, 2), (33, 3), (34, 9)], "candidate_id long, cluster_id long")
    queries = spark.createDataFrame([(1, [1.0, 0.1], 3), (2, [0.0, 2.0], 1), (3, None, 5)], "id long, vector array<double>, wanted int")
    got = sorted((r.query_id, r["rank"], r.id) for r in clusters.search(queries, candidates, centroids, 5).collect())
    assert got == [(1, 1, 30), (1, 2, 31), (1, 3, 33), (2, 1, 32)]
