"""Online assignment: against plain loops, for any part size, and as a stream over files in any order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import assignment
from storyloom.streaming import jobs

T0 = dt.datetime(2024, 1, 10)
KIND = "id long, vector array<double>, observed_at timestamp, published_at timestamp, domains array<string>, primary_domain string"
hours = lambda n: T0 + dt.timedelta(hours=n)
cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def by_hand(rows, cuts, below, days):
    """rows: (id, vector, observed, published, domains, cell); (assignment, clusters)."""
    out, clusters = {}, {}
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        step = sorted((r for r in rows if (low is None or r[2] >= low) and (high is None or r[2] < high)), key=lambda r: (r[2], r[0]))
        left, placed = [], []
        for r in step:
            x = np.array(r[1])
            recent = [c for c in clusters if clusters[c]["cell"] == r[5] and clusters[c]["last"] > low - dt.timedelta(days=days)]
            best = max(recent, key=lambda c: cos(clusters[c]["x"], x), default=None)
            if best is not None and 1 - cos(clusters[best]["x"], x) < below:
                placed.append((r, best))
            else:
                left.append(r)
        chosen = []
        for r in left:
            if all(r[5] != o[5] or 1 - cos(np.array(r[1]), np.array(o[1])) >= below for o in chosen):
                chosen.append(r)
        placed += [(r, max((o for o in chosen if o[5] == r[5]), key=lambda o: cos(np.array(r[1]), np.array(o[1])))[0]) for r in left]
        members = {}
        for r, c in placed:
            out[r[0]] = c
            members.setdefault(c, []).append(r)
        for c, own in members.items():
            s = clusters.setdefault(c, {"x": np.zeros(len(own[0][1])), "n": 0, "cell": own[0][5], "first": next(r[3] for r in own if r[0] == c) if c not in clusters else None, "last": own[0][2], "domains": set()})
            s["x"] = (s["x"] * s["n"] + sum(np.array(r[1]) for r in own)) / (s["n"] + len(own))
            s["n"] += len(own)
            s["last"] = max(s["last"], *(r[2] for r in own))
            s["domains"] |= {d for r in own for d in r[4]}
    return out, {c: (s["n"], s["first"], s["last"], sorted(s["domains"])) for c, s in clusters.items()}


def clusters_of(state):
    return {r.id: (r.item_count, r.first_seen_at, r.last_seen_at, r.domains) for r in state.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 8))
    out = []
    for i in range(150):
        seen = int(rng.integers(0, 300))
        out.append((i, (centres[i % 9] + rng.normal(size=8) * 0.5).tolist(), hours(seen), hours(seen - int(rng.integers(1, 2000))), sorted({"ab"[i % 2], "cde"[i % 3]}), "ab"[i // 6 % 2]))
    return out


ODD = [(500, None, hours(1), T0, ["a"], "a"), (501, [0.0] * 8, hours(1), T0, ["a"], "a"), (502, [1.0] * 8, None, T0, ["a"], "a"), (503, [1.0] * 8, hours(1), T0, ["a"], None), (None, [1.0] * 8, hours(1), T0, ["a"], "a")]


def test_steps_equal_a_plain_loop_for_any_part_size(spark, rows):
    cuts = [hours(100), hours(200)]
    want, states = by_hand(rows, cuts, 0.3, 3)
    assert len(set(want.values())) < 100  # there is something to join
    for chunk, parts in ((3, 5), (40, 1), (4096, 3)):
        df = spark.createDataFrame(rows + ODD, KIND).repartition(parts)
        found, state = assignment.assign_steps(df, [F.lit(c) for c in cuts], 0.3, days=3, chunk_rows=chunk)
        assert {r.id: r.cluster for r in found.collect()} == want
        assert clusters_of(state) == states
    empty, none = assignment.assign_steps(df.limit(0), [F.lit(cuts[0])], 0.3)
    assert empty.count() == none.count() == 0


def test_one_item_a_step_is_the_running_mean(spark):
    """The item-by-item assignment; an old publication still joins, as only observation decides whether a cluster is open."""
    vectors = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.8, 0.3], [1.0, 0.02]]
    rows = [(i, v, hours(10 * i if i < 4 else 500), hours(-720), ["a"], "a") for i, v in enumerate(vectors)]
    found, state = assignment.assign_steps(spark.createDataFrame(rows, KIND), [F.lit(r[2]) for r in rows[1:]], 0.3)
    got = {r.id: (r.cluster, r.distance) for r in found.collect()}
    assert {i: c for i, (c, _) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}  # the last comes when none is open
    assert got[0][1] is None and got[3][1] == pytest.approx(1 - cos(np.array([0.95, 0.05]), np.array(vectors[3])))
    mean = next(r.vector for r in state.collect() if r.id == 0)
    assert mean == pytest.approx(np.mean([vectors[0], vectors[1], vectors[3]], axis=0))
    assert clusters_of(state)[0] == (3, hours(-720), hours(30), ["a"])


def test_dedup_hits_change_nothing(spark, rows):
    cuts = [F.lit(hours(150))]
    base, state = assignment.assign_steps(spark.createDataFrame(rows, KIND), cuts, 0.3)
    copies = [(1000 + r[0], r[1], r[2] + dt.timedelta(hours=1), r[3], ["z"], r[5]) for r in rows[:20]]
    hits = spark.createDataFrame([(c[0], c[0] - 1000) for c in copies] + [(2000, 777)], "id long, stored_id long")
    found, after = assignment.assign_steps(spark.createDataFrame(rows + copies, KIND), cuts, 0.3, hits=hits)
    want = {r.id: r.cluster for r in base.collect()}
    assert {r.id: r.cluster for r in found.collect()} == want | {1000 + r[0]: want[r[0]] for r in rows[:20]}
    assert clusters_of(after) == clusters_of(state)


@pytest.mark.parametrize("late", [dt.timedelta(days=400), dt.timedelta(hours=1)])
def test_stream_equals_batch(spark, rows, tmp_path, late):
    """Files in any order within the bound; with a short bound, files in order of observation."""
    cuts = [hours(100), hours(200)]
    ordered = sorted(rows, key=lambda r: r[2])
    files = [ordered[i : i + 20] for i in range(0, len(ordered), 20)]
    if late > dt.timedelta(days=1):
        np.random.default_rng(1).shuffle(rows := list(rows))
        files = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    for n, own in enumerate(files):
        spark.createDataFrame(own, KIND).coalesce(1).write.parquet(f"{tmp_path}/{n:02}")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/*")
    found, state = jobs.assigned(stream, cuts, 0.3, days=3, late=late)
    want, states = by_hand(rows, cuts, 0.3, 3)
    assert {r.id: r.cluster for r in found.collect()} == want
    assert clusters_of(state) == states
