"""Rules of cleaned responses, waves, runs, details and the log of attempts, on small cases."""

import datetime
import json
import random

from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import briefs, candidates, detail, ingest, trending
from storyloom.plans import run as scoring
from storyloom.sources.feeds import feeds_of, items_of, videos_of
from storyloom.streaming import jobs

T0 = datetime.datetime(2024, 1, 2, 3)


def pitch(**changed):
    return {"hook": " h ", "thesis": "t", "steelman": "s", "break": "b", "why_now": "w", "fit": "f", "collision": " ", "evidence": [{"title": "x", "url": "u2"}, {"title": "y", "url": "nowhere"}, {"title": 1, "url": "u1"}, {"title": "z", "url": "u1"}], "candidate_ids": ["9", 1, "2", "1"]} | changed


def test_pitches_are_cleaned_or_rejected_whole(spark):
    texts = {
        1: json.dumps({"pitches": [pitch(), pitch(collision=" c ")]}),
        2: json.dumps({"pitches": [pitch(), pitch(fit=" ")]}),
        3: json.dumps({"pitches": [pitch()] * 7}),
        4: json.dumps({"pitches": [pitch(evidence=[{"title": "y", "url": "nowhere"}])]}),
        5: json.dumps({"pitches": [pitch(candidate_ids="1")]})[:-1] + ", }",
        6: json.dumps({"pitches": [pitch(hook=5)]}),
        7: json.dumps({"pitches": {}}),
        8: "nonsense",
        9: None,
        10: "",
    }
    responses = spark.createDataFrame(list(texts.items()), "response_id long, raw string")
    urls = spark.createDataFrame([(i, u) for i in texts for u in ("u1", "u2", "u2")], "response_id long, url string")
    ids = spark.createDataFrame([(i, c) for i in texts for c in ("1", "2")], "response_id long, id string")
    got = {r["response_id"]: r for r in briefs.valid_pitches(responses, urls, ids).collect()}
    assert [i for i in got if got[i]["valid"]] == [i for i in got if got[i]["cleaned"]] and {i for i in got if got[i]["valid"]} == {1, 5}
    first, second = json.loads(got[1]["cleaned"])
    assert first == {"hook": "h", "thesis": "t", "steelman": "s", "break": "b", "why_now": "w", "fit": "f", "collision": None, "evidence": [{"title": "x", "url": "u2"}, {"title": "z", "url": "u1"}], "candidate_ids": ["2", "1"]}
    assert second["collision"] == "c" and json.loads(got[5]["cleaned"])[0]["candidate_ids"] == []
    assert (got[3]["pitches"], got[7]["pitches"], got[9]["pitches"], got[1]["known_ids"]) == (7, 0, 0, 4)
    other = briefs.valid_pitches(responses.filter("response_id = 1"), urls.filter("response_id = 2"), ids)
    assert not other.first()["valid"]  # what another response may cite isn't known to this one
    assert briefs.valid_pitches(responses.limit(0), urls, ids).count() == 0


def test_publisher_is_cleaned(spark):
    good = {"slug": "Pub-1", "name": "N", "primary_domain": "economy", "domains": ["sports", "economy", "national"], "authority": 99.5, "language": "", "reasoning": "r" * 600}
    rows = [(1, "so: " + json.dumps(good) + " done"), (2, json.dumps(good | {"slug": "a b"})), (3, json.dumps(good | {"authority": "9"})), (4, json.dumps(good | {"reasoning": 3, "authority": -4})), (5, None)]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, raw string").select("i", T.publisher(F.col("raw")).alias("p")).collect()}
    assert (got[1]["slug"], got[1]["domains"], got[1]["authority"], got[1]["language"], got[1]["reasoning"]) == ("pub-1", ["economy", "national"], 100, "en", "r" * 500)
    assert (got[4]["reasoning"], got[4]["authority"]) == ("", 0)
    assert [got[i]["failure"] for i in (2, 3, 5)] == ["slug", "authority", "json"] and got[2]["slug"] is None


def test_pools_are_what_was_new_at_each_days_end(spark):
    day = datetime.timedelta(days=1)
    rows = [(1, T0, T0 + 2 * day, None), (2, T0, T0 + 9 * day, T0 + day), (3, T0, T0 + day / 2, None), (4, T0, T0 + 9 * day, T0)]
    made = spark.createDataFrame(rows, "candidate_id long, created_at timestamp, expires_at timestamp, decided_at timestamp")
    got = sorted((r["candidate_id"], r["run_id"]) for r in trending.daily_pools(made).collect())
    assert got == [(1, "2024-01-02"), (1, "2024-01-03"), (2, "2024-01-02")]


def test_waves_only_of_mornings_and_apart_by_run(spark):
    rows = [(i, i, f"story {i % 3}", T0, "economy", "hot", "new", [f"k{i % 2}", " "], ["t"], run) for run in ("a", "b", "c") for i in range(4)]
    pool = spark.createDataFrame(rows, "candidate_id long, cluster_id long, headline string, created_at timestamp, primary_domain string, temperature string, trajectory string, keywords array<string>, tags array<string>, run_id string")
    stories = trending.one_per_story(pool, "run_id")
    assert sorted((r["run_id"], r["candidate_id"]) for r in stories.collect()) == [(r, i) for r in "abc" for i in range(3)]  # 3 has the headline of 0
    texts = {r["run_id"]: r["description"] for r in trending.waves(stories).collect()}
    assert texts == dict.fromkeys("abc", "t · 3 clusters · economy\n\nKeywords: k0")
    fresh = pool.withColumns({"run_kind": F.when(F.col("run_id") == "a", "morning").otherwise("afternoon"), "rationale": F.lit(""), "curation_score": F.lit(50.0), "is_exclusive": F.lit(False)}).filter("run_id <> 'c'")
    entries = candidates.pulse_entries(fresh, trending.waves(stories)).collect()
    assert [(r["run_id"], r["title"], r["rank"]) for r in entries if r["kind"] == "waves"] == [("a", "Waves — a", None)]
    feed = candidates.newest_entries(candidates.pulse_entries(fresh, trending.waves(stories)), 9).collect()
    assert [r["kind"] for r in feed] == ["candidate"] * 8 + ["waves"] and feed[-1]["link"] == "https://feeds.example/"


def halts(rows, ceiling, spent, projected):
    """The loop that a run is, call by call."""
    out, done = {}, False
    for i, _, decision, failed, a, b in sorted(rows, key=lambda r: (-r[1], r[0])):
        if done or spent + projected[0] >= ceiling:
            done, out[i] = True, (True, 0)
            continue
        spent += a
        out[i] = (False, a)
        if failed == "summarise" or decision == "drop":
            continue
        if spent + projected[1] >= ceiling:
            done, out[i] = True, (True, a)
            continue
        spent += b
        out[i] = (False, a + b)
    return out


def test_a_run_halts_where_the_loop_does(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(20)), rng.choice(["pass", "drop", "flag"]), rng.choice([None, "summarise", "curate"]), rng.randrange(50), rng.randrange(70)) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster_id long, score double, decision string, failed string, summarise_micros long, curate_micros long")
    for ceiling, spent, projected in ((10**9, 0, (0, 0)), (1000, 0, (50, 70)), (1000, 400, (0, 90)), (10, 10, (0, 0)), (1500, 0, (1, 1))):
        got = {r["cluster_id"]: (r["halted"], r["micros"]) for r in scoring.charged(df, ceiling, spent, projected).collect()}
        assert got == halts(rows, ceiling, spent, projected)


def test_source_rows_do_not_depend_on_parts(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(5), rng.randrange(4), T0 + datetime.timedelta(hours=rng.randrange(40)), i, 1, i, f"t{i}", f"u{i}") for i in range(200)]
    items = spark.createDataFrame(rows, "cluster_id long, source_id long, published_at timestamp, order_id long, line long, part_id long, title string, url string")
    sources = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "source_id long, name string")
    want, n = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3])):
        n[r[0]] = n.get(r[0], 0) + 1
        want[r[7]] = n[r[0]]
    for parts in (1, 7):
        assert {r["url"]: r["position"] for r in detail.source_rows(items, sources, parts).collect()} == want
    assert detail.source_rows(items.limit(0), sources, 3).count() == 0


def test_archive_links_need_their_types(spark):
    links = [{"title": "a", "url": "u", "similarity": 0.5, "type": "x"}, {"title": 1, "url": "u", "similarity": 1}, {"url": "u"}, 3, {"title": "b", "url": "v", "similarity": 1}]
    rows = [(1, json.dumps({"links": links})), (2, None), (3, "{}"), (4, '{"links": 5}'), (5, "no")]
    got = {r["i"]: [tuple(x) for x in r["l"]] for r in spark.createDataFrame(rows, "i int, raw string").select("i", detail.archive_links(F.col("raw")).alias("l")).collect()}
    assert got == {1: [("a", "u", 0.5), ("b", "v", 1.0)], 2: [], 3: [], 4: [], 5: []}


def test_only_arrays_are_arrays_of_json(spark):
    rows = [(1, '{"l": [1, "a", null]}'), (2, '{"l": {"a": 1}}'), (3, '{"l": "[1]"}'), (4, '{"l": 7}'), (5, '{"l": null}'), (6, "{}"), (7, '{"l": []}'), (8, "[1]"), (9, "no"), (10, None)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", F.size(T.json_items(F.try_parse_json("raw"), "$.l")).alias("n"), T.json_items(F.try_parse_json("raw"), "$.l").isNull().alias("none")).collect()
    assert {r["i"]: r["n"] for r in got if not r["none"]} == {1: 3, 7: 0}


def test_details_of_known_and_unknown_sources(spark):
    """An exclusive's earliest row; a source that isn't known counts as a follower, but is not listed and never exclusive."""
    hour = datetime.timedelta(hours=1)
    made = [(1, 1, 0, 2, 1), (1, 1, 0, 1, 2), (1, 1, 0, 1, 1), (1, 2, 5, 0, 1), (2, 9, 0, 1, 1), (2, 1, 6, 2, 1), (3, 1, 0, 1, 1), (4, 1, 0, 1, 1), (4, 9, 5, 1, 2), (6, 9, 0, 1, 1), (7, 1, 0, 1, 1), (7, 2, 4, 1, 2), (8, 2, 0, 1, 1), (8, 1, 9, 1, 2), (9, 2, 0, 1, 1), (9, 1, 0, 1, 2), (9, 1, 9, 1, 3)]
    items = spark.createDataFrame([(c, s, T0 + h * hour, o, n, 0, f"t{o}-{n}", f"u{o}-{n}") for c, s, h, o, n in made], "cluster_id long, source_id long, published_at timestamp, order_id long, line int, part_id long, title string, url string")
    sources = spark.createDataFrame([(1, "one", 80), (2, "two", 70)], "source_id long, name string, authority_score int")
    rows = spark.createDataFrame([(c + 100, c, '{"links": [{"title": "a", "url": "b", "similarity": 1}]}') for c in range(1, 10)], "candidate_id long, cluster_id long, archive_payload string")
    got = {r["cluster_id"]: r for r in detail.details(rows, items, sources).collect()}
    assert {c: (r["exclusive"]["source_id"], r["exclusive"]["name"], r["exclusive"]["title"]) for c, r in got.items() if r["exclusive"]} == {1: (1, "one", "t1-1"), 4: (1, "one", "t1-1")}
    assert {c: (r["n_rows"], r["n_sources"], [x["name"] for x in r["listed"] or []]) for c, r in got.items()} == {
        1: (4, 2, ["one", "two"]), 2: (1, 1, ["one"]), 3: (1, 1, ["one"]), 4: (1, 1, ["one"]), 5: (None, None, []), 6: (None, None, []), 7: (2, 2, ["one", "two"]), 8: (2, 2, ["two", "one"]), 9: (3, 2, ["one", "two"]),
    }
    assert got[5]["listed"] is None and got[6]["first_at"] is None and all(len(r["archive_links"]) == 1 for r in got.values())


def test_errors_merge_into_any_metadata(spark):
    rows = [(1, '{"b":[1,{"c":null}],"last_processing_error":"old"}'), (2, None), (3, "[1]"), (4, "no"), (5, "{}")]
    got = {r["i"]: json.loads(r["j"]) for r in spark.createDataFrame(rows, "i int, raw string").select("i", T.with_json_field(F.col("raw"), "last_processing_error", F.lit('a "b"')).alias("j")).collect()}
    assert got[1] == {"b": [1, {"c": None}], "last_processing_error": 'a "b"'} and all(got[i] == {"last_processing_error": 'a "b"'} for i in (2, 3, 4, 5))


def test_attempts_that_come_again_change_nothing(spark, tmp_path):
    log = [(1, 1, "failed", "x"), (1, 2, "failed", "y"), (1, 3, "normal", None), (1, 4, "failed", "late"), (2, 1, "failed", "z"), (3, 1, "dedup_hit", None)]
    schema = "raw_id long, attempt int, outcome string, error string"
    want = {(1, 2, "normal", "y"), (2, 1, None, "z"), (3, 0, "dedup_hit", None)}
    rng = random.Random(3)
    for n, rows in enumerate((log, log * 3, log + log[::-1])):
        rng.shuffle(rows := list(rows))
        assert {tuple(r) for r in ingest.settled(spark.createDataFrame(rows, schema)).collect()} == want
        path = str(tmp_path / str(n))
        for row in rows:  # a file, and so a micro-batch of its own or with others, for each
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(path)
        assert {tuple(r) for r in jobs.processed(stream).collect()} == want


def test_feeds_keep_their_metadata(spark):
    feed = "<channel><title>F</title><item><title> a </title><link>l1</link><guid></guid><id>i1</id><category>x</category><category>y</category><enclosure url='e' type='t'/></item><item><title>b</title><link>l2</link></item><item><title> </title><link>l3</link></item><item><title>c</title></item></channel>"
    rows = items_of(feeds_of(spark.createDataFrame([(feed,), ("<channel><title>G</title></channel>",), (None,)], "value string")), F.lit(T0)).collect()
    assert [(r["external_id"], r["title"], r["url"], r["published_at"]) for r in rows] == [("i1", "a", "l1", T0), ("l2", "b", "l2", T0)]
    assert rows[0]["raw_meta"].asDict(True) == {"feedTitle": "F", "categories": ["x", "y"], "enclosure": {"url": "e", "type": "t"}}
    assert rows[1]["raw_meta"].asDict(True) == {"feedTitle": "F", "categories": None, "enclosure": None}


def test_videos_need_id_link_and_title(spark):
    rows = [("1", "u", " t ", '"said"', "c", "s"), ("2", "u", "t", '["", "b"]', "c", "s"), ("3", "u", "t", '["a", "b"]', None, None), ("4", "u", "t", '""', None, "s"), ("5", "u", "t", None, None, None), (None, "u", "t", None, None, None), ("7", None, "t", None, None, None), ("8", "u", "  ", None, None, None)]
    got = videos_of(spark.createDataFrame(rows, "external_id string, url string, title string, media string, content string, snippet string")).collect()
    assert [(r["external_id"], r["title"], r["description"]) for r in got] == [("1", "t", "said"), ("2", "t", "c"), ("3", "t", "a"), ("4", "t", "s"), ("5", "t", None)]


def test_week_has_what_was_updated_and_its_decisions(spark):
    day = lambda n: T0 + datetime.timedelta(days=n)
    pool = spark.createDataFrame([(1, 1, "old", "new", 5.0, day(-20), day(1), None), (2, 2, "new", "passed", 9.0, day(2), day(30), None), (3, 3, "other", "new", 7.0, day(-20), day(-10), None)], "candidate_id long, cluster_id long, headline string, status string, curation_score double, created_at timestamp, updated_at timestamp, archive_payload string")
    items = spark.createDataFrame([(2, day(i), 0, 0, 0, i, f"t{i}", f"u{i}") for i in range(7)], "cluster_id long, published_at timestamp, source_id long, part_id long, order_id long, line long, title string, url string")
    got = briefs.context(pool, items, F.lit(T0), F.lit(day(7))).orderBy("rank").collect()
    assert [(r["candidate_id"], r["status"]) for r in got] == [(2, "passed"), (1, "new")] and [x["url"] for x in got[0]["sources"]] == ["u6", "u5", "u4", "u3", "u2"] and got[1]["sources"] is None
    votes = spark.createDataFrame([(1, 1, "pick", "a", day(1)), (2, 3, "pass", "b", day(2)), (3, 2, "pass", "c", day(8))], "feedback_id long, candidate_id long, action string, reason string, created_at timestamp")
    assert [(r["feedback_id"], r["headline"]) for r in briefs.decisions(votes, pool, F.lit(T0), F.lit(day(7))).collect()] == [(2, "other"), (1, "old")]
