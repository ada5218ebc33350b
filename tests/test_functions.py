"""Boundary facts of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import urls as U


def values(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names] if rows else None).orderBy("i").select(*columns).collect()]


def test_canonical_url(spark):
    cases = {
        "HTTPS://WWW.Example.com/a/?utm_source=x&b=2&a=1#frag": "https://example.com/a?a=1&b=2",
        "http://example.com": "http://example.com/",
        "http://example.com:80/": "http://example.com/",
        "https://m.example.com/x/": "https://m.example.com/x",
        "https://example.com/x?REF=1&at_medium=2": "https://example.com/x",
        "https://example.com/?q=a%20b": "https://example.com/?q=a+b",
        "  not a url ": "not a url",
    }
    got = values(spark, [(k,) for k in cases], U.canonical(F.col("c0")))
    assert [g[0] for g in got] == list(cases.values())


def test_hosts_match_from_the_right(spark):
    from storyloom.operators.ingest import trusted_items

    rows = [(1, "https://hnrss.org/best", "https://dealbook.nytimes.com/x"), (2, "https://hnrss.org/best", "https://nytimes.com.evil.example/x"), (3, "https://hnrss.org/best", "nonsense"), (4, "https://other.example/rss", "nonsense"), (5, "https://news.ycombinator.com/rss", "https://www.nature.com/a")]
    kept = trusted_items(spark.createDataFrame(rows, "id int, feed_url string, url string"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 4, 5]


def test_link_kinds(spark):
    cases = {"/x": "other", "https://www.x.com/a": "social", "https://e.example/track/open?x": "tracking", "https://e.example/view-in-browser": "masthead", "https://e.example/?utm_source=n": "masthead", "https://e.example/?id=3": "article", "https://e.example": "masthead", "https://e.example/deep?utm_source=n": "article"}
    assert [g[0] for g in values(spark, [(k,) for k in cases], U.link_kind(F.col("c0")))] == list(cases.values())


def test_titles(spark):
    got = values(spark, [("Reuters — Foo",), ("Reuters – Foo",), ("Reuters - Foo!",)], T.normalised_title(F.col("c0")))
    assert {g[0] for g in got} == {"reuters foo"}
    assert values(spark, [("日本: A!B",)], T.normalised_headline(F.col("c0"))) == [("日本 a b",)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("Unsubscribe\nView this email in your browser\nbody\nUnsubscribe here\ntail", "Unsubscribe\nView this email in your browser\nbody"),
        ("View this email in your browser\nbody text", "View this email in your browser\nbody text"),
        ("body\n  manage preferences\nrest", "body"),
        ("", ""),
    ],
)
def test_boilerplate(spark, body, want):
    assert values(spark, [(body,)], T.without_boilerplate(F.col("c0"))) == [(want,)]


def test_links_of_html_and_text(spark):
    html = '<a class="x" href="https://a.example/1">1</a><a href="mailto:a@b">m</a><a href=\'https://a.example/1\'>again</a><a href="https://a.example/unsubscribe?x">u</a><a href="#top">t</a><a href="/rel">r</a>'
    assert values(spark, [(html, "http://no.example")], T.links(F.col("c0"), F.col("c1"))) == [(["https://a.example/1", "/rel"],)]
    assert values(spark, [("", "see http://t.example/x) and http://t.example/x")], T.links(F.col("c0"), F.col("c1"))) == [(["http://t.example/x"],)]


def test_decay_and_snippet(spark):
    at = "TIMESTAMP '2024-01-03 00:00:00'"
    rows = spark.sql(f"SELECT {at} AS now, {at} - INTERVAL 48 HOUR AS old, {at} + INTERVAL 1 HOUR AS later")
    r = rows.select(T.recency_decay(F.col("old"), F.col("now"), F.lit("economy")), T.recency_decay(F.col("later"), F.col("now"), F.lit("economy"))).first()
    assert abs(r[0] - 0.5) < 1e-12 and r[1] == 1.0
    text = values(spark, [("a  " * 400,)], T.snippet(F.col("c0")))[0][0]
    assert len(text) == 480 and text.endswith("…")


def test_curation_json(spark):
    cases = ['{"curation_score": 80, "curation_rationale": "x"}', '{"curation_score": "80", "curation_rationale": "x"}', '{"curation_score": 100.5, "curation_rationale": "x"}', '{"curation_score": 1, "curation_rationale": "x",}', "[1]", "nope", '```json\n{"curation_score": 0, "curation_rationale": "x"}\n```']
    assert [g[0] for g in values(spark, [(c,) for c in cases], T.curation_failure(F.col("c0"))[0])] == [None, "number", "range", None, "object", "json", None]


def test_escapes(spark):
    assert values(spark, [("a\x01<&\"'>",)], T.escaped(F.col("c0"), "&apos;", True)) == [("a&lt;&amp;&quot;&apos;&gt;",)]
