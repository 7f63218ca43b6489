"""Addresses that no host can have, deep climbs, and JSON answers whose first key holds no list."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.plans import catalog
from tidewatch.sources import items

MALFORMED = ["http://é..example/", "http://" + "é" * 80 + ".example/x", "http://a b.example/é", "http://é:x/", "http://[é/"]


def test_malformed_hosts_are_no_addresses(spark):
    rows = [(u,) for u in [*MALFORMED, "http://école.example/a/"]]
    got = spark.createDataFrame(rows, "url string").select("url", urls.canonical_url(F.col("url")).alias("c"), urls.domain_match(F.col("url"), ["example"]).alias("m")).collect()
    assert [r["c"] for r in got[:2]] == [None, None] and all(r["m"] is not None for r in got)
    assert got[-1]["c"] == "http://xn--cole-9oa.example/a"


JOINS = [
    ("https://a.example/1/2/3/4/5/6/7/8/9/10/11/12/", "../" * 10 + "k"), ("https://a.example/1/2/x", "../../../../k?a=../b#../c"), ("https://a.example/1/2/", "./k/./.."),
    ("https://a.example/1/2/", "/x/../y/./z"), ("https://a.example", "k/../m"), ("https://a.example/1/", ".."), ("https://a.example/1/?q=1", "."), ("https://a.example/b/c", "d?x=/../y"),
]


def test_steps_are_taken_however_deep(spark):
    got = spark.createDataFrame(JOINS, "base string, href string").select(urls.resolved(F.col("base"), F.col("href")).alias("u")).collect()
    assert [r["u"] for r in got] == [urljoin(b, h) for b, h in JOINS]


def test_first_list_of_an_answer_counts(spark):
    bodies = ['{"projects": 5, "items": [{"title": "a"}]}', '{"projects": {"x": {"name": "b"}, "y": 3}, "items": [{"title": "c"}]}', '{"data": "[1]"}', "[" + "1," * 499 + '{"title": "d"}, {"title": "e"}]', "no", None]
    df = spark.createDataFrame([(i, "https://j.example", b) for i, b in enumerate(bodies)], "source int, base string, body string")
    assert sorted((r["source"], r["title"]) for r in items.answered(df).collect()) == [(0, "a"), (1, "b"), (3, "d")]


def test_a_name_is_given_once():
    with pytest.raises(ValueError, match="q_review_queue_page"):
        catalog.register("q_review_queue_page", lambda spark, d: None)
