"""URL filter: splitting, rules, and a model that tells unwanted hosts from ordinary ones."""

import pytest
from granary.llm import url_filter


def judged(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    return [r for r in url_filter.judge(pages).orderBy("id").collect()]


def test_parts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?y", "http://notexample.net", "x://net/", "http://b.example.com/de/1#z", "http://q.org/fr/", "http://q.org/FR/", None, "no scheme", "http://h?p", "", "http://é.org/É"]
    got = [(r.host, r.path, r.rule) for r in judged(spark, urls)]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/"), ("notexample.net", "", None), ("net", "/", "net/"), ("b.example.com", "/de/1", "example.com/de/"), ("q.org", "/fr/", "org/fr/"),
        ("q.org", "/FR/", None), ("", "", None), ("", "", None), ("h", "", None), ("", "", None), ("é.org", "/É", None),
    ]
    assert [r.verdict for r in judged(spark, urls)][:5] == ["allow", judged(spark, urls)[1].verdict, "block", "block", "allow"]


def test_margin_agrees_with_training_features(spark):
    urls = ["http://www.spam-farm.example.com/en/1", "https://science.example.org/a/b.html", "http://a/", None, "http://" + "x" * 20000 + ".com/é"]
    bias, weights = url_filter.default_model()
    assert [r.margin for r in judged(spark, urls)] == [bias + sum(weights[b] for b in url_filter.buckets(u)) for u in urls]


def test_model_separates_unseen_urls(spark):
    bad = [f"https://{sub}{w}.example.org/en/{k}" for k, w in enumerate(("spam-farm", "cheap-pills", "casino-bonus", "free-money-now")) for sub in ("", "shop.")]
    good = [f"https://{w}.example.org/en/{k}" for k, w in enumerate(("city-museum", "science-journal", "news", "weather-today"))]
    assert {r.verdict for r in judged(spark, bad)} == {"block"}
    assert {r.verdict for r in judged(spark, good)} == {"allow"}


def test_bounds_and_empty(spark):
    with pytest.raises(ValueError):
        url_filter.train([("http://a/", 1)] * (url_filter.MAX_LABELLED + 1))
    assert judged(spark, []) == []
