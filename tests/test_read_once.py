"""What a batch needs more than once is read or worked out once."""

import pytest
from pyspark.sql import functions as F

from tidepost.functions import urls
from tidepost.operators import ordered
from tidepost.sources.adapters import collect
from tidepost.sources.landed import LANDED

BODIES = [
    ("a", "https://jobs.ashbyhq.com/x", 200, 0, '{"jobs":[{"id":"1","title":"T","jobUrl":"https://e.com/1"},"bare"]}'),
    ("b", "https://jobs.lever.co/x", 200, 0, '[{"id":"2","text":"U","hostedUrl":"https://e.com/2"}]'),
    ("b", "https://jobs.lever.co/x", 200, 100, "[]"),
    ("c", "https://jobs.lever.co/y", 503, None, '[{"id":"3","text":"V","hostedUrl":"https://e.com/3"}]'),
    ("d", "https://jobs.ashbyhq.com/z", 200, 0, "[]"),
]


def shown(df):
    return sorted(map(repr, df.drop("raw_payload").collect()))


def test_responses_are_parsed_once(spark):
    rows = [("1", r, "S", url, "auto", r, None, skip, status, body) for r, url, status, skip, body in BODIES]
    landed = spark.createDataFrame(rows, LANDED)
    lazy, once = collect(landed), collect(landed, once=True)
    for name, size in (("postings", 2), ("rejects", 1), ("failures", 2), ("pages", 2)):
        found = getattr(once, name)
        assert shown(found) == shown(getattr(lazy, name)) and found.count() == size
        assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize(
    "url",
    [
        "https://e.com/76", "https://e.com", "https:///p", "x:////h/p", "HTTPS://E.com/P", "https://e.com/a?k=v&l=", "https://e.com/a?UTM_x=1",
        "https://e.com/a?k=1&utm_source=x", "https://e.com/a?=v", "https://e.com/a?k=a+b", "https://e.com/a?k=%41", "https://e.com/a?", "https://e.com/a#f",
        " https://e.com/a", "https://e.com/a b\n", "https://e.com/\u00e4?k=~a-b._", "https://u@e.com/", "e.com/a", "", None, "https://e.com/" + "a" * 2000,
    ],
)
def test_plain_addresses_are_their_own_canonical_form(spark, url):
    row = spark.createDataFrame([(url,)], "url string").select(urls.canonical_url(F.col("url")), urls._rebuilt(F.col("url"))).first()
    assert row[0] == row[1]


@pytest.mark.parametrize("crowded", [0, 3, 100])
def test_known_row_counts_choose_the_way(spark, monkeypatch, crowded):
    monkeypatch.setattr(ordered, "CROWDED", crowded)
    rows = spark.range(12).select((F.col("id") % 3).alias("key"), (F.col("id") % 2 == 0).alias("late"), F.col("id").alias("at"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    found = ordered.lagged(rows, ["key", "late"], ["at"], {"out": "at"}, counted=counted)
    assert {(r["at"], r["out"]) for r in found.collect()} == {(n, n - 6 if n >= 6 else None) for n in range(12)}
