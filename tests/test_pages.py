"""Postings inside pages: nesting, order, escapes, and cost in proportion to the page."""

import json
import random
import time

from pyspark.sql import functions as F

from tidepost.sources.page_postings import has_posting, page_postings


def script(text):
    return f'<html><script type="application/ld+json">{text}</script></html>'


def in_order(value):
    """Titles of all postings, depth first, @graph first."""
    if isinstance(value, list):
        return [t for v in value for t in in_order(v)]
    if not isinstance(value, dict):
        return []
    kinds = value.get("@type")
    own = [value.get("title")] if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]) else []
    # Spark reads the keys of an object in their order.
    keys = sorted(value, key=lambda k: (k != "@graph", k))
    return own + [t for k in keys for t in in_order(value[k])]


def made(choose, depth):
    if depth == 0 or choose.random() < 0.2:
        return choose.choice(["x", 3, None, True, "JobPosting", "[{", '"]}\\'])
    if choose.random() < 0.4:
        return [made(choose, depth - 1) for _ in range(choose.randint(0, 4))]
    found = {k: made(choose, depth - 1) for k in choose.sample(["a", "b", "@graph", "z[{", 'q"'], choose.randint(0, 3))}
    if choose.random() < 0.5:
        found["@type"] = choose.choice(["JobPosting", ["Thing", "JobPosting"], "Thing"])
        found["title"] = f"t{choose.randint(0, 10**6)}"
    return found


def titles(spark, pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, page string")
    found = frame.select("id", F.transform(page_postings(F.col("page")), lambda v: F.try_variant_get(v, "$.title", "string")).alias("t"), has_posting(F.col("page")).alias("has"))
    rows = sorted(found.collect())
    return [r.t for r in rows], [r.has for r in rows]


def test_nested_postings_in_document_order(spark):
    choose = random.Random(3)
    values = [made(choose, 7) for _ in range(60)]
    deep = "[" * 300 + json.dumps({"@type": "JobPosting", "title": "deep"}) + "]" * 300
    escaped = '{"@type": "Job\\u0050osting", "title": "escaped"}'
    pages = [*[script(json.dumps(v)) for v in values], script(deep), script(escaped), script("[[[{ broken JobPosting"), None, "", script("[]") + script(escaped)]
    found, has = titles(spark, pages)
    expected = [in_order(v) for v in values] + [["deep"], ["escaped"], [], None, [], ["escaped"]]
    assert [t or None for t in found] == [t or None for t in expected]
    assert [bool(h) for h in has] == [bool(t) for t in expected]


def test_cost_grows_with_the_page(spark):
    def page(count):
        return script(json.dumps({"@graph": [{"@type": "JobPosting", "title": f"t{i}", "jobLocation": {"address": {"addressLocality": "Berlin"}}} for i in range(count)]}))

    def seconds(count):
        frame = spark.createDataFrame([(page(count),)], "page string").repartition(1)
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            assert frame.select(F.size(page_postings(F.col("page")))).first()[0] == count
            best = min(best, time.perf_counter() - start)
        return best

    seconds(20)
    few, many = seconds(1000), seconds(10_000)
    assert many < 25 * few + 1
