"""The pruned match finds what comparing every pair finds."""

import random
from difflib import SequenceMatcher

import pytest

from tidepost.functions.similarity import MatchRule
from tidepost.operators import fuzzy

WORDS = ["senior", "sr", "software", "engineer", "ii", "iii", "data", "staff", "manager", "product", "of", "x"]
NAMES = ["acme", "acme inc", "acme labs", "globex", "globex corp", "initech", "a", "ab", "umbrella 12", "umbrella 13"]
PLACES = ["", "berlin", "berlin de", "new york ny", "new york", "remote"]


def postings(seed, count, base):
    made = random.Random(seed)
    return [
        (1, base + i, made.choice(NAMES), " ".join(made.sample(WORDS, made.randint(0, 4))), made.choice(PLACES))
        for i in range(count)
    ]


def brute(new, old, rule):
    def score(a, b):
        return SequenceMatcher(None, a, b).ratio()

    found = {}
    for _, job, company, title, place, order in new:
        best = None
        for _, other, c2, t2, p2, since in old:
            if since is not None and since >= order:
                continue
            c, t, p = score(company, c2), score(title, t2), score(place, p2)
            total = rule.company_weight * c + rule.title_weight * t + rule.location_weight * p
            if c < rule.company_gate or t < rule.title_gate or total < rule.composite_gate:
                continue
            if best is None or total > best[0]:
                best = (total, other)
        if best:
            found[job] = best[0]
    return found


@pytest.mark.parametrize("rule", [MatchRule(), MatchRule(company_gate=0.4, title_gate=0.6, composite_gate=0.6)])
def test_best_matches_equal_brute_force(spark, rule):
    new = [(*row, i) for i, row in enumerate(postings(1, 60, 1000))]
    stored = [(*row, None) for row in postings(2, 80, 0)]
    old = stored + new
    columns = "user_id int, job_id int, company string, title string, location string"
    found = fuzzy.best_matches(
        spark.createDataFrame(new, columns + ", ord int"), spark.createDataFrame(old, columns + ", since int"), rule
    )
    scores = {row["job_id"]: row["score"] for row in found.collect()}
    wanted = brute(new, old, rule)
    assert scores.keys() == wanted.keys()
    for job, score in wanted.items():
        assert scores[job] == pytest.approx(score, abs=1e-12)


def test_bags_bound_the_ratio(spark):
    made = random.Random(9)
    names = ["".join(made.choice("ab cdé9") for _ in range(made.randint(0, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(n,) for n in names], "name string").withColumn("bag", fuzzy.bag("name"))
    pairs = frame.select(fuzzy.F.col("name").alias("a"), fuzzy.F.col("bag").alias("x")).join(
        frame.select(fuzzy.F.col("name").alias("b"), fuzzy.F.col("bag").alias("y"))
    )
    for row in pairs.select("a", "b", fuzzy._apart("x", "y").alias("apart")).collect():
        matched = sum(m.size for m in SequenceMatcher(None, row.a, row.b, autojunk=False).get_matching_blocks())
        assert row.apart <= len(row.a) + len(row.b) - 2 * matched


def test_one_title_with_very_many_companies(spark):
    """Employers under one title: the pairs that reach the edit distance are few, and none that matches is lost."""
    made = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    companies = ["".join(made.choice(letters) for _ in range(12)) for _ in range(1500)]
    stored = [(1, i, c, "software engineer", "berlin", None) for i, c in enumerate(companies)]
    new = [(1, 10_000 + i, companies[i * 37][:-1] + "q", "software engineer", "berlin", i) for i in range(40)]
    columns = "user_id int, job_id int, company string, title string, location string"
    found = fuzzy.best_matches(
        spark.createDataFrame(new, columns + ", ord int"), spark.createDataFrame(stored, columns + ", since int")
    )
    matches = {r.job_id: (r.match_id, r.score) for r in found.collect()}
    assert {j: m for j, (m, _) in matches.items()} == {10_000 + i: i * 37 for i in range(40)}
    sides = [spark.createDataFrame([(r[2],) for r in rows], "name string").select("name", fuzzy.bag("name").alias("bag")) for rows in (new, stored)]
    pairs = sides[0].select(fuzzy.F.col("name").alias("a"), fuzzy.F.col("bag").alias("x")).join(
        sides[1].select(fuzzy.F.col("name").alias("b"), fuzzy.F.col("bag").alias("y"))
    )
    # At the company gate of 0.6 two names of twelve letters may differ in nine of them.
    left = pairs.where(fuzzy._apart("x", "y") <= 9).count()
    assert left < 0.1 * len(new) * len(stored)
