"""The registry on disk, and batches whose runs follow one another."""

import os
import random
from datetime import timedelta
from difflib import SequenceMatcher

import pytest

from test_collection import FAILURES, FIELDS, RUNS, START, item, run
from tidepost.functions.similarity import MatchRule
from tidepost.operators import state
from tidepost.operators.ordered import lowest_before
from tidepost.operators.state import SCHEMAS, Changes, empty_registry, read_registry, write_changes, write_registry
from tidepost.plans.collect import batch_changes
from pyspark.sql import functions as F


pytestmark = pytest.mark.usefixtures("interpreted")
def rows_of(frame):
    plain = frame.withColumn("raw_payload", F.to_json("raw_payload")) if "raw_payload" in frame.columns else frame
    return sorted(map(tuple, plain.collect()), key=repr)


def files_of(folder):
    found = {}
    for base, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(base, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def changes_of(spark, registry, items, runs):
    postings = spark.createDataFrame(items, FIELDS).withColumn("raw_payload", F.parse_json(F.lit("{}")))
    made = spark.createDataFrame([("u", s, r, START + timedelta(days=d), START + timedelta(days=d, minutes=1)) for s, r, d in runs], RUNS)
    return batch_changes(registry, postings, made, spark.createDataFrame([], FAILURES))


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "registry")
    many = [item("a", "r1", 0, i, f"Role {i * 7919}", str(i)) for i in range(60)]
    write_changes(changes_of(spark, empty_registry(spark), many, [("a", "r1", 0)]), None, folder, 1)
    first = read_registry(spark, folder, 1)
    before, parts = files_of(folder), first.store.parts
    assert first.jobs.count() == 60 and len(parts["jobs"]) > 20
    small = [item("b", "r2", 1, 0, "Role 7919", "1", 50), item("b", "r2", 1, 1, "Pilot", "new")]
    write_changes(changes_of(spark, first, small, [("b", "r2", 1)]), first, folder, 2)
    second = read_registry(spark, folder, 2)
    after = files_of(folder)
    assert {k: v for k, v in after.items() if k in before} == before
    for table in ("jobs", "links"):
        new = [p for p in second.store.parts[table] if p[1] == 2]
        assert 1 <= len(new) <= 2 and set(second.store.parts[table]) - set(new) <= set(parts[table])
    # The same as without a disk.
    plain = run(spark, run(spark, empty_registry(spark), many, [("a", "r1", 0)], rule=MatchRule()), small, [("b", "r2", 1)], rule=MatchRule())
    for table in SCHEMAS:
        assert rows_of(getattr(second, table)) == rows_of(getattr(plain, table)), table
    # An attempt that failed leaves files; the next one writes over them.
    write_changes(changes_of(spark, first, small[:1], [("b", "r2", 1)]), first, folder, 3)
    write_changes(changes_of(spark, second, [], [("b", "r3", 2)]), second, folder, 3)
    third = read_registry(spark, folder, 3)
    assert third.jobs.where("status = 'removed'").select("external_job_id").collect()[0][0] == "new"
    kept = {t: rows_of(getattr(third, t)) for t in SCHEMAS}
    assert state.forget(spark, folder, keep=1) > 0
    assert {t: rows_of(getattr(read_registry(spark, folder, 3), t)) for t in SCHEMAS} == kept
    assert state.forget(spark, folder, keep=1) == 0


def test_growing_tables_keep_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "CROWDED", 3)
    folder = str(tmp_path / "registry")
    write_registry(empty_registry(spark), folder, 1, buckets=2)
    for version in range(2, 9):
        before = read_registry(spark, folder, version - 1)
        row = spark.createDataFrame([("u", "kind", "job", f"job {version % 4}", "text", "{}", START)], SCHEMAS["events"])
        write_changes(Changes(added={"events": row}), before, folder, version)
    last = read_registry(spark, folder, 8)
    assert last.events.count() == 7 and last.store.buckets == 2
    numbers = [b for b, _ in last.store.parts["events"]]
    assert max(map(numbers.count, numbers)) <= 3


def test_lowest_before(spark):
    rows = [("k", i, (i * 37) % 11) for i in range(50)] + [("l", 1, 5)]
    found = lowest_before(spark.createDataFrame(rows, "key string, at int, x int"), ["key"], ["at"], "x", "low").collect()
    assert {(r.key, r.at): r.low for r in found} == {
        (k, at): min((x for q, a, x in rows if q == k and a < at), default=None) for k, at, _ in rows
    }


TITLES = ["Software Engineer", "Software Engineer II", "Data Analyst", "Data Analysts", "Pilot", "Nurse Practitioner", "Line Cook"]
COMPANIES = ["Acme", "Acme Inc", "Acme"]


def made_runs(seed):
    """Runs of three sources in order: most list what they listed before, with changes, losses and returns."""
    choose = random.Random(seed)
    runs, listed = [], {s: {} for s in "abc"}
    for day in range(7):
        source = choose.choice("abc")
        mine = listed[source]
        for key in list(mine):
            if choose.random() < 0.35:
                del mine[key]
            elif choose.random() < 0.25:
                mine[key] = (choose.choice(TITLES), choose.choice(COMPANIES))
        for _ in range(choose.randint(1, 3)):
            mine[str(choose.randint(1, 12))] = (choose.choice(TITLES), choose.choice(COMPANIES))
        names = sorted(mine, key=lambda k: choose.random())
        runs.append((source, f"r{day}", day, [(k, *mine[k]) for k in names]))
    return runs


def one_by_one(runs, ids):
    """What handling item after item gives, by job key."""
    rule, jobs, candidates, reposts = MatchRule(), {}, {}, {}

    def score(a, b):
        c, t = (SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in ((a[1], b[1]), (a[0], b[0])))
        total = rule.company_weight * c + rule.title_weight * t + rule.location_weight
        return total if c >= rule.company_gate and t >= rule.title_gate and total >= rule.composite_gate else None

    def best(key, names, status):
        found = [(score(names, j["names"]), ids[k]) for k, j in jobs.items() if k != key and j["status"] == status]
        found = [(-s, i) for s, i in found if s is not None]
        return min(found)[1] if found else None

    for source, _, day, items in runs:
        for key, *names in items:
            if key not in jobs:
                if (active := best(key, names, "active")) is not None:
                    candidates[(ids[key], active)] = ("pending", None)
                elif (gone := best(key, names, "removed")) is not None:
                    reposts[ids[key]] = gone
                jobs[key] = {"links": {}}
            jobs[key] |= {"names": names, "status": "active"}
            jobs[key]["links"][source] = (day, True)
        lost = set()
        for key, job in jobs.items():
            stale = [s for s, (seen, there) in job["links"].items() if s == source and there and seen < day]
            for s in stale:
                job["links"][s] = (job["links"][s][0], False)
            if stale and job["status"] == "active" and not any(there for _, there in job["links"].values()):
                job["status"] = "removed"
                lost.add(ids[key])
        for pair, (status, _) in candidates.items():
            if status == "pending" and lost & set(pair):
                candidates[pair] = ("dismissed", START + timedelta(days=day))
    return candidates, reposts, {ids[k]: (j["status"], *j["names"]) for k, j in jobs.items()}


def in_batches(spark, runs, cuts):
    registry = empty_registry(spark)
    for part in cuts:
        items = [item(s, r, d, i, t, k, company=c) for s, r, d, found in part for i, (k, t, c) in enumerate(found)]
        registry = run(spark, registry, items, [(s, r, d) for s, r, d, _ in part], rule=MatchRule())
        registry = registry.changed(**{t: state.written(getattr(registry, t), t) for t in SCHEMAS})
    jobs = registry.jobs.collect()
    candidates = {(c.job_id, c.candidate_job_id): (c.status, c.resolved_at) for c in registry.candidates.collect()}
    events = sorted((e.message, e.created_at) for e in registry.events.collect())
    return {
        "ids": {j.external_job_id: j.job_id for j in jobs},
        "candidates": candidates,
        "reposts": {j.job_id: j.reposted_from_job_id for j in jobs if j.reposted_from_job_id},
        "jobs": {j.job_id: (j.status, j.title) for j in jobs},
        "events": events,
    }


@pytest.mark.parametrize("seed", [28, 43])
def test_batches_of_any_size_match_as_one_item_after_the_other(spark, seed):
    runs = made_runs(seed)
    whole = in_batches(spark, runs, [runs])
    candidates, reposts, jobs = one_by_one(runs, whole["ids"])
    assert whole["candidates"] == candidates
    assert whole["reposts"] == reposts
    assert whole["jobs"] == {k: v[:2] for k, v in jobs.items()}
    assert in_batches(spark, runs, [runs[:2], runs[2:6], runs[6:]]) == whole


def test_the_scenarios_hold_what_they_are_for():
    """Candidates that stay and that are dismissed, reposts, and jobs that come back."""
    seen = set()
    for seed in (28, 43):
        runs = made_runs(seed)
        ids = {k: k for _, _, _, items in runs for k, *_ in items}
        candidates, reposts, _ = one_by_one(runs, ids)
        seen |= {s for s, _ in candidates.values()} | ({"repost"} if reposts else set())
    assert seen == {"pending", "dismissed", "repost"}
