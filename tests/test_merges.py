"""Merges in a batch against merging one after the other, and what a round writes."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidepost.operators import review
from tidepost.operators.state import empty_registry
from tidepost.plans.registered import QUERIES

START = datetime(2031, 1, 1, tzinfo=timezone.utc)

pytestmark = pytest.mark.usefixtures("interpreted")


def filled(spark, jobs, links, candidates):
    """A registry of one user; columns that a merge does not look at are null."""
    empty = empty_registry(spark)

    def table(name, rows, columns):
        schema = getattr(empty, name).schema
        made = spark.createDataFrame([("u", *row) for row in rows], "user_id string, " + columns)
        return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    return empty.changed(
        jobs=table("jobs", jobs, "job_id string, status string"),
        links=table("links", [(j, s, j) for j, s in links], "job_id string, source_id string, origin_job_id string"),
        versions=table("versions", [(j, s, j) for j, s in links], "job_id string, content_hash string, origin_job_id string"),
        candidates=table("candidates", candidates, "candidate_id string, job_id string, candidate_job_id string, status string"),
    )


def asked(spark, rows):
    return spark.createDataFrame([("u", *row) for row in rows], "user_id string, candidate_id string, keep string, decided_at timestamp")


def one_by_one(jobs, links, candidates, decisions):
    status, places, state = dict(jobs), {(j, s): j for j, s in links}, {c: (a, b, s) for c, a, b, s in candidates}
    outcomes, moves = {}, []
    for candidate, keep, _ in sorted(decisions, key=lambda d: (d[2], d[0])):
        a, b, now = state.get(candidate, (None, None, None))
        kept, gone = (a, b) if keep == "job" else (b, a)
        if now is None:
            outcomes[candidate] = "not_found"
        elif now != "pending" or status.get(a) != "active" or status.get(b) != "active":
            outcomes[candidate] = "not_pending"
        else:
            outcomes[candidate], status[gone] = "merged", "merged"
            held = {s for (_, s), at in places.items() if at == kept}
            for (origin, s), at in sorted(places.items()):
                if at == gone and s not in held:
                    places[origin, s] = kept
                    moves.append((candidate, origin, s))
    return outcomes, status, sorted((at, s, origin) for (origin, s), at in places.items()), sorted(moves)


@pytest.mark.parametrize("seed", range(3))
def test_merges_one_after_the_other(spark, seed):
    choose = random.Random(seed)
    names = [f"j{i}" for i in range(24)]
    jobs = [(j, choose.choice(["active"] * 7 + ["removed"])) for j in names]
    links = sorted({(j, f"s{choose.randrange(5)}") for j in names for _ in range(2)})
    pairs = [choose.sample(names[k:k + 6], 2) for k in range(0, 24, 6) for _ in range(8)]
    candidates = [(f"c{i:02}", a, b, choose.choice(["pending"] * 6 + ["dismissed"])) for i, (a, b) in enumerate(pairs)]
    decisions = [
        (c, choose.choice(["job", "candidate"]), START + timedelta(hours=choose.randrange(40))) for c, *_ in candidates
    ] + [("unknown", "job", START)]
    outcomes, status, places, moves = one_by_one(jobs, links, candidates, decisions)
    assert list(outcomes.values()).count("merged") > 3
    after, checked = review.merged_registry(filled(spark, jobs, links, candidates), asked(spark, decisions))
    assert sorted((r.candidate_id, r.outcome) for r in checked.collect()) == sorted(outcomes.items())
    assert {r.job_id: r.status for r in after.jobs.collect()} == status
    for table, key in (("links", "source_id"), ("versions", "content_hash")):
        assert sorted((r.job_id, r[key], r.origin_job_id) for r in getattr(after, table).collect()) == places
    for kind in ("link", "version"):
        found = after.moves.where(F.col("kind") == kind).collect()
        assert sorted((r.candidate_id, r.origin_job_id, r.moved_key) for r in found) == moves


def test_a_round_writes_what_is_open(spark, monkeypatch):
    """A chain of three among many decisions that the first look settles."""
    many = 50
    jobs = [(f"j{i}", "active") for i in range(4)] + [(f"r{i}", "removed") for i in range(many + 1)]
    candidates = [(f"c{i}", f"j{i + 1}", f"j{i}", "pending") for i in range(3)]
    candidates += [(f"d{i}", f"r{i + 1}", f"r{i}", "pending") for i in range(many)]
    decisions = [(c, "job", START + timedelta(hours=i)) for i, (c, *_) in enumerate(candidates)]
    sizes = {}

    def counted(df, label, write=review.written):
        out = write(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(review, "written", counted)
    links = [(j, j) for j, _ in jobs]
    after, checked = review.merged_registry(filled(spark, jobs, links, candidates), asked(spark, decisions))
    assert checked.count() == many + 3 and checked.where("outcome = 'merged'").count() == 3
    assert sorted(r.job_id for r in after.links.where("job_id LIKE 'j%'").collect()) == ["j3"] * 4
    assert sizes["decisions"][0] == many + 3 and sum(sizes["decisions"][1:]) <= 3 * 3
    assert max(sum(v) for k, v in sizes.items() if k != "decisions") <= 3 * 4


def test_tombstones_need_no_rows_of_links_and_versions(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(review, "written", lambda df, label, write=review.written: labels.append(label) or write(df, label))
    found = QUERIES["M9_tombstones"](spark, "/root/testdata/sf0.001")
    assert found.where("status = 'merged' AND merged_into_job_id IS NOT NULL").count() > 0
    assert set(labels) == {"decisions"}
    files = [file.rsplit("/", 1)[-1] for file in found.inputFiles()]
    assert "lineitem.parquet" not in files


def test_decided_tables_are_those_of_the_merge(spark):
    jobs = [(f"j{i}", "active") for i in range(6)]
    candidates = [(f"c{i}", f"j{i + 1}", f"j{i}", "pending") for i in range(5)]
    decisions = [(c, ("job", "candidate")[i % 2], START + timedelta(hours=7 * i % 5)) for i, (c, *_) in enumerate(candidates)]
    state, wanted = filled(spark, jobs, [(j, j) for j, _ in jobs], candidates), asked(spark, decisions)
    tables, checked = review.decided(state, wanted)
    after, outcomes = review.merged_registry(state, wanted)
    assert sorted(checked.collect()) == sorted(outcomes.collect())
    for name, columns in {
        "jobs": ["job_id", "status", "merged_into_job_id"], "candidates": ["candidate_id", "status", "kept_job_id"], "events": ["entity_id", "message"],
    }.items():
        found = sorted(map(tuple, tables[name].select(*columns).collect()), key=repr)
        assert found == sorted(map(tuple, getattr(after, name).select(*columns).collect()), key=repr)
