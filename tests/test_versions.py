"""Stored versions found by the fields of their content."""

import pytest

from tidepost.operators import ordered
from tidepost.operators.versions import previous_version
from tidepost.plans.registered import QUERIES


def test_previous_version_by_fields(spark):
    jobs = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 5, "a"), (4, 5, None)], "job_id int, pay int, type string")
    versions = spark.createDataFrame(
        [(1, 5, "a", 10, True), (1, 6, "a", 11, True), (2, None, "a", 12, False), (2, 5, "a", 13, True), (4, 5, "a", 14, True)],
        "job_id int, pay int, type string, seen_at int, is_material boolean",
    )
    found = previous_version(jobs, versions, ["pay", "type"])
    assert found.columns == ["job_id", "pay", "type", "version_seen_at", "is_material"]
    assert sorted((r.job_id, r.version_seen_at, r.is_material) for r in found.collect()) == [
        (1, 10, True), (2, 12, False), (3, None, None), (4, None, None)
    ]


def test_only_the_versions_found_are_hashed(spark):
    plan = QUERIES["J11_previous_version"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert above.count("sha2(") == 1 and "sha2(" not in below


@pytest.mark.parametrize("name, hashed", [("M3_version_history", True), ("J13_changed_jobs", False), ("G1_dashboard", False), ("G2_changed_job_count", False)])
def test_sightings_are_shuffled_as_fields(spark, monkeypatch, name, hashed):
    copies = []
    monkeypatch.setattr(ordered, "written", lambda df, label, write=ordered.written: copies.append(label) or write(df, label))
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not copies and "rangepartitioning" not in plan
    assert "Exchange" in plan and "sha2(" not in plan.split("Exchange", 1)[1]
    assert ("sha2(" in plan) == hashed
