"""Collection batches: change, removal, revival, repost, failure, tombstones."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepost.operators.state import empty_registry
from tidepost.operators.tombstones import survivors
from tidepost.plans.collect import collect_batch
from tidepost.sources.adapters import collect
from tidepost.sources.landed import LANDED

pytestmark = pytest.mark.usefixtures("interpreted")
START = datetime(2031, 1, 1)
FIELDS = (
    "user_id string, source_id string, source_name string, run_id string, started_at timestamp, position bigint, "
    "company_name string, title string, application_url string, source_job_url string, description_text string, "
    "description_html string, department string, location string, remote_type string, employment_type string, "
    "compensation_min int, compensation_max int, currency string, ats_type string, external_job_id string, "
    "published_at timestamp"
)
RUNS = "user_id string, source_id string, run_id string, started_at timestamp, completed_at timestamp"
FAILURES = "user_id string, source_id string, run_id string, started_at timestamp, error_type string, error_message string"


def item(source, run, day, position, title, key, pay=None, html=None, company="Acme", ats="lever"):
    return (
        "u", source, f"Source {source}", run, START + timedelta(days=day), position, company, title,
        f"https://jobs.example.com/{key}", None, None, html, None, "Berlin", None, None, pay, None, None, ats, key, None,
    )


def run(spark, registry, items, runs, failed=(), rule=None):
    postings = spark.createDataFrame(items, FIELDS).withColumn("raw_payload", F.parse_json(F.lit("{}")))
    made = spark.createDataFrame(
        [("u", s, r, START + timedelta(days=d), START + timedelta(days=d, minutes=1)) for s, r, d in runs], RUNS
    )
    errors = spark.createDataFrame(
        [("u", "?", r, START, "CollectorError", "GET https://x/?token=abc failed") for r in failed], FAILURES
    )
    kwargs = {} if rule is None else {"rule": rule}
    return collect_batch(registry, postings, made, errors, **({"rule": None} | kwargs))


def jobs(registry):
    return {r["external_job_id"]: r for r in registry.jobs.collect()}


def test_change_removal_and_revival(spark):
    first = run(spark, empty_registry(spark), [item("a", "r1", 0, 0, "Cook", "1", 10), item("a", "r1", 0, 1, "Pilot", "2")], [("a", "r1", 0)])
    assert {k: j["status"] for k, j in jobs(first).items()} == {"1": "active", "2": "active"}
    # Pay changes: material. The second posting is gone.
    second = run(spark, first, [item("a", "r2", 1, 0, "Cook", "1", 20)], [("a", "r2", 1)])
    found = jobs(second)
    assert found["1"]["compensation_min"] == 20 and found["1"]["status"] == "active"
    assert found["2"]["status"] == "removed" and found["2"]["removed_at"] == START + timedelta(days=1)
    assert sorted(r["is_material"] for r in second.versions.collect()) == [False, False, True]
    counters = {r["run_id"]: (r["jobs_created"], r["jobs_updated"]) for r in second.runs.collect()}
    assert counters == {"r1": (2, 0), "r2": (0, 1)}
    # Seen again: active again, same job.
    third = run(spark, second, [item("a", "r3", 2, 0, "Cook", "1", 20), item("a", "r3", 2, 1, "Pilot", "2")], [("a", "r3", 2)])
    again = jobs(third)
    assert again["2"]["status"] == "active" and again["2"]["removed_at"] is None
    assert again["2"]["job_id"] == found["2"]["job_id"]
    assert third.versions.count() == 3


def test_markup_only_change_is_cosmetic(spark):
    first = run(spark, empty_registry(spark), [item("a", "r1", 0, 0, "Cook", "1", html="<p>Good food</p>")], [("a", "r1", 0)])
    second = run(spark, first, [item("a", "r2", 1, 0, "Cook", "1", html="<div>Good <b>food</b></div>")], [("a", "r2", 1)])
    assert [r["is_material"] for r in second.versions.collect()] == [False, False]


def test_failed_run_removes_nothing_and_redacts(spark):
    first = run(spark, empty_registry(spark), [item("a", "r1", 0, 0, "Cook", "1")], [("a", "r1", 0)])
    second = run(spark, first, [item("a", "r2", 1, 0, "Pilot", "2")], [("a", "r2", 1)], failed=["r2"])
    assert {k: j["status"] for k, j in jobs(second).items()} == {"1": "active"}
    row = second.runs.where("run_id = 'r2'").first()
    assert (row["status"], row["error_message"]) == ("failed", "GET https://x/?token=[redacted] failed")


def test_job_lives_while_one_source_lists_it(spark):
    first = run(
        spark, empty_registry(spark),
        [item("a", "r1", 0, 0, "Cook", "1"), item("b", "r2", 0, 0, "Cook", "1")], [("a", "r1", 0), ("b", "r2", 0)],
    )
    second = run(spark, first, [item("b", "r4", 1, 0, "Other", "9")], [("a", "r3", 1)])
    assert jobs(second)["1"]["status"] == "active"
    assert sorted(r["is_active"] for r in second.links.collect()) == [False, True]


def test_same_ats_id_is_one_job_and_a_batch_repeats_without_effect(spark):
    items = [item("a", "r1", 0, 0, "Cook", "1"), item("a", "r1", 0, 1, "Head Cook", "1")]
    first = run(spark, empty_registry(spark), items, [("a", "r1", 0)])
    assert first.jobs.count() == 1 and jobs(first)["1"]["title"] == "Head Cook"
    again = run(spark, first, items[1:], [("a", "r1b", 0)])
    assert again.versions.count() == first.versions.count()


def test_duplicates_and_reposts(spark):
    from tidepost.functions.similarity import MatchRule

    stored = run(
        spark, empty_registry(spark),
        [item("a", "r1", 0, 0, "Software Engineer", "1"), item("b", "r2", 0, 0, "Data Analyst", "2")],
        [("a", "r1", 0), ("b", "r2", 0)],
    )
    stored = run(spark, stored, [item("a", "r3", 1, 0, "Software Engineer", "1")], [("a", "r3", 1), ("b", "r4", 1)])
    after = run(
        spark, stored,
        [item("c", "r5", 2, 0, "Software Engineer II", "7", ats="ashby"), item("c", "r5", 2, 1, "Data Analyst", "8", ats="ashby")],
        [("c", "r5", 2)], rule=MatchRule(),
    )
    found = jobs(after)
    pair = after.candidates.first()
    assert after.candidates.count() == 1
    assert (pair["job_id"], pair["candidate_job_id"]) == (found["7"]["job_id"], found["1"]["job_id"])
    assert found["8"]["reposted_from_job_id"] == found["2"]["job_id"]


def test_survivors_of_chains_circles_and_gaps(spark):
    rows = [
        ("u", "a", "merged", "b"), ("u", "b", "merged", "c"), ("u", "c", "active", None),
        ("u", "x", "merged", "y"), ("u", "y", "merged", "x"), ("u", "lost", "merged", "nowhere"),
        ("u", "open", "merged", None), ("v", "a2", "merged", "c"),
    ]
    frame = spark.createDataFrame(rows, "user_id string, job_id string, status string, merged_into_job_id string")
    found = {r["job_id"]: r["survivor_id"] for r in survivors(frame).collect()}
    assert found == {"a": "c", "b": "c", "x": None, "y": None, "lost": None, "open": None, "a2": None}


@pytest.mark.parametrize(
    "url, body, failed",
    [
        ("https://jobs.ashbyhq.com/x", '{"jobs": []}', None),
        ("https://jobs.ashbyhq.com/x", '{"jobs": {}}', "CollectorError"),
        ("https://jobs.lever.co/x", "not json", "CollectorError"),
        ("https://jobs.lever.co/", "[]", "CollectorError"),
        ("https://boards.greenhouse.io/x", '{"jobs": [{"id": 3, "title": "T", "absolute_url": "https://e/3"}, 7, {"id": 4}]}', None),
        ("https://example.com/p", "<p>none</p>", "CollectorError"),
        ("https://example.com/p", '<script type="application/ld+json">[[[[[[[[[[[{"@type": "JobPosting", "title": "Deep"}]]]]]]]]]]]</script>', None),
    ],
)
def test_adapter_outcomes(spark, url, body, failed):
    landed = spark.createDataFrame([("u", "s", "Src", url, "auto", "r", START, 0, 200, body)], LANDED)
    found = collect(landed)
    kinds = [r["error_type"] for r in found.failures.collect()]
    assert kinds == ([failed] if failed else [])
    if "Deep" in body:
        assert [r["title"] for r in found.postings.collect()] == ["Deep"]
    if '"id": 3' in body:
        assert [r["external_job_id"] for r in found.postings.collect()] == ["3"]
        assert sorted(r["reject_reason"] for r in found.rejects.collect()) == ["no application URL", "not an object"]


def test_new_checkpoint_goes_on_from_the_newest_version(spark, tmp_path):
    from tidepost.operators.state import committed
    from tidepost.streaming.collection import collect_continuously, landed_stream, newest_registry

    def land(source):
        body = '{"jobs": [{"id": "%s", "title": "Cook", "jobUrl": "https://e.example.com/%s", "applyUrl": "https://e.example.com/%s"}]}' % ((source,) * 3)
        row = ("u", source, "Src", f"https://jobs.ashbyhq.com/{source}", "auto", f"r-{source}", START, 0, 200, body)
        spark.createDataFrame([row], LANDED).coalesce(1).write.parquet(f"{tmp_path}/landed-{source}")

    def go(source, checkpoint):
        stream = landed_stream(spark, f"{tmp_path}/landed-{source}")
        collect_continuously(stream, f"{tmp_path}/state", f"{tmp_path}/{checkpoint}", rule=None).awaitTermination()
        return newest_registry(spark, f"{tmp_path}/state")

    land("a")
    land("b")
    assert go("a", "one").jobs.count() == 1
    after = go("b", "two")
    assert after.jobs.count() == after.jobs.select("job_id").distinct().count() == 2
    go("b", "two")
    marks = committed(spark, f"{tmp_path}/state")
    assert marks.count() == 2 and marks.select("stream").distinct().count() == 2


def test_a_run_in_two_micro_batches_takes_effect_as_a_whole(spark, tmp_path):
    from tidepost.sources.landed import LANDED_PARTS
    from tidepost.streaming.collection import collect_continuously, landed_stream, newest_registry

    def land(run_id, day, part, pages, *keys):
        found = ", ".join('{"id": "%s", "title": "Cook %s", "jobUrl": "https://e.example.com/%s"}' % ((k,) * 3) for k in keys)
        row = (
            "u", "s", "Src", "https://jobs.ashbyhq.com/s", "auto", run_id, START + timedelta(days=day), part, 200,
            '{"jobs": [%s]}' % found, pages,
        )
        spark.createDataFrame([row], LANDED_PARTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        stream = landed_stream(spark, f"{tmp_path}/landed")
        collect_continuously(stream, f"{tmp_path}/state", f"{tmp_path}/progress", rule=None).awaitTermination()
        after = newest_registry(spark, f"{tmp_path}/state")
        runs = {r["run_id"]: (r["status"], r["jobs_found"]) for r in after.runs.collect()}
        return {k: j["status"] for k, j in jobs(after).items()}, runs

    both = {"1": "active", "2": "active"}
    assert land("r1", 0, 0, None, "1", "2") == (both, {"r1": ("success", 2)})
    assert land("r2", 1, 0, 2, "1") == (both, {"r1": ("success", 2)})
    assert land("r2", 1, 1, 2, "2") == (both, {"r1": ("success", 2), "r2": ("success", 2)})
    gone = {"1": "removed", "2": "active"}
    assert land("r3", 2, 0, 1, "2") == (gone, {"r1": ("success", 2), "r2": ("success", 2), "r3": ("success", 1)})


def test_missing_pages_are_noticed_and_such_a_run_removes_nothing(spark):
    from tidepost.operators.sweep import sweeping_runs
    from tidepost.sources.adapters import with_completeness

    item_of = '{"id": "%s", "text": "Cook", "hostedUrl": "https://jobs.lever.co/x/%s"}'
    full = "[" + ", ".join(item_of % (k, k) for k in range(100)) + "]"

    def page(run_id, skip, body):
        return ("u", "s", "Src", "https://jobs.lever.co/x", "auto", run_id, START, skip, 200, body)

    landed = spark.createDataFrame(
        [
            page("whole", 0, full), page("whole", 100, "[]"), page("gap", 0, full), page("gap", 200, "[]"),
            page("open", 0, full), page("short", 0, "[" + item_of % (1, 1) + "]"),
        ],
        LANDED,
    )
    runs = spark.createDataFrame([(r, "success") for r in ("whole", "gap", "open", "short", "other")], "run_id string, status string")
    marked = with_completeness(runs, collect(landed).pages)
    found = {r["run_id"]: r["complete"] for r in marked.collect()}
    assert found == {"whole": True, "gap": False, "open": False, "short": True, "other": None}
    assert {r["run_id"] for r in sweeping_runs(marked).collect()} == {"whole", "short", "other"}


def test_a_late_run_changes_neither_content_nor_times(spark):
    first = run(spark, empty_registry(spark), [item("a", "r1", 1, 0, "Cook", "1", 10)], [("a", "r1", 1)])
    second = run(spark, first, [item("a", "r3", 3, 0, "Cook", "1", 30)], [("a", "r3", 3)])
    late = run(spark, second, [item("a", "r2", 2, 0, "Cook", "1", 20), item("a", "r2", 2, 1, "Pilot", "2")], [("a", "r2", 2)])
    found = jobs(late)
    assert found["1"]["compensation_min"] == 30 and found["1"]["last_seen_at"] == START + timedelta(days=3)
    assert found["1"]["first_seen_at"] == START + timedelta(days=1)
    # The newer run did not see it.
    assert found["2"]["status"] == "removed" and found["2"]["removed_at"] == START + timedelta(days=3)
    assert {r["run_id"]: r["jobs_updated"] for r in late.runs.collect()} == {"r1": 0, "r2": 0, "r3": 1}
    assert late.versions.where(F.col("job_id") == found["1"]["job_id"]).count() == 3


def test_source_health_follows_the_runs_in_order_of_time(spark):
    from tidepost.operators.state import SCHEMAS

    blank = empty_registry(spark)
    names = [f.name for f in blank.sources.schema]
    row = {"user_id": "u", "name": "S", "last_error": "old"}
    made = [tuple({**row, "source_id": s}.get(n) for n in names) for s in ("a", "idle")]
    registry = blank.changed(sources=spark.createDataFrame(made, SCHEMAS["sources"]))

    def health(registry):
        rows = {r["source_id"]: r for r in registry.sources.collect()}
        assert (rows["idle"]["last_error"], rows["idle"]["last_attempt_at"]) == ("old", None)
        r = rows["a"]
        return r["last_error"], r["last_attempt_at"], r["last_success_at"], r["last_job_count"], r["consecutive_failures"]

    day = lambda n: START + timedelta(days=n)
    end = lambda n: day(n) + timedelta(minutes=1)
    error = "CollectorError: GET https://x/?token=[redacted] failed"
    after = run(spark, registry, [item("a", "r1", 1, 0, "Cook", "1")], [("a", "r1", 1)])
    assert health(after) == (None, day(1), end(1), 1, 0)
    after = run(spark, after, [], [("a", "r2", 2), ("a", "r3", 3)], failed=["r2", "r3"])
    assert health(after) == (error, day(3), end(1), 1, 2)
    # A failure that arrives after a newer success is history.
    after = run(spark, after, [item("a", "r5", 5, 0, "Cook", "1")], [("a", "r5", 5)])
    after = run(spark, after, [], [("a", "r4", 4)], failed=["r4"])
    assert health(after) == (None, day(5), end(5), 1, 0)


def test_pages_behind_a_short_one_do_not_count(spark):
    from tidepost.sources.adapters import counted_pages

    item_of = '{"id": "%s", "text": "Cook", "hostedUrl": "https://jobs.lever.co/x/%s"}'
    full = "[" + ", ".join(item_of % (k, k) for k in range(100)) + "]"

    def page(url, run_id, skip, *keys):
        body = full if keys == ("full",) else "[" + ", ".join(item_of % (k, k) for k in keys) + "]"
        return ("u", "s", "Src", url, "auto", run_id, START, skip, 200, body)

    lever = "https://jobs.lever.co/x"
    landed = spark.createDataFrame(
        [page(lever, "r", 0, "full"), page(lever, "r", 100, "a", "b"), page(lever, "r", 200, "late"), page(lever, "q", 0, "full"), page(lever, "q", 100, "full")],
        LANDED,
    )
    found = collect(landed)
    kept = counted_pages(found.postings, found.pages).groupBy("run_id").agg(F.count("*").alias("n"), F.max("skip").alias("skip")).collect()
    assert {r.run_id: (r.n, r.skip) for r in kept} == {"r": (102, 100), "q": (200, 100)}


def test_the_text_of_the_html_is_found_once_and_hashed_alike(spark):
    from tidepost.operators.upsert import keyed

    body = '{"jobs": [{"id": "1", "title": "T", "jobUrl": "https://e/1", "descriptionHtml": "<p>Good &amp; <b>hot</b> food</p>"}]}'
    landed = spark.createDataFrame([("u", "s", "Src", "https://jobs.ashbyhq.com/x", "auto", "r", START, 0, 200, body)], LANDED)
    postings = collect(landed).postings
    carried, parsed = (keyed(p).select("material_hash", "content_hash").first() for p in (postings, postings.drop("description_plain")))
    assert carried == parsed
