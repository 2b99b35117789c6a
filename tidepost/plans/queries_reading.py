"""Queries: listing, lookups, dashboard, health, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.operators import dashboard as board
from tidepost.operators import decisions, health, listing, versions
from tidepost.operators.listing import JobFilter
from tidepost.plans.book import query
from tidepost.plans.views import sql, table, view
from tidepost.functions.hashing import (
    MATERIAL_FIELDS,
    SNAPSHOT_FIELDS,
    content_hash,
    stable_hash,
    with_material_hash,
)

LISTED = (
    "job_id, company_name, title, location, application_url, ats_type, CAST(NULL AS TIMESTAMP) AS published_at, "
    "first_seen_at, last_seen_at, status, reposted_from_job_id, user_decision"
)
ALL_JOBS = "WITH all_jobs AS MATERIALIZED (SELECT * FROM d1_jobs)"
SHOWN = "status <> 'merged' AND (user_decision IS NULL OR user_decision NOT IN ('irrelevant', 'archived'))"


def jobs(spark, folder):
    return view(spark, folder, "d1_jobs").drop("company_name")


def companies(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name")
    )


def links(spark, folder):
    return view(spark, folder, "d3_job_sources")


RUNS = """
SELECT source_id % 10 AS user_id, source_id, CAST(source_id AS STRING) || '/' || CAST(run_day AS STRING) AS run_id,
 run_day, started_at, completed_at, jobs_found, status,
 CASE WHEN status = 'failed' THEN 'CollectorError' END AS error_type,
 CASE WHEN status = 'failed' THEN 'HTTP 503' END AS error_message FROM ({d5_runs}) r
"""
TASKS = """
SELECT user_id, run_id AS task_id, started_at AS created_at,
 CASE WHEN status = 'failed' THEN 'queued' WHEN jobs_found % 2 = 0 THEN 'running' ELSE 'done' END AS status
FROM ({runs}) t
"""


def _runs_text():
    from tidepost.plans.views import VIEWS

    return RUNS.replace("{d5_runs}", VIEWS["d5_runs"])


def runs(spark, folder):
    return sql(spark, folder, _runs_text())


def tasks(spark, folder):
    return sql(spark, folder, TASKS.replace("{runs}", _runs_text()))


RUNS_SQL = f"runs AS ({_runs_text()})"
TASKS_SQL = f"tasks AS ({TASKS.replace('{runs}', _runs_text())})"

# Content of a version: all its values; material: all but the cosmetic one.
CONTENT = """'{"cosmetic":"' || CAST(CAST(cosmetic * 100 AS INT) AS STRING) || '","pay":"'
 || CAST(CAST(floor(compensation_min) AS INT) AS STRING) || '","remote":"' || remote_type
 || '","type":"' || employment_type || '"}'"""
MATERIAL = """'{"pay":"' || CAST(CAST(floor(compensation_min) AS INT) AS STRING) || '","remote":"'
 || remote_type || '","type":"' || employment_type || '"}'"""
ORDER = ["seen_at", "tie_no", "tie_part"]


# What a sighting says, in the fields that its hashes are made of; all but the cosmetic one are material.
MATERIAL_COLUMNS = ("pay", "remote", "type")
CONTENT_COLUMNS = ("cosmetic", *MATERIAL_COLUMNS)


def sightings(spark, folder):
    rows = view(spark, folder, "d4_versions")
    return rows.select(
        "job_id",
        *ORDER,
        F.round(F.col("cosmetic") * 100).cast("int").alias("cosmetic"),
        F.floor("compensation_min").alias("pay"),
        F.col("remote_type").alias("remote"),
        F.col("employment_type").alias("type"),
    )


def hashes(prefix: str = ""):
    """Content and material hash of a sighting's fields."""
    fields = {name: F.col(prefix + name).cast("string") for name in CONTENT_COLUMNS}
    material = {name: fields[name] for name in MATERIAL_COLUMNS}
    return stable_hash(**fields), stable_hash(**material)


SIGHTINGS_SQL = f"""sightings AS (SELECT job_id, seen_at, tie_no, tie_part,
 sha256({CONTENT.replace("CAST(cosmetic * 100 AS INT)", "CAST(round(cosmetic * 100) AS INT)")}) AS content_hash,
 sha256({MATERIAL}) AS material_hash FROM d4_versions),
steps AS (SELECT *, lag(content_hash) OVER w AS previous_content, lag(material_hash) OVER w AS previous_material
 FROM sightings WINDOW w AS (PARTITION BY job_id ORDER BY seen_at, tie_no, tie_part)),
history AS (SELECT job_id, content_hash, seen_at, material_hash,
  previous_content IS NOT NULL AND previous_material <> material_hash AS is_material
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id, content_hash ORDER BY seen_at, tie_no, tie_part) AS rn FROM steps)
 WHERE rn = 1)"""


def history(spark, folder):
    rows = versions.version_history(sightings(spark, folder), ORDER, CONTENT_COLUMNS, MATERIAL_COLUMNS)
    content, material = hashes()
    return rows.select("job_id", content.alias("content_hash"), "seen_at", material.alias("material_hash"), "is_material")


@query("J1_jobs_with_company", "SELECT j.*, c_name AS company_name FROM (SELECT * EXCLUDE (company_name) FROM d1_jobs) j JOIN customer ON c_custkey = company_id")
def _(spark, folder):
    return listing.with_company(jobs(spark, folder), companies(spark, folder))


@query(
    "J2_jobs_in_source",
    "SELECT job_id, title, status FROM d1_jobs WHERE job_id IN (SELECT job_id FROM d3_job_sources WHERE source_id = 7)",
)
def _(spark, folder):
    return listing.in_source(jobs(spark, folder), links(spark, folder), 7).select("job_id", "title", "status")


@query(
    "J3_job_lineage",
    """SELECT job_id, l.source_id, name AS source_name, category AS source_category, first_seen_at, last_seen_at, is_active
    FROM d3_job_sources l JOIN d2_sources s ON s.source_id = l.source_id""",
)
def _(spark, folder):
    return listing.lineage(links(spark, folder), view(spark, folder, "d2_sources")).select(
        "job_id", "source_id", "source_name", "source_category", "first_seen_at", "last_seen_at", "is_active"
    )


@query("P1_text_search", f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE {SHOWN} AND title ILIKE '%D _I%' AND location ILIKE '%tion_1%'")
def _(spark, folder):
    wanted = JobFilter(title="D _I", location="tion_1")
    return listing.listed(listing.matching_jobs(jobs(spark, folder), companies(spark, folder), None, wanted))


@query("P2_equality_filters", f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE {SHOWN} AND status = 'removed' AND ats_type LIKE 'E%'")
def _(spark, folder):
    found = listing.matching_jobs(
        jobs(spark, folder), companies(spark, folder), None, JobFilter(status="removed")
    )
    return listing.listed(found).where("ats_type LIKE 'E%'")


@query(
    "P3_time_range",
    f"""{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE {SHOWN} AND first_seen_at >= TIMESTAMP '1997-03-01 00:00:00'
    AND first_seen_at <= TIMESTAMP '1998-02-28 23:59:59.999999'""",
)
def _(spark, folder):
    wanted = JobFilter(date_from="1997-03-01", date_to="1998-02-28")
    return listing.listed(listing.matching_jobs(jobs(spark, folder), companies(spark, folder), None, wanted))


@query("P4_decision_default", f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE {SHOWN}")
def _(spark, folder):
    return listing.listed(listing.matching_jobs(jobs(spark, folder), companies(spark, folder), None, JobFilter()))


@query("P4_decision_asked", f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE status <> 'merged' AND user_decision IN ('archived', 'watch')")
def _(spark, folder):
    wanted = JobFilter(decision=("archived", "watch"))
    return listing.listed(listing.matching_jobs(jobs(spark, folder), companies(spark, folder), None, wanted))


@query("P9_point_lookup", "SELECT job_id, user_id, title, status FROM d1_jobs WHERE job_id = 77 AND user_id = (SELECT o_custkey % 10 FROM orders WHERE o_orderkey = 77)")
def _(spark, folder):
    all_jobs = jobs(spark, folder)
    owner = all_jobs.where("job_id = 77").select("user_id").first()[0]
    return listing.owned(all_jobs, "job_id", 77, owner).select("job_id", "user_id", "title", "status")


@query("A17_rows_of_user", "SELECT job_id, title, status, first_seen_at FROM d1_jobs WHERE user_id = 3")
def _(spark, folder):
    return listing.of_user(jobs(spark, folder), 3).select("job_id", "title", "status", "first_seen_at")


@query(
    "F14_date_bounds",
    """SELECT job_id, first_seen_at FROM d1_jobs WHERE first_seen_at >= TIMESTAMP '1996-01-31 22:30:00'
    AND first_seen_at <= TIMESTAMP '1996-06-02 11:59:59.999999'""",
)
def _(spark, folder):
    wanted = JobFilter(date_from="1996-02-01T00:30:00+02:00", date_to="1996-06-01T12:00")
    return jobs(spark, folder).where(listing.time_filters(wanted)).select("job_id", "first_seen_at")


@query("F20_list_rows", f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs")
def _(spark, folder):
    return listing.listed(listing.with_company(jobs(spark, folder), companies(spark, folder)))


@query(
    "T1_newest_jobs",
    f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE {SHOWN} ORDER BY first_seen_at DESC, job_id LIMIT 50 OFFSET 25",
)
def _(spark, folder):
    return listing.list_jobs(jobs(spark, folder), companies(spark, folder), limit=50, offset=25)


@query("T7_recent_jobs", f"{ALL_JOBS} SELECT {LISTED} FROM all_jobs WHERE {SHOWN} ORDER BY first_seen_at DESC, job_id LIMIT 6")
def _(spark, folder):
    return listing.recent_jobs(jobs(spark, folder), companies(spark, folder))


@query(
    "T7_failing_sources",
    "SELECT source_id, name, priority, last_error FROM d2_sources WHERE last_error <> '' ORDER BY priority, name, source_id LIMIT 5",
)
def _(spark, folder):
    return listing.failing_sources(view(spark, folder, "d2_sources")).select(
        "source_id", "name", "priority", "last_error"
    )


SINCE = "TIMESTAMP '1998-05-31 00:00:00'"


@query(
    "G1_dashboard",
    f"""WITH {SIGHTINGS_SQL}, {RUNS_SQL}, {TASKS_SQL},
    s AS (SELECT user_id, count(*) AS sources_total, count(*) FILTER (enabled) AS sources_enabled, count(last_error) AS sources_failing
     FROM d2_sources GROUP BY user_id),
    j AS (SELECT user_id, count(*) FILTER (status <> 'merged') AS jobs_total,
     count(*) FILTER (status <> 'merged' AND first_seen_at >= {SINCE}) AS jobs_seen_last_24h,
     count(*) FILTER (status <> 'merged' AND first_seen_at >= {SINCE}) AS jobs_new_last_24h,
     count(*) FILTER (status = 'removed' AND removed_at >= {SINCE}) AS jobs_removed_last_24h,
     count(*) FILTER (status <> 'merged' AND first_seen_at >= {SINCE} AND reposted_from_job_id IS NOT NULL) AS jobs_reposted_last_24h
     FROM d1_jobs GROUP BY user_id),
    v AS (SELECT user_id, count(DISTINCT h.job_id) AS jobs_changed_last_24h FROM history h JOIN d1_jobs USING (job_id)
     WHERE is_material AND h.seen_at >= {SINCE} AND status <> 'merged' GROUP BY user_id),
    t AS (SELECT user_id, count(*) FILTER (status = 'queued') AS queued_tasks, count(*) FILTER (status = 'running') AS running_tasks
     FROM tasks GROUP BY user_id)
    SELECT user_id, coalesce(sources_total, 0) AS sources_total, coalesce(sources_enabled, 0) AS sources_enabled,
     coalesce(sources_failing, 0) AS sources_failing, coalesce(jobs_total, 0) AS jobs_total,
     coalesce(jobs_seen_last_24h, 0) AS jobs_seen_last_24h, coalesce(jobs_new_last_24h, 0) AS jobs_new_last_24h,
     coalesce(jobs_removed_last_24h, 0) AS jobs_removed_last_24h, coalesce(jobs_reposted_last_24h, 0) AS jobs_reposted_last_24h,
     coalesce(jobs_changed_last_24h, 0) AS jobs_changed_last_24h,
     coalesce(queued_tasks, 0) AS queued_tasks, coalesce(running_tasks, 0) AS running_tasks
    FROM s FULL JOIN j USING (user_id) FULL JOIN v USING (user_id) FULL JOIN t USING (user_id)""",
)
def _(spark, folder):
    as_of = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return board.dashboard(
        view(spark, folder, "d2_sources"),
        jobs(spark, folder),
        history(spark, folder),
        tasks(spark, folder),
        as_of,
    )


@query(
    "J13_changed_jobs",
    f"""WITH {SIGHTINGS_SQL} SELECT DISTINCT job_id, user_id, status FROM history h JOIN d1_jobs USING (job_id)
    WHERE is_material AND h.seen_at >= {SINCE} AND status <> 'merged'""",
)
def _(spark, folder):
    since = F.lit("1998-05-31 00:00:00").cast("timestamp_ntz")
    return board.changed_jobs(history(spark, folder), jobs(spark, folder), since).select(
        "job_id", "user_id", "status"
    )


@query(
    "G2_changed_job_count",
    f"""WITH {SIGHTINGS_SQL} SELECT user_id, count(DISTINCT job_id) AS jobs_changed FROM history h JOIN d1_jobs USING (job_id)
    WHERE is_material AND h.seen_at >= {SINCE} AND status <> 'merged' GROUP BY user_id""",
)
def _(spark, folder):
    since = F.lit("1998-05-31 00:00:00").cast("timestamp_ntz")
    changed = board.changed_jobs(history(spark, folder), jobs(spark, folder), since)
    return changed.groupBy("user_id").agg(F.count(F.lit(1)).alias("jobs_changed"))


# A snapshot whose fields follow from the version rows; the others are null.
SNAPSHOT = {
    "ats_type": "CAST(CAST(round(cosmetic * 100) AS INT) AS STRING)",
    "compensation_min": "CAST(CAST(floor(compensation_min) AS INT) AS STRING)",
    "description_text": "'Work  as ' || employment_type",
    "employment_type": "employment_type",
    "remote_type": "remote_type",
    "title": "'Job ' || CAST(job_id AS STRING)",
}


def _json_sql(fields) -> str:
    given = SNAPSHOT | {"description": "'Work as ' || employment_type"}
    parts = [f"'\"{f}\":' || " + (f"'\"' || {given[f]} || '\"'" if f in given else "'null'") for f in sorted(fields)]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def snapshots(spark, folder):
    fields = [F.expr(SNAPSHOT.get(f, "CAST(NULL AS STRING)")).alias(f) for f in SNAPSHOT_FIELDS]
    return view(spark, folder, "d4_versions").select("job_id", *ORDER, F.struct(*fields).alias("snapshot"))


@query(
    "F8_content_hash",
    f"SELECT job_id, seen_at, tie_no, tie_part, sha256({_json_sql(SNAPSHOT_FIELDS)}) AS content_hash FROM d4_versions",
)
def _(spark, folder):
    hashed = content_hash(F.col("snapshot")).alias("content_hash")
    return snapshots(spark, folder).select("job_id", *ORDER, hashed)


@query(
    "F9_material_hash",
    f"SELECT job_id, seen_at, tie_no, tie_part, sha256({_json_sql((*MATERIAL_FIELDS, 'description'))}) AS material_hash FROM d4_versions",
)
def _(spark, folder):
    hashed = with_material_hash(snapshots(spark, folder), "snapshot", "material_hash")
    return hashed.select("job_id", *ORDER, "material_hash")


@query(
    "W4_change_vs_previous",
    f"""WITH {SIGHTINGS_SQL} SELECT job_id, seen_at, tie_no, tie_part, previous_content, previous_material FROM steps""",
)
def _(spark, folder):
    rows = versions.with_previous(sightings(spark, folder), ORDER, CONTENT_COLUMNS)
    content, material = (F.when(F.col("follows"), h) for h in hashes("previous_"))
    return rows.select("job_id", *ORDER, content.alias("previous_content"), material.alias("previous_material"))


@query("M3_version_history", f"WITH {SIGHTINGS_SQL} SELECT * FROM history")
def _(spark, folder):
    return history(spark, folder)


@query(
    "J11_previous_version",
    f"""WITH {SIGHTINGS_SQL}, now AS (SELECT job_id, content_hash FROM (SELECT *, row_number() OVER
     (PARTITION BY job_id ORDER BY seen_at DESC, tie_no DESC, tie_part DESC) AS rn FROM sightings) WHERE rn = 1)
    SELECT n.job_id, n.content_hash, h.seen_at AS version_seen_at, h.is_material FROM now n LEFT JOIN history h USING (job_id, content_hash)""",
)
def _(spark, folder):
    rows = sightings(spark, folder)
    last = F.max_by(F.struct(*CONTENT_COLUMNS), F.struct(*ORDER)).alias("last")
    current = rows.groupBy("job_id").agg(last).select("job_id", "last.*")
    stored = versions.version_history(rows, ORDER, CONTENT_COLUMNS, MATERIAL_COLUMNS)
    found = versions.previous_version(current, stored, CONTENT_COLUMNS)
    return found.select("job_id", hashes()[0].alias("content_hash"), "version_seen_at", "is_material")


@query("W5_latest_runs", f"""WITH {RUNS_SQL} SELECT * FROM (SELECT source_id, run_id, started_at, status, jobs_found,
    row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rank FROM runs) WHERE rank <= 5""")
def _(spark, folder):
    return health.latest_runs(runs(spark, folder), 5).select(
        "source_id", "run_id", "started_at", "status", "jobs_found", "rank"
    )


@query("W6_latest_run", f"""WITH {RUNS_SQL} SELECT * EXCLUDE (rn) FROM (SELECT source_id, run_id, started_at, status, jobs_found,
    row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1""")
def _(spark, folder):
    return health.latest_run(runs(spark, folder)).select("source_id", "run_id", "started_at", "status", "jobs_found")


@query(
    "F17_run_history",
    f"""WITH {RUNS_SQL}, timed AS (SELECT *, greatest(CAST(floor(date_diff('millisecond', started_at, completed_at) / 1000.0 + 0.5) AS BIGINT), 0) AS s FROM runs)
    SELECT run_id, CASE WHEN s < 60 THEN CAST(s AS STRING) || 's' ELSE CAST(s // 60 AS STRING) || 'm ' || CAST(s % 60 AS STRING) || 's' END AS duration,
     CASE WHEN status = 'failed' THEN 'Failed' WHEN jobs_found = 0 THEN 'Success · 0 jobs' ELSE 'Success' END AS label FROM timed""",
)
def _(spark, folder):
    return health.run_history(runs(spark, folder)).select("run_id", "duration", "label")


@query(
    "G6_consecutive_failures",
    f"""WITH {RUNS_SQL}, last AS (SELECT source_id, max(started_at) AS ok FROM runs WHERE status = 'success' GROUP BY source_id),
    c AS (SELECT r.source_id, count(*) FILTER (status = 'failed' AND (ok IS NULL OR started_at > ok)) AS consecutive_failures
     FROM runs r LEFT JOIN last USING (source_id) GROUP BY r.source_id)
    SELECT source_id, consecutive_failures, consecutive_failures >= 2 AS alert FROM c""",
)
def _(spark, folder):
    return health.consecutive_failures(runs(spark, folder))


@query(
    "G7_source_health",
    f"""WITH {RUNS_SQL} SELECT source_id, max(started_at) AS last_attempt_at, max(completed_at) FILTER (status = 'success') AS last_success_at,
     arg_max(jobs_found, completed_at) FILTER (status = 'success') AS last_job_count,
     CASE WHEN arg_max(status, completed_at) = 'failed' THEN 'CollectorError: HTTP 503' END AS last_error FROM runs GROUP BY source_id""",
)
def _(spark, folder):
    out = health.source_health(runs(spark, folder))
    return out.withColumn("last_error", F.nullif("last_error", F.lit("")))


@query("T5_latest_tasks", f"WITH {RUNS_SQL}, {TASKS_SQL} SELECT * FROM tasks ORDER BY created_at DESC, task_id LIMIT 200")
def _(spark, folder):
    return health.latest_tasks(tasks(spark, folder))


@query(
    "F18_source_state",
    "SELECT source_id, CASE WHEN last_error <> '' THEN 'failed' WHEN enabled THEN 'enabled' ELSE 'disabled' END AS state FROM d2_sources",
)
def _(spark, folder):
    return health.with_state(view(spark, folder, "d2_sources")).select("source_id", "state")


@query(
    "G8_job_detail",
    f"""WITH {SIGHTINGS_SQL}
    SELECT job_id, 'job' AS kind, 0 AS n, title, company_name, status, NULL AS source_id, NULL AS source_name, NULL AS source_category,
     NULL AS is_active, NULL AS first_day, NULL AS last_day, NULL AS seen_day, NULL AS is_material, NULL AS content_hash FROM d1_jobs
    UNION ALL SELECT job_id, 'source', row_number() OVER (PARTITION BY job_id ORDER BY first_seen_at, l.source_id), NULL, NULL, NULL, l.source_id, name, category,
     is_active, strftime(first_seen_at, '%Y-%m-%d'), strftime(last_seen_at, '%Y-%m-%d'), NULL, NULL, NULL
    FROM d3_job_sources l JOIN d2_sources d ON d.source_id = l.source_id WHERE job_id IN (SELECT job_id FROM d1_jobs)
    UNION ALL SELECT job_id, 'version', row_number() OVER (PARTITION BY job_id ORDER BY seen_at DESC, content_hash), NULL, NULL, NULL, NULL, NULL, NULL,
     NULL, NULL, NULL, strftime(seen_at, '%Y-%m-%d'), is_material, content_hash FROM history WHERE job_id IN (SELECT job_id FROM d1_jobs)""",
)
def _(spark, folder):
    detail = listing.job_detail(
        jobs(spark, folder), companies(spark, folder), links(spark, folder),
        view(spark, folder, "d2_sources"), history(spark, folder),
    )
    day = lambda column: F.date_format(column, "yyyy-MM-dd")
    return detail.select(
        "job_id", "kind", "n", "title", "company_name", "status", "source_id", "source_name", "source_category", "is_active",
        day("first_seen_at").alias("first_day"), day("last_seen_at").alias("last_day"), day("seen_at").alias("seen_day"),
        "is_material", "content_hash",
    )


DECISION_LOG = """
SELECT e.event_id AS decision_id, o_custkey % 10 AS user_id, o_orderkey AS job_id, e.ts AS decided_at,
 CASE e.event_type WHEN 'purchase' THEN 'applied' WHEN 'view' THEN 'watch' WHEN 'click' THEN 'archived'
  WHEN 'error' THEN 'irrelevant' END AS decision
FROM events e JOIN orders ON o_orderkey = CAST(floor(e.event_id / 10.0) AS BIGINT)
"""


def decision_log(spark, folder):
    return sql(spark, folder, DECISION_LOG)


@query(
    "M12_decided_jobs",
    f"""WITH log AS ({DECISION_LOG}), last AS (SELECT job_id, arg_max(struct_pack(d := decision), (decided_at, decision_id)) AS l FROM log GROUP BY job_id)
    SELECT j.job_id, j.status, CASE WHEN l IS NULL THEN user_decision ELSE l.d END AS user_decision FROM d1_jobs j LEFT JOIN last USING (job_id)""",
)
def _(spark, folder):
    decided = decisions.decided_jobs(jobs(spark, folder), decision_log(spark, folder))
    return decided.select("job_id", "status", "user_decision")


@query(
    "M12_decision_events",
    f"""WITH log AS ({DECISION_LOG}), steps AS (SELECT l.*, row_number() OVER w AS rn, lag(decision) OVER w AS before FROM log l
     WINDOW w AS (PARTITION BY job_id ORDER BY decided_at, decision_id)),
    told AS (SELECT s.*, CASE WHEN rn = 1 THEN user_decision ELSE before END AS previous FROM steps s JOIN (SELECT job_id, user_decision FROM d1_jobs) j USING (job_id))
    SELECT user_id, 'job_decision_set' AS event_type, 'job' AS entity_type, CAST(job_id AS STRING) AS entity_id,
     'Job decision set to ' || coalesce('''' || decision || '''', 'None') || ' (was ' || coalesce('''' || previous || '''', 'None') || ')' AS message,
     previous, decision, decided_at AS created_at FROM told""",
)
def _(spark, folder):
    return decisions.decision_events(jobs(spark, folder), decision_log(spark, folder))
