"""Queries: batch upsert, links, versions, sweep, run counters."""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import functions as F

from tidepost.operators import sweep as sweeping
from tidepost.operators import upsert
from tidepost.operators.health import HEALTH
from tidepost.operators.state import empty_registry, read_registry, write_changes
from tidepost.operators.tombstones import survivors
from tidepost.plans.book import query
from tidepost.plans.collect import batch_changes, collect_batch
from tidepost.plans.queries_matching import COMPOSITE, GATES, RATIOS, ratio_of
from tidepost.plans.views import sql, view
from tidepost.session import shared_folder, written

# Every sighting is one item of the run of its source and day. Items named by the posting
# number carry an ATS id, those seen by 'view' carry none, so both exact tiers take part.
ITEMS = """
SELECT CAST(e.source_id % 10 AS STRING) AS user_id, CAST(e.source_id AS STRING) AS source_id,
 CAST(e.source_id AS STRING) || '/' || CAST(e.run_day AS STRING) AS run_id, r.started_at, r.completed_at, r.status,
 e.event_id AS position, e.seen_at, k, 'Acme ' || CAST(e.source_id % 3 AS STRING) AS company_name, 'Role ' || k AS title, event_type AS location,
 'https://jobs.example.com/' || k AS application_url, CAST(floor(compensation_min) AS INT) AS pay,
 CASE WHEN event_type <> 'view' THEN 'lever' END AS ats_type
FROM (SELECT *, JSON_K AS k FROM ({d5_sightings}) s) e JOIN ({d5_runs}) r ON r.source_id = e.source_id AND r.run_day = e.run_day
"""


def _items_text(json_k: str) -> str:
    from tidepost.plans.views import VIEWS

    text = ITEMS.replace("JSON_K", json_k)
    return text.replace("{d5_sightings}", VIEWS["d5_sightings"]).replace("{d5_runs}", VIEWS["d5_runs"])


def batch(spark, folder):
    """Postings, runs and failures of the whole batch, which lands once."""
    rows = sql(spark, folder, _items_text("get_json_object(item_json, '$.k')"))
    stamp = {c: F.col(c).cast("timestamp") for c in ("started_at", "completed_at", "seen_at")}
    rows = written(rows.withColumns(stamp), "landed")
    empty = {
        c: F.lit(None).cast("string")
        for c in (
            "source_job_url", "description_text", "description_html", "department", "remote_type", "employment_type", "currency",
        )
    }
    postings = rows.withColumns(
        {
            **empty,
            "source_name": F.concat(F.lit("Source "), "source_id"),
            "compensation_min": F.col("pay"),
            "compensation_max": F.lit(None).cast("int"),
            "external_job_id": F.col("k"),
            "published_at": F.lit(None).cast("timestamp"),
            "raw_payload": F.parse_json(F.lit("{}")),
        }
    )
    runs = rows.select("user_id", "source_id", "run_id", "started_at", "completed_at", "status").distinct()
    failures = runs.where("status = 'failed'").select(
        "user_id", "source_id", "run_id", "started_at", F.lit("CollectorError").alias("error_type"),
        F.concat(F.lit("GET https://x.example.com/?token=t"), "source_id", F.lit(" failed with status 503")).alias("error_message"),
    )
    return postings, runs.drop("status"), failures


def collected(spark, folder):
    return collect_batch(empty_registry(spark), *batch(spark, folder), rule=None)


FINGERPRINT = """sha256('{"company":"acme ' || CAST(CAST(source_id AS INT) % 3 AS STRING) || '","external_id":"' || k || '","location":"' || location
 || '","title":"role ' || k || '","url":"' || application_url || '"}')"""
# Identity: the user and the posting number; without ATS id also company and place.
STEPS_SQL = f"""items AS ({_items_text("json_extract_string(item_json, '$.k')")}), good AS (SELECT *, {FINGERPRINT} AS fingerprint,
  user_id || '|' || k || '|' || CASE WHEN ats_type IS NULL THEN company_name || '|' || location ELSE '' END AS identity,
  company_name || '|' || location || '|' || CAST(pay AS STRING) AS content, location || '|' || CAST(pay AS STRING) AS material FROM items WHERE status = 'success'),
 steps AS (SELECT *, row_number() OVER w AS rn, lag(content) OVER w AS before, lag(material) OVER w AS material_before,
  row_number() OVER (PARTITION BY identity ORDER BY started_at DESC, run_id DESC, position DESC) AS back,
  sha256(user_id || '|' || first_value(fingerprint) OVER w) AS job_id, min(seen_at) OVER (PARTITION BY identity) AS first_seen_at
  FROM good WINDOW w AS (PARTITION BY identity ORDER BY started_at, run_id, position)),
 jobs AS (SELECT user_id, job_id, title, company_name, location, pay AS compensation_min, fingerprint, first_seen_at, seen_at AS last_seen_at FROM steps WHERE back = 1),
 links AS (SELECT user_id, job_id, source_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM steps GROUP BY ALL),
 runs AS (SELECT DISTINCT user_id, source_id, run_id, started_at, completed_at, status FROM items),
 ends AS (SELECT l.*, (SELECT min(r.started_at) FROM runs r WHERE r.source_id = l.source_id AND r.status = 'success' AND r.started_at > l.last_seen_at) AS removed_at FROM links l),
 gone AS (SELECT job_id, CASE WHEN bool_and(removed_at IS NOT NULL) THEN max(removed_at) END AS removed_at FROM ends GROUP BY job_id)"""


def _plain(df):
    """Times without zone, as the tables have them."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


JOBS_OUT = ("user_id", "job_id", "title", "location", "compensation_min", "fingerprint", "first_seen_at", "last_seen_at")


def _upserted(spark, folder):
    postings, runs, failures = batch(spark, folder)
    good = postings.join(failures.select("run_id"), "run_id", "left_anti")
    return upsert.apply_postings(empty_registry(spark), good)


@query("M2_job_upsert", f"WITH {STEPS_SQL} SELECT {', '.join(JOBS_OUT)}, 'active' AS status FROM jobs")
def _(spark, folder):
    return _plain(_upserted(spark, folder).registry.jobs.select(*JOBS_OUT, "status"))


@query(
    "M2_job_upsert_in_two_batches",
    f"""WITH {STEPS_SQL} SELECT {', '.join(JOBS_OUT)} FROM jobs""",
)
def _(spark, folder):
    """The second half of the month meets the registry the first half left."""
    postings, runs, failures = batch(spark, folder)
    middle = F.lit("2024-01-16").cast("timestamp")
    good = postings.join(failures.select("run_id"), "run_id", "left_anti")
    first = upsert.apply_postings(empty_registry(spark), good.where(F.col("started_at") < middle)).registry
    stored = first.changed(**{f.name: written(getattr(first, f.name), f.name) for f in fields(first)})
    second = upsert.apply_postings(stored, good.where(F.col("started_at") >= middle)).registry
    return _plain(second.jobs.select(*JOBS_OUT))


@query(
    "M1_company_upsert",
    f"WITH {STEPS_SQL} SELECT DISTINCT user_id, company_name, lower(company_name) AS normalized_name FROM good",
)
def _(spark, folder):
    return _upserted(spark, folder).registry.companies.select("user_id", "company_name", "normalized_name")


@query(
    "M3_version_append",
    f"""WITH {STEPS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY identity, content ORDER BY rn) AS nth FROM steps)
    SELECT user_id, job_id, seen_at, location, pay, before IS NOT NULL AND material <> material_before AS is_material FROM v WHERE nth = 1""",
)
def _(spark, folder):
    rows = _upserted(spark, folder).registry.versions
    return _plain(
        rows.select("user_id", "job_id", "seen_at", "snapshot.location", F.col("snapshot.compensation_min").alias("pay"), "is_material")
    )


@query("M4_link_upsert", f"WITH {STEPS_SQL} SELECT user_id, job_id, source_id, first_seen_at, last_seen_at, true AS is_active FROM links")
def _(spark, folder):
    rows = _upserted(spark, folder).registry.links
    return _plain(rows.select("user_id", "job_id", "source_id", "first_seen_at", "last_seen_at", "is_active"))


@query(
    "G9_link_sightings",
    "SELECT source_id, event_type, min(seen_at) AS first_time, max(seen_at) AS last_time FROM d5_sightings GROUP BY source_id, event_type",
)
def _(spark, folder):
    rows = view(spark, folder, "d5_sightings").withColumns(
        {
            "user_id": F.lit("1"), "job_id": F.col("event_type"), "link_url": F.lit("u"), "ord": F.col("event_id"),
        }
    )
    return upsert.link_sightings(rows).select("source_id", F.col("job_id").alias("event_type"), "first_time", "last_time")


COUNTERS = """SELECT run_id, count(*) AS jobs_found, count(*) FILTER (rn = 1) AS jobs_created, count(*) FILTER (rn > 1 AND content <> before) AS jobs_updated
 FROM steps GROUP BY run_id"""


@query("G3_run_counters", f"WITH {STEPS_SQL} {COUNTERS}")
def _(spark, folder):
    return _upserted(spark, folder).counters


@query(
    "J4_fingerprint_match",
    f"""WITH {STEPS_SQL}, early AS (SELECT DISTINCT user_id, fingerprint FROM good WHERE started_at < TIMESTAMP '2024-01-16 00:00:00'),
    late AS (SELECT DISTINCT user_id, fingerprint FROM good WHERE started_at >= TIMESTAMP '2024-01-16 00:00:00')
    SELECT l.user_id, l.fingerprint, CASE WHEN e.fingerprint IS NOT NULL THEN 'job ' || e.fingerprint END AS target FROM late l LEFT JOIN early e USING (user_id, fingerprint)""",
)
def _(spark, folder):
    stored, late = _two_sides(spark, folder)
    jobs = stored.select(
        "user_id", "fingerprint", F.concat(F.lit("job "), "fingerprint").alias("job_id"), F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("merged_into_job_id"),
    ).distinct()
    return upsert.by_fingerprint(late.select("user_id", "fingerprint").distinct(), jobs).select("user_id", "fingerprint", "target")


def _two_sides(spark, folder):
    postings, runs, failures = batch(spark, folder)
    good = upsert.keyed(postings.join(failures.select("run_id"), "run_id", "left_anti"))
    middle = F.lit("2024-01-16").cast("timestamp")
    return good.where(F.col("started_at") < middle), good.where(F.col("started_at") >= middle)


@query(
    "J5_ats_id_match",
    f"""WITH {STEPS_SQL}, stored AS (SELECT *, CASE WHEN position % 3 = 0 THEN 'removed' WHEN position % 3 = 1 THEN 'active' ELSE 'merged' END AS kind FROM good
      WHERE started_at < TIMESTAMP '2024-01-16 00:00:00' AND ats_type <> ''),
    ranked AS (SELECT user_id, k, position, row_number() OVER (PARTITION BY user_id, k ORDER BY kind <> 'active', position) AS rn FROM stored WHERE kind <> 'merged'),
    late AS (SELECT DISTINCT user_id, coalesce(ats_type, '') AS ats_key, k AS id_key FROM good WHERE started_at >= TIMESTAMP '2024-01-16 00:00:00')
    SELECT l.user_id, l.ats_key, l.id_key, r.position AS ats_hit FROM late l LEFT JOIN ranked r ON r.rn = 1 AND r.user_id = l.user_id AND r.k = l.id_key AND l.ats_key = 'lever'""",
)
def _(spark, folder):
    stored, late = _two_sides(spark, folder)
    kind = F.col("position") % 3
    jobs = stored.select(
        "user_id", F.col("position").alias("job_id"), "ats_type", "external_job_id",
        F.when(kind == 0, "removed").when(kind == 1, "active").otherwise("merged").alias("status"),
    )
    return upsert.by_ats_id(late.select("user_id", "ats_key", "id_key").distinct(), jobs)


@query(
    "M5_removal_sweep_links",
    f"WITH {STEPS_SQL} SELECT user_id, job_id, source_id, last_seen_at, removed_at IS NULL AS is_active, removed_at FROM ends",
)
def _(spark, folder):
    rows = collected(spark, folder).links
    return _plain(rows.select("user_id", "job_id", "source_id", "last_seen_at", "is_active", "removed_at"))


@query(
    "M5_removal_sweep_jobs",
    f"""WITH {STEPS_SQL} SELECT j.user_id, job_id, CASE WHEN g.removed_at IS NOT NULL THEN 'removed' ELSE 'active' END AS status, g.removed_at
    FROM jobs j JOIN gone g USING (job_id)""",
)
def _(spark, folder):
    return _plain(collected(spark, folder).jobs.select("user_id", "job_id", "status", "removed_at"))


@query(
    "M6_failure_safety",
    f"""WITH {STEPS_SQL}, c AS ({COUNTERS}) SELECT r.run_id, r.status, coalesce(jobs_found, 0) AS jobs_found, coalesce(jobs_created, 0) AS jobs_created,
     coalesce(jobs_updated, 0) AS jobs_updated, CASE WHEN r.status = 'failed' THEN 'CollectorError' END AS error_type,
     CASE WHEN r.status = 'failed' THEN 'GET https://x.example.com/?token=[redacted] failed with status 503' END AS error_message
    FROM runs r LEFT JOIN c USING (run_id)""",
)
def _(spark, folder):
    rows = collected(spark, folder).runs
    return rows.select("run_id", "status", "jobs_found", "jobs_created", "jobs_updated", "error_type", "error_message")


@query("G5_active_anywhere", "SELECT job_id, bool_or(is_active) AS is_active FROM d3_job_sources GROUP BY job_id")
def _(spark, folder):
    links = view(spark, folder, "d3_job_sources").withColumn("removed_at", F.lit(None).cast("timestamp_ntz"))
    return sweeping.active_anywhere(links).select("job_id", "is_active")


CHAIN = """WITH RECURSIVE chain AS (SELECT {user} AS user_id, job_id, merged_into_job_id AS at FROM d1_jobs WHERE status = 'merged'
 UNION ALL SELECT c.user_id, c.job_id, j.merged_into_job_id FROM chain c JOIN d1_jobs j ON j.job_id = c.at AND j.status = 'merged' AND {same})
 SELECT m.user_id, m.job_id, max(j.job_id) AS survivor_id FROM chain m LEFT JOIN d1_jobs j ON j.job_id = m.at AND j.status <> 'merged' AND {alive} GROUP BY m.user_id, m.job_id"""


@query("J9_survivors", CHAIN.format(user="user_id", same="j.user_id = c.user_id", alive="j.user_id = m.user_id"))
def _(spark, folder):
    return survivors(view(spark, folder, "d1_jobs"))


@query("J9_survivors_of_one_user", CHAIN.format(user="0", same="true", alive="true"))
def _(spark, folder):
    return survivors(view(spark, folder, "d1_jobs").withColumn("user_id", F.lit(0)))


@query(
    "M5_late_runs",
    f"""WITH {STEPS_SQL} SELECT e.user_id, e.source_id, j.title, j.location, j.compensation_min, j.first_seen_at, j.last_seen_at, e.first_seen_at AS link_first_seen_at,
     e.last_seen_at AS link_last_seen_at, e.removed_at IS NULL AS is_active, e.removed_at, CASE WHEN g.removed_at IS NOT NULL THEN 'removed' ELSE 'active' END AS status
    FROM ends e JOIN jobs j USING (job_id) JOIN gone g USING (job_id)""",
)
def _(spark, folder):
    """The first half of the month lands after the second: the registry is what it is in order."""
    postings, runs, failures = batch(spark, folder)
    late = F.col("started_at") < F.lit("2024-01-16").cast("timestamp")
    registry = empty_registry(spark)
    for part in (~late, late):
        registry = collect_batch(registry, postings.where(part), runs.where(part), failures.where(part), rule=None)
        registry = registry.changed(**{f.name: written(getattr(registry, f.name), f.name) for f in fields(registry)})
    links = registry.links.withColumnsRenamed({"first_seen_at": "link_first_seen_at", "last_seen_at": "link_last_seen_at"})
    rows = links.join(registry.jobs.drop("removed_at"), ["user_id", "job_id"])
    return _plain(
        rows.select(
            "user_id", "source_id", "title", "location", "compensation_min", "first_seen_at", "last_seen_at", "link_first_seen_at",
            "link_last_seen_at", "is_active", "removed_at", "status",
        )
    )


@query(
    "G7_sources_after_batch",
    f"""WITH {STEPS_SQL}, c AS ({COUNTERS}), ok AS (SELECT source_id, max(started_at) AS ok FROM runs WHERE status = 'success' GROUP BY source_id),
    h AS (SELECT r.source_id, max(started_at) AS last_attempt_at, max(completed_at) FILTER (status = 'success') AS last_success_at,
      arg_max(coalesce(jobs_found, 0), completed_at) FILTER (status = 'success') AS last_job_count,
      CASE WHEN arg_max(status, completed_at) = 'failed' THEN 'CollectorError: GET https://x.example.com/?token=[redacted] failed with status 503' END AS last_error,
      count(*) FILTER (status = 'failed' AND (ok IS NULL OR started_at > ok)) AS consecutive_failures
     FROM runs r LEFT JOIN c USING (run_id) LEFT JOIN ok ON ok.source_id = r.source_id GROUP BY r.source_id)
    SELECT CAST(s.user_id AS STRING) AS user_id, CAST(s.source_id AS STRING) AS source_id, last_attempt_at, last_success_at, last_job_count,
     CASE WHEN h.source_id IS NULL THEN s.last_error ELSE h.last_error END AS last_error, consecutive_failures
    FROM d2_sources s LEFT JOIN h ON h.source_id = CAST(s.source_id AS STRING)""",
)
def _(spark, folder):
    """Sources with the health of the batch; those without a run keep their error."""
    known = view(spark, folder, "d2_sources").select(
        F.col("user_id").cast("string"), F.col("source_id").cast("string"), "last_error"
    )
    registry = empty_registry(spark)
    registry = registry.changed(sources=registry.sources.unionByName(known, allowMissingColumns=True))
    rows = collect_batch(registry, *batch(spark, folder), rule=None).sources
    return _plain(rows.select("user_id", "source_id", *HEALTH))


@query(
    "M2_stored_batches",
    f"""WITH {STEPS_SQL} SELECT j.user_id, job_id, title, location, compensation_min, first_seen_at, last_seen_at,
     CASE WHEN g.removed_at IS NOT NULL THEN 'removed' ELSE 'active' END AS status, g.removed_at FROM jobs j JOIN gone g USING (job_id)""",
)
def _(spark, folder):
    """All but the last day goes to disk; that day meets what is read back and writes the buckets it touches."""
    postings, runs, failures = batch(spark, folder)
    last = F.col("started_at") >= F.lit("2024-01-30").cast("timestamp")
    where = f"{shared_folder(spark)}/tidepost/registry-{uuid.uuid4().hex}"
    registry = empty_registry(spark)
    for version, part in enumerate((~last, last), 1):
        changes = batch_changes(registry, postings.where(part), runs.where(part), failures.where(part), rule=None)
        write_changes(changes, registry, where, version)
        registry = read_registry(spark, where, version)
    return _plain(registry.jobs.select(*[c for c in JOBS_OUT if c != "fingerprint"], "status", "removed_at"))


# Each new job meets the others of its user as they are when its turn comes: their last names, and
# whether a sighting of theirs still holds, that is no later run of its source has begun since.
TURNS = f"""{STEPS_SQL}, held AS (SELECT s.job_id, s.user_id, s.started_at, s.run_id, s.position, lower(s.company_name) AS company, lower(s.title) AS title, s.location,
  min(r.started_at) AS gone_at, arg_min(r.run_id, r.started_at) AS gone_run
  FROM steps s LEFT JOIN runs r ON r.source_id = s.source_id AND r.status = 'success' AND r.started_at > s.seen_at GROUP BY ALL),
 news AS (SELECT user_id, job_id, lower(company_name) AS company, lower(title) AS title, location, started_at, run_id, position FROM steps WHERE rn = 1),
 others AS (SELECT n.job_id, h.job_id AS other, arg_max({{'c': h.company, 't': h.title, 'l': h.location}}, (h.started_at, h.run_id, h.position)) AS names,
   bool_or(h.gone_at IS NULL OR (h.gone_at, h.gone_run) >= (n.started_at, n.run_id)) AS active
  FROM news n JOIN held h ON h.user_id = n.user_id AND h.job_id <> n.job_id AND (h.started_at, h.run_id, h.position) < (n.started_at, n.run_id, n.position)
  GROUP BY n.job_id, h.job_id),
 wanted AS (SELECT DISTINCT n.company AS a, o.company AS b FROM news n, news o UNION SELECT DISTINCT n.title, o.title FROM (SELECT DISTINCT title FROM news) n, (SELECT DISTINCT title FROM news) o
  UNION SELECT DISTINCT n.location, o.location FROM (SELECT DISTINCT location FROM news) n, (SELECT DISTINCT location FROM news) o), {RATIOS},
 scored AS (SELECT o.*, {ratio_of('rc')} AS c, {ratio_of('rt')} AS t, {ratio_of('rl')} AS l FROM others o JOIN news n USING (job_id)
  LEFT JOIN ratios rc ON rc.a = n.company AND rc.b = names.c LEFT JOIN ratios rt ON rt.a = n.title AND rt.b = names.t LEFT JOIN ratios rl ON rl.a = n.location AND rl.b = names.l),
 best AS (SELECT *, {COMPOSITE} AS score, row_number() OVER (PARTITION BY job_id, active ORDER BY {COMPOSITE} DESC, other) AS nth FROM scored WHERE {GATES}),
 pairs AS (SELECT job_id, other, score FROM best WHERE active AND nth = 1),
 gone_after AS (SELECT p.job_id, h.gone_at FROM pairs p JOIN news n USING (job_id) JOIN held h ON h.job_id IN (p.job_id, p.other) AND h.gone_at IS NOT NULL AND (h.gone_at, h.gone_run) >= (n.started_at, n.run_id)
  WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.job_id = h.job_id AND (x.started_at, x.run_id) <= (h.gone_at, h.gone_run) AND (x.gone_at IS NULL OR (x.gone_at, x.gone_run) > (h.gone_at, h.gone_run))))"""


@query(
    "M8_batch_candidates",
    f"""WITH RECURSIVE {TURNS} SELECT job_id, other AS candidate_job_id, score AS similarity_score, CASE WHEN min(gone_at) IS NULL THEN 'pending' ELSE 'dismissed' END AS status,
     min(gone_at) AS resolved_at FROM pairs LEFT JOIN gone_after USING (job_id) GROUP BY job_id, other, score""",
)
def _(spark, folder):
    """A month of runs in one batch: candidates by the state at each item, and what later runs dismiss."""
    rows = collect_batch(empty_registry(spark), *batch(spark, folder)).candidates
    return _plain(rows.select("job_id", "candidate_job_id", "similarity_score", "status", "resolved_at"))


@query(
    "J8_repost_in_batch",
    f"""WITH RECURSIVE {TURNS} SELECT job_id, other AS reposted_from_job_id FROM best WHERE NOT active AND nth = 1 AND job_id NOT IN (SELECT job_id FROM pairs)""",
)
def _(spark, folder):
    """New jobs that repeat one which an earlier run of the same batch removed."""
    rows = collect_batch(empty_registry(spark), *batch(spark, folder)).jobs
    return rows.where("reposted_from_job_id IS NOT NULL").select("job_id", "reposted_from_job_id")
