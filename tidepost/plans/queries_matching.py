"""Queries: similarity, fuzzy match, candidates, merge and unmerge."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.functions.similarity import MatchRule
from tidepost.functions.text import plain_name
from tidepost.operators import fuzzy, review
from tidepost.operators import sweep as sweeping
from tidepost.operators.state import empty_registry
from tidepost.plans.book import query
from tidepost.plans.queries_reading import SIGHTINGS_SQL, companies, history, jobs
from tidepost.plans.queries_scalars import _named
from tidepost.plans.views import view

# Ratio of two strings by matching blocks: the longest common block, the earliest on equal
# length, then the same left and right of it.
RATIOS = """strings AS (SELECT DISTINCT a, b FROM wanted WHERE a <> b),
 blocks AS (SELECT a, b, a AS x, b AS y, 0 AS m FROM strings
  UNION ALL SELECT a, b, c.x, c.y, c.m FROM (SELECT a, b, unnest([
    {'x': substr(x, 1, -best.i - 1), 'y': substr(y, 1, instr(y, best.s) - 1), 'm': best.l},
    {'x': substr(x, -best.i + best.l), 'y': substr(y, instr(y, best.s) + best.l), 'm': 0}]) AS c
   FROM (SELECT a, b, x, y, list_max(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i:
     list_transform(range(1, length(x) - i + 2), lambda l: {'l': l, 'i': -i, 's': substr(x, i, l)}))), lambda e: contains(y, e.s))) AS best
    FROM blocks WHERE x <> '' AND y <> '') WHERE best IS NOT NULL)),
 ratios AS (SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS r FROM blocks GROUP BY a, b)"""


def ratio_of(alias: str) -> str:
    return f"coalesce({alias}.r, 1.0::DOUBLE)"


COMPOSITE = "CAST(0.5 AS DOUBLE) * c + CAST(0.4 AS DOUBLE) * t + CAST(0.1 AS DOUBLE) * l"
PAIR_SQL = f"""WITH RECURSIVE named AS (SELECT job_id, {_named('brand')} AS company, {_named('title')} AS title, {_named('location')} AS location FROM d1_jobs),
 pairs AS (SELECT d.candidate_id, a.company AS nc, a.title AS nt, a.location AS nl, b.company AS oc, b.title AS ot, b.location AS ol
  FROM d9_candidates d JOIN named a ON a.job_id = d.job_id JOIN named b ON b.job_id = d.candidate_job_id),
 wanted AS (SELECT nc AS a, oc AS b FROM pairs UNION SELECT nt, ot FROM pairs UNION SELECT nl, ol FROM pairs), {RATIOS},
 scored AS (SELECT p.*, {ratio_of('rc')} AS c, {ratio_of('rt')} AS t, {ratio_of('rl')} AS l FROM pairs p LEFT JOIN ratios rc ON rc.a = nc AND rc.b = oc
  LEFT JOIN ratios rt ON rt.a = nt AND rt.b = ot LEFT JOIN ratios rl ON rl.a = nl AND rl.b = ol)"""


def named_jobs(spark, folder):
    rows = view(spark, folder, "d1_jobs")
    return rows.select(
        "user_id", "job_id", "status", plain_name(F.col("brand")).alias("company"),
        plain_name(F.col("title")).alias("title"), plain_name(F.col("location")).alias("location"),
    )


def candidate_pairs(spark, folder):
    named = named_jobs(spark, folder)
    parts = ("company", "title", "location")
    new = named.select("job_id", *[F.col(p).alias(f"new_{p}") for p in parts])
    old = named.select(F.col("job_id").alias("candidate_job_id"), *[F.col(p).alias(f"old_{p}") for p in parts])
    return view(spark, folder, "d9_candidates").join(new, "job_id").join(old, "candidate_job_id")


@query("F10_sequence_ratio", f"{PAIR_SQL} SELECT candidate_id, c AS company_score, t AS title_score, l AS location_score FROM scored")
def _(spark, folder):
    return fuzzy.scored_pairs(candidate_pairs(spark, folder)).select(
        "candidate_id", "company_score", "title_score", "location_score"
    )


@query("F11_composite_score", f"{PAIR_SQL} SELECT candidate_id, {COMPOSITE} AS score FROM scored")
def _(spark, folder):
    return fuzzy.scored_pairs(candidate_pairs(spark, folder)).select("candidate_id", "score")


@query(
    "P6_fuzzy_gates",
    f"{PAIR_SQL} SELECT candidate_id, {COMPOSITE} AS score FROM scored WHERE c >= 0.6 AND t >= 0.85 AND {COMPOSITE} >= CAST(0.8 AS DOUBLE)",
)
def _(spark, folder):
    rows = fuzzy.scored_pairs(candidate_pairs(spark, folder))
    passing = fuzzy.gates_pass(F.col("company_score"), F.col("title_score"), F.col("score"), MatchRule())
    return rows.where(passing).select("candidate_id", "score")


def _match_sql(status: str, gates: str, composite: str, new: str = "status = 'merged'", tail: str = "") -> str:
    """Every new job against every stored job of its user, all ratios, best composite."""
    return f"""WITH RECURSIVE named AS (SELECT user_id, job_id, status, {_named('brand')} AS company, {_named('title')} AS title, {_named('location')} AS location FROM d1_jobs),
 new_jobs AS (SELECT * FROM named WHERE {new}), old_jobs AS (SELECT * FROM named WHERE status = '{status}'),
 wanted AS (SELECT DISTINCT n.company AS a, o.company AS b FROM (SELECT DISTINCT company FROM new_jobs) n, (SELECT DISTINCT company FROM old_jobs) o
  UNION SELECT n.title, o.title FROM (SELECT DISTINCT title FROM new_jobs) n, (SELECT DISTINCT title FROM old_jobs) o
  UNION SELECT n.location, o.location FROM (SELECT DISTINCT location FROM new_jobs) n, (SELECT DISTINCT location FROM old_jobs) o), {RATIOS},
 new_triples AS (SELECT DISTINCT user_id, company, title, location FROM new_jobs),
 old_triples AS (SELECT user_id, company, title, location, min(job_id) AS match_id FROM old_jobs GROUP BY ALL),
 scored AS (SELECT n.*, o.match_id, {ratio_of('rc')} AS c, {ratio_of('rt')} AS t, {ratio_of('rl')} AS l FROM new_triples n JOIN old_triples o ON o.user_id = n.user_id
  LEFT JOIN ratios rc ON rc.a = n.company AND rc.b = o.company LEFT JOIN ratios rt ON rt.a = n.title AND rt.b = o.title
  LEFT JOIN ratios rl ON rl.a = n.location AND rl.b = o.location),
 best AS (SELECT *, {composite} AS score, row_number() OVER (PARTITION BY user_id, company, title, location ORDER BY {composite} DESC, match_id) AS rn FROM scored WHERE {gates}),
 found AS (SELECT user_id, n.job_id, match_id, c AS company_score, t AS title_score, l AS location_score, score FROM new_jobs n JOIN best USING (user_id, company, title, location) WHERE rn = 1)
 {tail or 'SELECT * FROM found'}"""


GATES = f"c >= 0.6 AND t >= 0.85 AND {COMPOSITE} >= CAST(0.8 AS DOUBLE)"
STRICT = MatchRule(company_gate=0.75, title_gate=0.9, composite_gate=0.93, company_weight=0.4, title_weight=0.4, location_weight=0.2)
STRICT_COMPOSITE = "CAST(0.4 AS DOUBLE) * c + CAST(0.4 AS DOUBLE) * t + CAST(0.2 AS DOUBLE) * l"
STRICT_GATES = f"c >= 0.75 AND t >= 0.9 AND {STRICT_COMPOSITE} >= CAST(0.93 AS DOUBLE)"


def _sides(spark, folder, status):
    named = named_jobs(spark, folder)
    new = named.where("status = 'merged'").withColumn("ord", F.lit(1))
    old = named.where(F.col("status") == status).withColumn("since", F.lit(None).cast("int"))
    return new, old


@query("J6_fuzzy_match", _match_sql("active", GATES, COMPOSITE))
def _(spark, folder):
    return fuzzy.best_matches(*_sides(spark, folder, "active"))


@query("W3_best_match", _match_sql("active", GATES, COMPOSITE, tail="SELECT job_id, match_id, score FROM found"))
def _(spark, folder):
    return fuzzy.best_matches(*_sides(spark, folder, "active")).select("job_id", "match_id", "score")


@query("U3_match_rule", _match_sql("active", STRICT_GATES, STRICT_COMPOSITE))
def _(spark, folder):
    return fuzzy.best_matches(*_sides(spark, folder, "active"), STRICT)


@query(
    "J8_repost_match",
    _match_sql("removed", STRICT_GATES, STRICT_COMPOSITE, tail="SELECT job_id, match_id AS reposted_from_job_id FROM found"),
)
def _(spark, folder):
    found = fuzzy.best_matches(*_sides(spark, folder, "removed"), STRICT)
    return found.select("job_id", F.col("match_id").alias("reposted_from_job_id"))


@query(
    "M8_fuzzy_candidates",
    _match_sql(
        "active", GATES, COMPOSITE,
        tail="""SELECT user_id, job_id, match_id AS candidate_job_id, score AS similarity_score, company_score, title_score, location_score, 'pending' AS status FROM found f
     WHERE NOT EXISTS (SELECT 1 FROM reviewed r WHERE r.low = least(f.job_id, f.match_id) AND r.high = greatest(f.job_id, f.match_id))""",
    ).replace("SELECT user_id, job_id, match_id AS candidate", "SELECT f.user_id, job_id, match_id AS candidate").replace(
        " found AS (", " reviewed AS (SELECT candidate_job_id AS low, job_id AS high FROM d9_candidates WHERE status <> 'pending'), found AS ("
    ),
)
def _(spark, folder):
    new, old = _sides(spark, folder, "active")
    new = new.withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    named = named_jobs(spark, folder)
    reviewed = view(spark, folder, "d9_candidates").join(named.select("job_id", "user_id"), "job_id")
    rows = review.new_candidates(fuzzy.best_matches(new, old), new, reviewed)
    return rows.select(
        "user_id", "job_id", "candidate_job_id", "similarity_score", "company_score", "title_score", "location_score", "status"
    )


def one_user(df):
    """All rows under one user; times with zone, as the registry keeps them."""
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}).withColumn("user_id", F.lit("1"))


def registry(spark, folder):
    """The views as one user's registry."""
    candidates = one_user(view(spark, folder, "d9_candidates")).drop("keep").withColumns(
        {
            "resolved_at": F.lit(None).cast("timestamp"),
            "kept_job_id": F.lit(None).cast("bigint"),
            "merged_job_id": F.lit(None).cast("bigint"),
        }
    )
    return empty_registry(spark).changed(
        jobs=one_user(view(spark, folder, "d1_jobs")),
        links=one_user(view(spark, folder, "d3_job_sources")).withColumn("origin_job_id", F.col("job_id")),
        versions=one_user(history(spark, folder)).withColumn("origin_job_id", F.col("job_id")),
        candidates=candidates,
    )


def decisions(spark, folder):
    return one_user(view(spark, folder, "d9_candidates")).select(
        "user_id", "candidate_id", "keep", F.col("created_at").alias("decided_at")
    )


# Open decisions form runs of consecutive orders; each run is walked in order of decision.
WALK = """cand AS (SELECT d.*, CASE keep WHEN 'job' THEN d.job_id ELSE candidate_job_id END AS kept, CASE keep WHEN 'job' THEN candidate_job_id ELSE d.job_id END AS gone,
  d.status = 'pending' AND coalesce(a.status = 'active', false) AND coalesce(b.status = 'active', false) AS open
  FROM d9_candidates d LEFT JOIN d1_jobs a ON a.job_id = d.job_id LEFT JOIN d1_jobs b ON b.job_id = candidate_job_id),
 runs AS (SELECT *, candidate_id - row_number() OVER (ORDER BY candidate_id) AS run FROM cand WHERE open),
 seq AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY created_at, candidate_id) AS n FROM runs),
 {rows}
 walk AS (SELECT run, 0 AS n, CAST([] AS BIGINT[]) AS dead, CAST(NULL AS BIGINT) AS candidate_id, false AS valid{start} FROM (SELECT DISTINCT run FROM seq) r {join}
  UNION ALL SELECT run, n, CASE WHEN valid THEN list_append(dead, gone) ELSE dead END, candidate_id, valid{step} FROM
   (SELECT s.*, w.dead, NOT list_contains(dead, s.kept) AND NOT list_contains(dead, s.gone) AS valid{carry} FROM walk w JOIN seq s ON s.run = w.run AND s.n = w.n + 1))"""
PLAIN_WALK = "WITH RECURSIVE " + WALK.format(rows="", start="", join="", step="", carry="")
OUTCOME = "CASE WHEN c.status IS NULL THEN 'not_found' WHEN coalesce(w.valid, false) THEN 'merged' ELSE 'not_pending' END"


@query(
    "M9_merge_decisions",
    f"""{PLAIN_WALK} SELECT c.candidate_id, kept AS kept_job_id, gone AS merged_job_id, {OUTCOME} AS outcome FROM cand c LEFT JOIN walk w ON w.candidate_id = c.candidate_id""",
)
def _(spark, folder):
    state = registry(spark, folder)
    checked = review.checked_decisions(decisions(spark, folder), state.candidates, state.jobs)
    return checked.select("candidate_id", "kept_job_id", "merged_job_id", "outcome")


def _rows_walk(source: str, key: str) -> str:
    """The walk with all rows of a run's jobs, each moved when its job goes and the kept one lacks its key."""
    rows = f"""held AS (SELECT run, list({{'j': v.job_id, 's': v.{key}, 'o': v.job_id}}) AS rows FROM (SELECT DISTINCT run, unnest([kept, gone]) AS job_id FROM seq) q JOIN {source} v USING (job_id) GROUP BY run),"""
    step = """, CASE WHEN valid THEN list_transform(rows, lambda x: CASE WHEN x.j = gone AND NOT list_contains(list_transform(list_filter(rows, lambda y: y.j = kept), lambda y: y.s), x.s)
      THEN {'j': kept, 's': x.s, 'o': x.o} ELSE x END) ELSE rows END"""
    walk = WALK.format(
        rows=rows, start=", coalesce(h.rows, []) AS rows", join="LEFT JOIN held h USING (run)", step=step, carry=", w.rows"
    )
    return f"""{walk}, final AS (SELECT run, arg_max(rows, n) AS rows FROM walk GROUP BY run),
 moved AS (SELECT x.j AS job_id, x.s AS {key}, x.o AS origin_job_id FROM (SELECT unnest(rows) AS x FROM final))
 SELECT * FROM moved UNION ALL SELECT job_id, {key}, job_id FROM {source} WHERE job_id NOT IN (SELECT kept FROM seq UNION SELECT gone FROM seq)"""


@query("J14_merged_links", "WITH RECURSIVE " + _rows_walk("d3_job_sources", "source_id"))
def _(spark, folder):
    after, _ = review.merged_registry(registry(spark, folder), decisions(spark, folder))
    return after.links.select("job_id", "source_id", "origin_job_id")


@query("M9_merged_versions", f"WITH RECURSIVE {SIGHTINGS_SQL}, " + _rows_walk("history", "content_hash"))
def _(spark, folder):
    after, _ = review.merged_registry(registry(spark, folder), decisions(spark, folder))
    return after.versions.select("job_id", "content_hash", "origin_job_id")


@query(
    "M9_tombstones",
    f"""{PLAIN_WALK} SELECT j.job_id, CASE WHEN w.valid THEN 'merged' ELSE j.status END AS status, CASE WHEN w.valid THEN c.kept ELSE merged_into_job_id END AS merged_into_job_id
    FROM d1_jobs j LEFT JOIN (SELECT gone, kept, w.valid FROM walk w JOIN cand USING (candidate_id) WHERE w.valid) c ON c.gone = j.job_id LEFT JOIN (SELECT true AS valid) w ON c.valid""",
)
def _(spark, folder):
    tables, _ = review.decided(registry(spark, folder), decisions(spark, folder))
    return tables["jobs"].select("job_id", "status", "merged_into_job_id")


@query(
    "M19_merge_events",
    f"""{PLAIN_WALK} SELECT 'job_merged' AS event_type, CAST(kept AS STRING) AS entity_id, 'Merged job ' || CAST(gone AS STRING) || ' into ' || CAST(kept AS STRING) AS message,
     '{{"candidate_id":"' || CAST(candidate_id AS STRING) || '","kept_job_id":"' || CAST(kept AS STRING) || '","merged_job_id":"' || CAST(gone AS STRING) || '"}}' AS data, created_at
    FROM walk w JOIN cand USING (candidate_id) WHERE w.valid""",
)
def _(spark, folder):
    tables, _ = review.decided(registry(spark, folder), decisions(spark, folder))
    return tables["events"].select("event_type", "entity_id", "message", "data", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def _unmerged(spark, folder):
    after, checked = review.merged_registry(registry(spark, folder), decisions(spark, folder))
    done = checked.where("outcome = 'merged'")
    # Taken back in the opposite order.
    back = F.timestamp_micros(F.lit(4102444800000000) - F.unix_micros("decided_at") - F.col("candidate_id"))
    return review.unmerged_registry(after, done.select("user_id", "candidate_id", back.alias("decided_at")))


@query("M10_unmerged_links", "SELECT job_id, source_id FROM d3_job_sources")
def _(spark, folder):
    after, _ = _unmerged(spark, folder)
    return after.links.select("job_id", "source_id")


@query(
    "M10_unmerged_candidates",
    f"""{PLAIN_WALK} SELECT c.candidate_id, CASE WHEN coalesce(w.valid, false) THEN 'dismissed' ELSE c.status END AS status FROM cand c LEFT JOIN walk w ON w.candidate_id = c.candidate_id""",
)
def _(spark, folder):
    after, _ = _unmerged(spark, folder)
    return after.candidates.select("candidate_id", "status")


@query(
    "M11_dismiss",
    "SELECT candidate_id, CASE WHEN status = 'pending' THEN 'dismissed' ELSE 'not_pending' END AS outcome FROM d9_candidates",
)
def _(spark, folder):
    candidates = registry(spark, folder).candidates
    _, checked = review.dismissed(candidates, decisions(spark, folder))
    return checked.select("candidate_id", "outcome")


STRANDED = """stranded AS (SELECT candidate_id, min(j.job_id) AS gone_job, min(removed_at) AS gone_at FROM d9_candidates c JOIN d1_jobs j ON j.job_id IN (c.job_id, candidate_job_id)
 WHERE c.status = 'pending' AND j.status = 'removed' GROUP BY candidate_id)"""


def _removed(spark, folder):
    rows = view(spark, folder, "d1_jobs").where("status = 'removed'")
    return rows.select("job_id", F.col("removed_at").alias("gone_at"))


@query(
    "M7_dismissed_on_removal",
    f"""WITH {STRANDED} SELECT candidate_id, CASE WHEN gone_at IS NOT NULL THEN 'dismissed' ELSE status END AS status, gone_at AS resolved_at
    FROM d9_candidates LEFT JOIN stranded USING (candidate_id)""",
)
def _(spark, folder):
    candidates = view(spark, folder, "d9_candidates").withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    stranded = sweeping.stranded_candidates(candidates, _removed(spark, folder))
    return sweeping.dismissed_candidates(candidates, stranded).select("candidate_id", "status", "resolved_at")


@query(
    "M19_removal_events",
    f"""WITH {STRANDED} SELECT 'job_merge_candidate_dismissed_on_removal' AS event_type, CAST(candidate_id AS STRING) AS entity_id,
     'Dismissed merge candidate ' || CAST(candidate_id AS STRING) || ' because job ' || CAST(gone_job AS STRING) || ' was removed' AS message, gone_at AS created_at FROM stranded""",
)
def _(spark, folder):
    candidates = view(spark, folder, "d9_candidates").withColumn("user_id", F.lit("1"))
    stranded = sweeping.stranded_candidates(candidates, _removed(spark, folder))
    return sweeping.dismissal_events(candidates, stranded).select("event_type", "entity_id", "message", "created_at")


@query(
    "J7_unreviewed_pairs",
    "SELECT candidate_job_id AS job_id, job_id AS candidate_job_id FROM d9_candidates WHERE status = 'pending'",
)
def _(spark, folder):
    candidates = one_user(view(spark, folder, "d9_candidates"))
    swapped = candidates.select("user_id", F.col("candidate_job_id").alias("job_id"), F.col("job_id").alias("candidate_job_id"))
    return review.unreviewed(swapped, candidates).select("job_id", "candidate_job_id")


LIST_SQL = """SELECT c.candidate_id, c.created_at, similarity_score, a.job_id AS job, a.title AS job_title, a.company_name AS job_company, a.status AS job_status,
 b.job_id AS candidate_job, b.title AS candidate_title, b.company_name AS candidate_company, b.status AS candidate_status
 FROM d9_candidates c JOIN d1_jobs a ON a.job_id = c.job_id JOIN d1_jobs b ON b.job_id = c.candidate_job_id WHERE c.status = '{status}'"""


def _listed(spark, folder, status):
    rows = review.candidate_list(
        one_user(view(spark, folder, "d9_candidates")), one_user(jobs(spark, folder)), companies(spark, folder), status
    )
    return rows.select(
        "candidate_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "similarity_score",
        F.col("job.id").alias("job"), F.col("job.title").alias("job_title"), F.col("job.company_name").alias("job_company"),
        F.col("job.status").alias("job_status"), F.col("candidate_job.id").alias("candidate_job"),
        F.col("candidate_job.title").alias("candidate_title"), F.col("candidate_job.company_name").alias("candidate_company"),
        F.col("candidate_job.status").alias("candidate_status"),
    )


@query("J12_candidate_list", LIST_SQL.format(status="pending"))
def _(spark, folder):
    return _listed(spark, folder, "pending")


@query("T3_dismissed_candidates", LIST_SQL.format(status="dismissed"))
def _(spark, folder):
    return _listed(spark, folder, "dismissed")
