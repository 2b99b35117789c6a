"""Duplicate review: candidates, merge, unmerge, dismissal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.operators.fuzzy import best_matches
from tidepost.operators.lifespans import Lifespans
from tidepost.operators.state import Registry
from tidepost.functions.similarity import MatchRule
from tidepost.functions.text import plain_name
from tidepost.session import written


def _pair(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("low"), F.greatest(left, right).alias("high")]


def unreviewed(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs nobody has decided on yet, in either order of the two jobs."""
    seen = candidates.where("status <> 'pending'").select("user_id", *_pair("job_id", "candidate_job_id"))
    keyed = pairs.withColumns(dict(zip(("low", "high"), _pair("job_id", "candidate_job_id"))))
    return keyed.join(seen, ["user_id", "low", "high"], "left_anti").drop("low", "high")


def comparable(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Stored jobs in the normalised form the match takes."""
    names = companies.select("user_id", "company_id", F.col("company_name").alias("name"))
    return jobs.join(names, ["user_id", "company_id"]).select(
        "user_id", "job_id", plain_name(F.col("name")).alias("company"),
        plain_name(F.col("title")).alias("title"), plain_name(F.col("location")).alias("location"),
    )


def resembling(
    new_jobs: DataFrame, before: Registry, times: Lifespans, rule: MatchRule = MatchRule()
) -> tuple[DataFrame, DataFrame]:
    """Matches of new jobs with active ones, and of the rest with removed ones.

    What is active or removed, and under which names, is what it is when a new job's turn comes:
    stored jobs that the batch does not move count throughout, the others in their spans.
    """

    def existing(status: str) -> DataFrame:
        kind = new_jobs.schema["ord"].dataType
        rest = before.jobs.where(F.col("status") == status).join(times.moving, ["user_id", "job_id"], "left_anti")
        none = F.lit(None).cast(kind)
        rest = comparable(rest, before.companies).withColumns({"since": none, "until": none})
        return rest.unionByName(times.spans.where(F.col("status") == status).select(*rest.columns))

    active = written(best_matches(new_jobs, existing("active"), rule), "active")
    rest = new_jobs.join(active.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")
    return active, best_matches(rest, existing("removed"), rule)


def new_candidates(matches: DataFrame, new_jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """M8: one pending candidate per new job with a match that was not reviewed before."""
    pairs = matches.withColumnRenamed("match_id", "candidate_job_id")
    pairs = unreviewed(pairs, candidates).join(
        new_jobs.select("user_id", "job_id", F.col("seen_at").alias("created_at")), ["user_id", "job_id"]
    )
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "job_id", "candidate_job_id"), 256)
    return pairs.select(
        "user_id", key.alias("candidate_id"), "job_id", "candidate_job_id",
        F.col("score").alias("similarity_score"), "company_score", "title_score", "location_score",
        F.lit("pending").alias("status"), "created_at",
    )


def with_reposts(jobs: DataFrame, reposts: DataFrame) -> DataFrame:
    """New jobs point to the removed job they repeat."""
    found = reposts.select("user_id", "job_id", F.col("match_id").alias("repost_of"))
    rows = jobs.join(found, ["user_id", "job_id"], "left")
    return rows.withColumn("reposted_from_job_id", F.coalesce("repost_of", "reposted_from_job_id")).select(
        *jobs.columns
    )


def candidate_list(
    candidates: DataFrame, jobs: DataFrame, companies: DataFrame, status: str = "pending"
) -> DataFrame:
    """Candidates of a status, oldest first, with a summary of both jobs."""
    fields = ("title", "company_name", "location", "application_url", "status")
    summary = jobs.join(companies.select("company_id", "company_name"), "company_id").select(
        "user_id", F.col("job_id").alias("id"), F.struct(F.col("job_id").alias("id"), *fields).alias("summary")
    )
    out = candidates.where(F.col("status") == status)
    for side, name in (("job_id", "job"), ("candidate_job_id", "candidate_job")):
        part = summary.select("user_id", F.col("id").alias(side), F.col("summary").alias(name))
        out = out.join(part, ["user_id", side])
    return out.orderBy("created_at", "candidate_id")


# -- decisions ----------------------------------------------------------------------


def checked_decisions(decisions: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """M9: merge decisions with the jobs to keep and to merge, and their outcome.

    A decision ``(user_id, candidate_id, keep, decided_at)`` is valid when its candidate is
    pending, both jobs are active, and no earlier valid decision merged one of them away.
    A round settles every decision whose two jobs no earlier open decision would merge away,
    and every one with a job merged away before it. Any number of decisions may keep the same
    job in one round; more rounds are needed only along chains. Outcomes: ``merged``,
    ``not_pending``, ``not_found``.
    """
    keys = ["user_id", "candidate_id"]
    first = decisions.groupBy(*keys).agg(F.min("decided_at").alias("first_at"))
    known = candidates.select(*keys, "job_id", "candidate_job_id", F.col("status").alias("candidate_status"))
    keep_job = F.col("keep") == "job"
    open_now = (F.col("candidate_status") == "pending") & (F.col("decided_at") == F.col("first_at"))
    rows = decisions.join(known, keys, "left").join(first, keys).select(
        *keys, "decided_at",
        F.when(keep_job, F.col("job_id")).otherwise(F.col("candidate_job_id")).alias("kept_job_id"),
        F.when(keep_job, F.col("candidate_job_id")).otherwise(F.col("job_id")).alias("merged_job_id"),
        F.when(F.col("candidate_status").isNull(), "not_found").when(~open_now, "not_pending").alias("outcome"),
    )
    active = jobs.where("status = 'active'")
    for side, flag in (("kept_job_id", "kept_active"), ("merged_job_id", "merged_active")):
        rows = rows.join(active.select("user_id", F.col("job_id").alias(side), F.lit(True).alias(flag)), ["user_id", side], "left")
    stale = F.when(F.col("kept_active").isNull() | F.col("merged_active").isNull(), "not_pending")
    rows = rows.select(
        *keys, "decided_at", "kept_job_id", "merged_job_id", F.coalesce("outcome", stale).alias("outcome")
    )
    state = written(rows, "decisions")
    checked = state.where("outcome IS NOT NULL")
    while True:
        waiting = state.where("outcome IS NULL").withColumn("turn", F.struct("decided_at", "candidate_id"))
        if waiting.isEmpty():
            return checked
        sides = waiting.select(
            *keys, "turn", F.explode(F.array("kept_job_id", "merged_job_id")).alias("side")
        )
        threat = waiting.groupBy("user_id", F.col("merged_job_id").alias("side")).agg(
            F.min("turn").alias("threat")
        )
        # A merge settles what comes after it in the round that follows, so only those of the round before count.
        gone = state.where("outcome = 'merged'").select(
            "user_id", F.col("merged_job_id").alias("side"), F.struct("decided_at", "candidate_id").alias("gone")
        )
        verdict = (
            sides.join(threat, ["user_id", "side"], "left")
            .join(gone, ["user_id", "side"], "left")
            .groupBy(*keys)
            .agg(
                F.bool_and(F.coalesce(F.col("threat") >= F.col("turn"), F.lit(True))).alias("safe"),
                F.bool_or(F.coalesce(F.col("gone") < F.col("turn"), F.lit(False))).alias("late"),
            )
        )
        settled = waiting.join(verdict, keys).withColumn(
            "outcome", F.when(F.col("late"), "not_pending").when(F.col("safe"), "merged")
        )
        state = written(settled.select(*state.columns), "decisions")
        checked = checked.unionByName(state.where("outcome IS NOT NULL"))


def _wave(todo: DataFrame) -> DataFrame:
    """Decisions and whether each is ``ready``. Those that are can apply together: for every kept job the open ones from its
    oldest on whose merged job has nothing left to receive."""
    receives = todo.groupBy("user_id", F.col("kept_job_id").alias("merged_job_id")).agg(
        F.min("turn").alias("receives")
    )
    rows = todo.join(receives, ["user_id", "merged_job_id"], "left").withColumn(
        "complete", F.coalesce(F.col("receives") > F.col("turn"), F.lit(True))
    )
    barrier = rows.where("NOT complete").groupBy("user_id", "kept_job_id").agg(F.min("turn").alias("barrier"))
    ready = F.col("complete") & F.coalesce(F.col("turn") < F.col("barrier"), F.lit(True))
    return rows.join(barrier, ["user_id", "kept_job_id"], "left").select(*todo.columns, ready.alias("ready"))


def _moves(places: DataFrame, wave: DataFrame, key: str) -> DataFrame:
    """Rows of merged-away jobs that pass to the kept job.

    A row moves unless the kept job has one with the same key already, or an earlier merge of
    the wave brings one. No job of a wave is both kept and merged away.
    """
    gone = wave.select(
        "user_id", F.col("merged_job_id").alias("job_id"), F.col("kept_job_id").alias("to_job"), "candidate_id", "turn"
    )
    kept = wave.select("user_id", F.col("kept_job_id").alias("job_id"), F.col("kept_job_id").alias("to_job")).distinct()
    rows = places.join(gone.unionByName(kept, allowMissingColumns=True), ["user_id", "job_id"])
    found = rows.groupBy("user_id", "to_job", key).agg(
        F.bool_or(F.col("turn").isNull()).alias("held"),
        F.min_by(F.struct("candidate_id", "origin_job_id", "start_job"), "turn").alias("first"),
    )
    return found.where("NOT held").select("user_id", F.col("to_job").alias("job_id"), key, "first.*")


def decided(registry: Registry, decisions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables that follow from the outcomes of merge decisions alone, and every decision's outcome.

    Tombstones, candidates and events do not depend on the rows that pass from job to job, so links and versions are not read.
    """
    checked = checked_decisions(decisions, registry.candidates, registry.jobs)
    done = checked.where("outcome = 'merged'")
    tables = {
        "jobs": tombstoned(registry.jobs, done),
        "candidates": resolved_as_merged(registry.candidates, done),
        "events": registry.events.unionByName(merge_events(done)),
    }
    return tables, checked


def merged_registry(registry: Registry, decisions: DataFrame) -> tuple[Registry, DataFrame]:
    """The registry after a batch of merge decisions, and every decision's outcome.

    Decisions apply as if one after the other. A job that keeps a duplicate can itself be
    merged away later, so rows move in waves along such chains. Only the keys of rows of jobs
    that a decision still names take part in a wave; the tables are joined with the outcome once.
    """
    tables, checked = decided(registry, decisions)
    todo = checked.where("outcome = 'merged'").withColumn("turn", F.struct("decided_at", "candidate_id")).drop("outcome")
    moves = registry.moves
    keys = {"links": "source_id", "versions": "content_hash"}
    places, moved = {}, {table: [] for table in keys}
    while not todo.isEmpty():
        for table, key in keys.items():
            rows = places.get(table)
            if rows is None:
                rows = getattr(registry, table).withColumn("start_job", F.col("job_id"))
            places[table] = written(_places(rows, todo, key), f"{table}-places")
        waves = written(_wave(todo), "wave")
        todo = waves.where("NOT ready").drop("ready")
        for table, key in keys.items():
            new = written(_moves(places[table], waves.where("ready"), key), f"{table}-moves")
            moved[table].append(new)
            places[table] = places[table].unionByName(new.drop("candidate_id"))
            moves = moves.unionByName(
                new.select(
                    "user_id", "candidate_id", F.lit(table[:-1]).alias("kind"), "origin_job_id",
                    F.col(key).cast("string").alias("moved_key"),
                )
            )
    after = registry.changed(
        **tables,
        links=_settled(registry.links, moved["links"], "source_id"),
        versions=_settled(registry.versions, moved["versions"], "content_hash"),
        moves=moves,
    )
    return after, checked


def _places(rows: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """Keys of the rows of jobs that a decision names, with the job each row starts at.

    Jobs merged away by a wave are named by no later decision, so the rows they lost go with them.
    """
    named = todo.select("user_id", F.explode(F.array("kept_job_id", "merged_job_id")).alias("job_id")).distinct()
    return rows.join(named, ["user_id", "job_id"], "left_semi").select("user_id", "job_id", key, "origin_job_id", "start_job")


def _settled(rows: DataFrame, moved: list[DataFrame], key: str) -> DataFrame:
    """Rows at the jobs the last wave that moved them brought them to."""
    if not moved:
        return rows
    numbered = [part.withColumn("wave", F.lit(number)) for number, part in enumerate(moved)]
    to = reduce(DataFrame.unionByName, numbered).groupBy("user_id", F.col("start_job").alias("job_id"), key).agg(
        F.max_by("job_id", "wave").alias("to_job")
    )
    out = rows.join(to, ["user_id", "job_id", key], "left")
    return out.withColumn("job_id", F.coalesce("to_job", "job_id")).select(*rows.columns)


def tombstoned(jobs: DataFrame, done: DataFrame) -> DataFrame:
    to = done.select("user_id", F.col("merged_job_id").alias("job_id"), F.col("kept_job_id").alias("to_job"))
    rows = jobs.join(to, ["user_id", "job_id"], "left")
    gone = F.col("to_job").isNotNull()
    return rows.withColumn("status", F.when(gone, "merged").otherwise(F.col("status"))).withColumn(
        "merged_into_job_id", F.coalesce("to_job", "merged_into_job_id")
    ).select(*jobs.columns)


def resolved_as_merged(candidates: DataFrame, done: DataFrame) -> DataFrame:
    keys = ["user_id", "candidate_id"]
    news = done.select(
        *keys, F.col("kept_job_id").alias("new_kept"), F.col("merged_job_id").alias("new_merged"), "decided_at"
    )
    rows = candidates.join(news, keys, "left")
    hit = F.col("decided_at").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(hit, "merged").otherwise(F.col("status")),
            "resolved_at": F.coalesce("decided_at", "resolved_at"),
            "kept_job_id": F.coalesce("new_kept", "kept_job_id"),
            "merged_job_id": F.coalesce("new_merged", "merged_job_id"),
        }
    ).select(*candidates.columns)


def merge_events(done: DataFrame) -> DataFrame:
    """One event per merge."""
    kept, merged = F.col("kept_job_id").cast("string"), F.col("merged_job_id").cast("string")
    return done.select(
        "user_id", F.lit("job_merged").alias("event_type"), F.lit("job").alias("entity_type"),
        kept.alias("entity_id"),
        F.concat(F.lit("Merged job "), merged, F.lit(" into "), kept).alias("message"),
        F.to_json(
            F.struct(
                F.col("candidate_id").cast("string").alias("candidate_id"), kept.alias("kept_job_id"),
                merged.alias("merged_job_id"),
            )
        ).alias("data"),
        F.col("decided_at").alias("created_at"),
    )


def unmerged_registry(registry: Registry, requests: DataFrame) -> tuple[Registry, DataFrame]:
    """Takes merges back; exactly the rows a merge moved return.

    Content that later collections wrote to the kept job stays. ``requests`` holds
    ``user_id, candidate_id, decided_at``; outcomes are ``unmerged``, ``not_merged``,
    ``not_found``.
    """
    keys = ["user_id", "candidate_id"]
    asked = requests.groupBy(*keys).agg(F.min("decided_at").alias("decided_at")).join(
        registry.candidates.select(*keys, "status", "kept_job_id", "merged_job_id"), keys, "left"
    )
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "merged", "unmerged").otherwise(
        "not_merged"
    )
    checked = written(asked.withColumn("outcome", outcome).drop("status"), "unmerges")
    done = checked.where("outcome = 'unmerged'")
    back = registry.moves.join(done, keys)
    links = _returned(registry.links, back.where("kind = 'link'"), "source_id")
    versions = _returned(registry.versions, back.where("kind = 'version'"), "content_hash")
    revived = done.select("user_id", F.col("merged_job_id").alias("job_id"), F.lit(True).alias("revived"))
    jobs = registry.jobs.join(revived, ["user_id", "job_id"], "left")
    jobs = jobs.withColumn("status", F.when(F.col("revived"), "active").otherwise(F.col("status"))).withColumn(
        "merged_into_job_id", F.when(F.col("revived").isNull(), F.col("merged_into_job_id"))
    ).select(*registry.jobs.columns)
    kept, merged = F.col("kept_job_id").cast("string"), F.col("merged_job_id").cast("string")
    events = done.select(
        "user_id", F.lit("job_unmerged").alias("event_type"), F.lit("job").alias("entity_type"),
        kept.alias("entity_id"), F.concat(F.lit("Unmerged job "), merged, F.lit(" from "), kept).alias("message"),
        F.to_json(F.struct(F.col("candidate_id").cast("string").alias("candidate_id"))).alias("data"),
        F.col("decided_at").alias("created_at"),
    )
    after = registry.changed(
        links=links,
        versions=versions,
        jobs=jobs,
        candidates=_closed(registry.candidates, done.select(*keys, "decided_at")),
        moves=registry.moves.join(done.select(*keys), keys, "left_anti"),
        events=registry.events.unionByName(events),
    )
    return after, checked


def _returned(rows: DataFrame, back: DataFrame, key: str) -> DataFrame:
    """Moved rows, known by the job they were made for, go where the latest request sends them."""
    home = back.groupBy(
        "user_id", "origin_job_id", F.col("moved_key").cast(rows.schema[key].dataType).alias(key)
    ).agg(F.max_by("merged_job_id", F.struct("decided_at", "candidate_id")).alias("home_job"))
    out = rows.join(home, ["user_id", "origin_job_id", key], "left")
    return out.withColumn("job_id", F.coalesce("home_job", "job_id")).select(*rows.columns)


def _closed(candidates: DataFrame, closed: DataFrame) -> DataFrame:
    rows = candidates.join(closed, ["user_id", "candidate_id"], "left")
    hit = F.col("decided_at").isNotNull()
    return rows.withColumn("status", F.when(hit, "dismissed").otherwise(F.col("status"))).withColumn(
        "resolved_at", F.coalesce("decided_at", "resolved_at")
    ).select(*candidates.columns)


def dismissed(candidates: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending candidates dismissed on request; others report a conflict."""
    keys = ["user_id", "candidate_id"]
    asked = requests.groupBy(*keys).agg(F.min("decided_at").alias("decided_at")).join(
        candidates.select(*keys, "status"), keys, "left"
    )
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "pending", "dismissed").otherwise(
        "not_pending"
    )
    checked = asked.withColumn("outcome", outcome)
    closed = checked.where("outcome = 'dismissed'").select(*keys, "decided_at")
    return _closed(candidates, closed), checked.select(*keys, "outcome")
