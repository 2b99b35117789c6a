"""Queries: streams run to the end of the available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepost.plans.book import query
from tidepost.plans.queries_payloads import PARTS, ashby_landed, lever_landed
from tidepost.plans.queries_reading import RUNS_SQL, runs
from tidepost.plans.views import view
from tidepost.session import shared_folder
from tidepost.streaming import activity, collection


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tidepost/{name}-{uuid.uuid4().hex}"


def sightings_stream(spark, folder):
    rows = spark.readStream.schema(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.select(
        F.col("user_id").alias("source_id"), (F.col("user_id") % 10).alias("user_id"), "event_type",
        F.col("ts").cast("timestamp").alias("seen_at"), F.get_json_object("props", "$.k").alias("item"),
    )


@query(
    "S1_continuous_collection",
    f"""WITH parts AS ({PARTS}) SELECT 'ashby' AS ats_type, 'a-' || CAST(k AS STRING) AS external_job_id, title, 'active' AS status FROM parts WHERE k % 50 NOT IN (0, 1)
    UNION ALL SELECT 'lever', 'l-' || CAST(k AS STRING), title, 'active' FROM parts WHERE k % 50 NOT IN (0, 1, 2)""",
)
def _(spark, folder):
    """Two landed sets arrive one after the other; the second meets the registry of the first."""
    landed, state, progress = fresh(spark, "landed"), fresh(spark, "registry"), fresh(spark, "progress")
    for part in (ashby_landed(spark, folder), lever_landed(spark, folder)):
        rows = part.withColumns(
            {
                "user_id": F.col("user_id").cast("string"),
                "run_id": F.concat("run_id", F.lit("@"), "source_url"),
                "source_id": F.concat(F.substring_index(F.substring_index("source_url", "/", 3), "//", -1), F.lit("/"), F.col("source_id").cast("string")),
            }
        )
        rows.write.mode("append").parquet(landed)
        stream = collection.landed_stream(spark, landed)
        collection.collect_continuously(stream, state, progress, rule=None).awaitTermination()
    jobs = collection.newest_registry(spark, state).jobs
    return jobs.select("ats_type", "external_job_id", "title", "status")


@query("S2_first_sightings", "SELECT DISTINCT source_id, json_extract_string(item_json, '$.k') AS item FROM d5_sightings")
def _(spark, folder):
    out = fresh(spark, "first")
    stream = activity.first_sightings(sightings_stream(spark, folder), "40 days").select("source_id", "item")
    stream.writeStream.outputMode("append").option("checkpointLocation", fresh(spark, "progress")).trigger(
        availableNow=True
    ).format("parquet").start(out).awaitTermination()
    return spark.read.schema("source_id bigint, item string").parquet(out)


@query(
    "S3_rolling_activity",
    """WITH hours AS (SELECT user_id % 10 AS user_id, event_type, date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS window_start FROM events, range(24) r(h))
    SELECT user_id, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS sightings, count(*) FILTER (event_type = 'error') AS failures FROM hours GROUP BY user_id, window_start""",
)
def _(spark, folder):
    out = fresh(spark, "activity")
    stream = activity.hourly_activity(sightings_stream(spark, folder))
    activity.kept_updates(stream, out, fresh(spark, "progress")).awaitTermination()
    rows = activity.rolling_activity(activity.latest_updates(spark.read.parquet(out), ["user_id", "hour"]))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    "S4_failure_alerts",
    f"""WITH {RUNS_SQL}, last AS (SELECT source_id, max(started_at) AS ok FROM runs WHERE status = 'success' GROUP BY source_id),
    c AS (SELECT r.source_id, count(*) FILTER (status = 'failed' AND (ok IS NULL OR started_at > ok)) AS consecutive_failures
     FROM runs r LEFT JOIN last USING (source_id) GROUP BY r.source_id)
    SELECT source_id, consecutive_failures, consecutive_failures >= 2 AS alert FROM c""",
)
def _(spark, folder):
    """The runs land in three parts in time order; the stream goes on after each."""
    landed, out, progress = fresh(spark, "runs"), fresh(spark, "alerts"), fresh(spark, "progress")
    rows = runs(spark, folder).select("source_id", F.col("started_at").cast("timestamp").alias("started_at"), "status", "run_day")
    edges = ["2024-01-01", "2024-01-11", "2024-01-21", "9999-01-01"]
    for low, high in zip(edges, edges[1:]):
        part = rows.where((F.col("run_day") >= F.lit(low).cast("date")) & (F.col("run_day") < F.lit(high).cast("date")))
        part.drop("run_day").write.mode("append").parquet(landed)
        stream = spark.readStream.schema("source_id bigint, started_at timestamp, status string").parquet(landed)
        activity.kept_updates(activity.failure_alerts(stream), out, progress).awaitTermination()
    return activity.latest_updates(spark.read.parquet(out), ["source_id"])
