"""The posting registry as views over the benchmark tables.

The same text runs on Spark and on an ANSI SQL engine, so a query and its counterpart
start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "d1_jobs": """
SELECT o_orderkey AS job_id, o_custkey % 10 AS user_id, o_custkey AS company_id,
 c_name AS company_name, p_name AS title, p_brand AS brand, n_name AS location,
 p_type AS ats_type, CAST(o_orderkey AS STRING) AS external_job_id,
 'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS application_url,
 o_orderdate AS first_seen_at, o_orderdate + INTERVAL '20' DAY AS last_seen_at,
 CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'removed' ELSE 'merged' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '30' DAY END AS removed_at,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'applied' WHEN '2-HIGH' THEN 'watch'
  WHEN '4-NOT SPECIFIED' THEN 'irrelevant' WHEN '5-LOW' THEN 'archived' END AS user_decision,
 CASE WHEN o_orderstatus = 'P' AND o_orderkey >= 3 THEN o_orderkey - 3 END AS merged_into_job_id,
 CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 10 = 5 THEN o_orderkey - 5 END AS reposted_from_job_id
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS part_key FROM orders) o
 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = part_key
""",
    "d2_sources": """
SELECT s_suppkey AS source_id, s_suppkey % 10 AS user_id, s_name AS name,
 'https://' || lower(replace(s_name, '#', '-')) || '.example.com/jobs' AS url,
 CASE s_nationkey % 6 WHEN 0 THEN 'vc_portfolio' WHEN 1 THEN 'company_career_page'
  WHEN 2 THEN 'ats_job_board' WHEN 3 THEN 'newsletter' WHEN 4 THEN 'talent_network'
  ELSE 'user_added' END AS category,
 CASE s_suppkey % 5 WHEN 0 THEN 'ashby' WHEN 1 THEN 'lever' WHEN 2 THEN 'jsonld' ELSE 'auto' END AS adapter,
 s_acctbal >= 0 AS enabled, CAST(1 + s_suppkey % 1000 AS INT) AS priority,
 CASE WHEN s_suppkey % 7 = 0 THEN 'CollectorError: HTTP 503' END AS last_error FROM supplier
""",
    "d3_job_sources": """
SELECT l_orderkey AS job_id, l_suppkey AS source_id, min(l_shipdate) AS first_seen_at,
 max(l_shipdate) AS last_seen_at,
 max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 AS is_active
FROM lineitem GROUP BY l_orderkey, l_suppkey
""",
    "d4_versions": """
SELECT l_orderkey AS job_id, l_shipdate AS seen_at, l_linenumber AS tie_no, l_partkey AS tie_part,
 l_quantity AS compensation_min, l_returnflag AS employment_type, l_linestatus AS remote_type,
 l_tax AS cosmetic FROM lineitem
""",
    "d5_sightings": """
SELECT event_id, user_id AS source_id, CAST(ts AS DATE) AS run_day, ts AS seen_at, props AS item_json,
 event_type, value AS compensation_min FROM events
""",
    "d5_runs": """
SELECT user_id AS source_id, CAST(ts AS DATE) AS run_day, min(ts) AS started_at, max(ts) AS completed_at,
 sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS jobs_found,
 CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'success' END AS status
FROM events GROUP BY user_id, CAST(ts AS DATE)
""",
    "d6_sheet": """
SELECT user_id AS file_id, event_id AS row_number,
 CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'VC FIRM' WHEN 1 THEN 'JOBS NEWSLETTERS'
  ELSE 'VC FELLOWSHIPS / TALENT NETWORKS' END ELSE 'row ' || CAST(event_id AS STRING) END AS name,
 CASE WHEN event_type = 'signup' THEN 'JOB AGGREGATOR URL' WHEN event_type = 'error' THEN NULL
  ELSE 'https://board-' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.example.com' END AS url FROM events
""",
    "d8_errors": """
SELECT page_id, 'CollectorError: GET ' || url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END
 || 'api_key=k' || CAST(page_id AS STRING) || ' failed; Authorization: Bearer t'
 || CAST(page_id AS STRING) AS error_text FROM pages
""",
    # Every order proposes a merge with the order before it, so proposals share jobs.
    "d9_candidates": """
SELECT o_orderkey AS candidate_id, o_orderkey AS job_id, o_orderkey - 1 AS candidate_job_id,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'dismissed' ELSE 'pending' END AS status,
 CASE WHEN o_orderkey % 2 = 0 THEN 'job' ELSE 'candidate' END AS keep,
 0.80 + CAST(o_orderkey % 20 AS DOUBLE) / 100 AS similarity_score
FROM orders WHERE o_orderkey >= 1
""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _used(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A registry view as a DataFrame."""
    return sql(spark, folder, VIEWS[name])


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Spark SQL text over benchmark tables, without touching the catalog."""
    frames = {}
    text = text.replace("{", "{{").replace("}", "}}")
    for name in _used(text, TABLES):
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        frames[name] = table(spark, folder, name)
    return spark.sql(text, **frames)


def counterpart(text: str) -> str:
    """SQL text with the views it names put in front of it."""
    needed = _used(text, VIEWS)
    if not needed:
        return text.strip()
    bodies = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    text = text.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {bodies}, {text[len('WITH RECURSIVE '):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {bodies}, {text[len('WITH '):]}"
    return f"WITH {bodies} {text}"
