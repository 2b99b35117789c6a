"""Queries: source registry, imports, plan, catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.operators import imports, sources
from tidepost.operators.state import empty_registry
from tidepost.plans.book import query
from tidepost.plans.queries_reading import RUNS_SQL, runs
from tidepost.plans.views import sql, view
from tidepost.session import shared_folder
from tidepost.sources.catalog import catalog_rows
from tidepost.sources.sheets import read_sheets, write_sheets

STATE = "CASE WHEN last_error <> '' THEN 'failed' WHEN enabled THEN 'enabled' ELSE 'disabled' END"


def registered(spark, folder):
    return view(spark, folder, "d2_sources")


@query("T2_sources_by_priority", "SELECT source_id, name, priority FROM d2_sources ORDER BY priority, name, source_id")
def _(spark, folder):
    return sources.list_sources(registered(spark, folder)).select("source_id", "name", "priority")


@query(
    "P5_source_filter",
    f"SELECT source_id, name, url FROM d2_sources WHERE category IN ('newsletter') AND adapter = 'auto' OR ({STATE} = 'enabled' AND (lower(name) LIKE '%1%' OR lower(url) LIKE '%1%'))",
)
def _(spark, folder):
    rows = registered(spark, folder)
    one = sources.filter_sources(rows, category="newsletter", adapter="auto")
    two = sources.filter_sources(rows, status="enabled", text=" 1 ")
    return one.unionByName(two).select("source_id", "name", "url").distinct()


T6_VIEW = f"""sortable AS (SELECT s.*, h.last_job_count FROM d2_sources s LEFT JOIN (SELECT source_id, arg_max(jobs_found, completed_at) FILTER (status = 'success') AS last_job_count
 FROM runs GROUP BY source_id) h USING (source_id))"""


@query(
    "T6_sort_by_job_count_desc",
    f"WITH {RUNS_SQL}, {T6_VIEW} SELECT source_id, last_job_count FROM sortable ORDER BY last_job_count DESC NULLS FIRST, source_id",
)
def _(spark, folder):
    from tidepost.operators.health import source_health

    counted = registered(spark, folder).join(
        source_health(runs(spark, folder)).select("source_id", "last_job_count"), "source_id", "left"
    )
    return sources.sort_sources(counted, "last_job_count", descending=True).select("source_id", "last_job_count")


@query("T6_sort_by_state", f"SELECT source_id, {STATE} AS state FROM d2_sources ORDER BY {STATE}, source_id")
def _(spark, folder):
    from tidepost.operators.health import with_state

    return with_state(sources.sort_sources(registered(spark, folder), "status")).select("source_id", "state")


BROKEN = """SELECT source_id, CASE WHEN source_id % 5 = 0 THEN '' ELSE name END AS name, CASE WHEN source_id % 4 = 0 THEN 'ftp://x' ELSE url END AS url,
 category, CASE WHEN source_id % 9 = 0 THEN 'workday' ELSE adapter END AS adapter, CAST(CASE WHEN source_id % 6 = 0 THEN 0 ELSE priority END AS INT) AS priority,
 CASE WHEN source_id % 8 = 0 THEN 'yearly' ELSE 'daily' END AS frequency FROM ({d2}) s"""


def _broken():
    from tidepost.plans.views import VIEWS

    return BROKEN.replace("{d2}", VIEWS["d2_sources"])


@query(
    "P8_field_validation",
    f"""SELECT source_id, array_to_string(list_filter([CASE WHEN name = '' THEN 'name' END, CASE WHEN url LIKE 'ftp%' THEN 'url' END, CASE WHEN adapter = 'workday' THEN 'adapter' END,
     CASE WHEN priority = 0 THEN 'priority' END, CASE WHEN frequency = 'yearly' THEN 'frequency' END], lambda x: x IS NOT NULL), ',') AS problems FROM ({_broken()}) b""",
)
def _(spark, folder):
    good, bad = sources.validated(sql(spark, folder, _broken()))
    ok = good.select("source_id", F.lit("").alias("problems"))
    return ok.unionByName(bad.select("source_id", F.array_join("problems", ",").alias("problems")))


def changes(spark, folder):
    """Per source one change: delete, rename, move to the next address, or a new source."""
    rows = registered(spark, folder)
    kind = F.col("source_id") % 5
    return rows.select(
        F.col("source_id").alias("seq"), "user_id",
        F.when(kind < 2, "delete").when(kind < 4, "update").otherwise("create").alias("op"),
        F.when(kind != 4, F.col("source_id").cast("string")).alias("source_id"),
        (kind == 0).alias("confirm"),
        F.when(kind == 2, F.concat(F.lit("Renamed "), "name")).when(kind == 4, F.concat(F.lit("New "), "name")).alias("name"),
        F.when(kind == 3, F.concat(F.lit("https://moved.example.com/"), F.col("source_id").cast("string")))
        .when((kind == 4) & (F.col("source_id") % 2 == 0), F.col("url"))
        .when(kind == 4, F.concat(F.lit("https://new.example.com/"), F.col("user_id").cast("string")))
        .alias("url"),
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("category", "string"), ("portfolio_firm", "string"), ("adapter", "string"), ("enabled", "boolean"),
            ("priority", "int"), ("frequency", "string"), ("notes", "string"),
        )],
    )


def source_registry(spark, folder):
    rows = registered(spark, folder).withColumn("source_id", F.col("source_id").cast("string"))
    extra = {c: F.lit(None).cast("string") for c in ("portfolio_firm", "frequency", "notes")}
    links = view(spark, folder, "d3_job_sources").join(
        registered(spark, folder).select("source_id", "user_id"), "source_id"
    ).withColumn("source_id", F.col("source_id").cast("string"))
    return empty_registry(spark).changed(sources=rows.withColumns(extra), links=links)


CHANGE_SQL = """kinds AS (SELECT *, source_id % 5 AS kind FROM d2_sources),
 firsts AS (SELECT user_id, min(source_id) AS seq FROM kinds WHERE kind = 4 AND source_id % 2 <> 0 GROUP BY user_id)"""


@query(
    "M13_change_outcomes",
    f"""WITH {CHANGE_SQL} SELECT k.source_id AS seq, k.user_id, CASE kind WHEN 0 THEN 'deleted' WHEN 1 THEN 'confirmation_required' WHEN 2 THEN 'updated' WHEN 3 THEN 'updated'
     ELSE CASE WHEN k.source_id % 2 = 0 OR f.seq IS NULL THEN 'duplicate_url' ELSE 'created' END END AS outcome FROM kinds k LEFT JOIN firsts f ON f.seq = k.source_id""",
)
def _(spark, folder):
    return sources.apply_source_changes(source_registry(spark, folder), changes(spark, folder)).outcomes


@query(
    "M13_changed_sources",
    f"""WITH {CHANGE_SQL} SELECT CASE kind WHEN 2 THEN 'Renamed ' || name ELSE name END AS name, CASE kind WHEN 3 THEN 'https://moved.example.com/' || CAST(source_id AS STRING) ELSE url END AS url,
     category, enabled, priority FROM kinds WHERE kind <> 0 UNION ALL
     SELECT 'New ' || name, 'https://new.example.com/' || CAST(k.user_id AS STRING), 'user_added', true, 100 FROM kinds k JOIN firsts f ON f.seq = k.source_id""",
)
def _(spark, folder):
    done = sources.apply_source_changes(source_registry(spark, folder), changes(spark, folder))
    return done.registry.sources.select("name", "url", "category", "enabled", "priority")


@query("M13_cascaded_links", "SELECT job_id, CAST(source_id AS STRING) AS source_id FROM d3_job_sources WHERE source_id IN (SELECT source_id FROM d2_sources) AND source_id % 5 <> 0")
def _(spark, folder):
    done = sources.apply_source_changes(source_registry(spark, folder), changes(spark, folder))
    return done.registry.links.select("job_id", "source_id")


SHEET = """SELECT file_id % 10 AS user_id, file_id, row_number, name, url FROM ({d6}) s"""
# Every second board address is registered already.
KNOWN = """SELECT DISTINCT file_id % 10 AS user_id, 'old ' || url AS source_id, 'Known' AS name, url, 'user_added' AS category, true AS enabled FROM ({d6}) s
 WHERE url LIKE 'https%' AND length(url) % 2 = 0"""


def _d6(text):
    from tidepost.plans.views import VIEWS

    return text.replace("{d6}", VIEWS["d6_sheet"])


def sheet(spark, folder):
    return sql(spark, folder, _d6(SHEET))


def known(spark, folder):
    return sql(spark, folder, _d6(KNOWN))


SECTION = """CASE upper(name) WHEN 'VC FIRM' THEN 'vc_portfolio' WHEN 'JOBS NEWSLETTERS' THEN 'newsletter' WHEN 'VC FELLOWSHIPS / TALENT NETWORKS' THEN 'talent_network' END"""
IMPORT_SQL = f"""sheet AS ({_d6(SHEET)}), known AS ({_d6(KNOWN)}),
 marked AS (SELECT *, {SECTION} AS heading, coalesce(url LIKE 'http%', false) AS usable FROM sheet),
 placed AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM marked),
 body AS (SELECT user_id, file_id, row_number, name, coalesce(url, '') AS url, category, usable,
  CASE WHEN usable THEN row_number() OVER (PARTITION BY file_id, usable, url ORDER BY row_number) END AS nth FROM placed WHERE heading IS NULL),
 found AS (SELECT b.*, k.source_id IS NOT NULL AS exists FROM body b LEFT JOIN known k ON k.user_id = b.user_id AND k.url = b.url),
 creating AS (SELECT user_id, url, min(file_id) AS file_id FROM found WHERE nth = 1 AND category IS NOT NULL AND NOT exists GROUP BY user_id, url),
 outcomes AS (SELECT f.user_id, f.file_id, row_number, name, f.url, category,
  CASE WHEN NOT usable THEN 'skip' WHEN nth > 1 OR category IS NULL THEN 'flag' WHEN exists OR c.file_id < f.file_id THEN 'update' ELSE 'create' END AS action,
  CASE WHEN NOT usable THEN 'No usable URL' WHEN nth > 1 THEN 'Duplicate URL already seen earlier in this workbook' WHEN category IS NULL THEN 'URL found before any recognized section header' END AS reason
  FROM found f LEFT JOIN creating c ON c.user_id = f.user_id AND c.url = f.url)"""


def outcomes(spark, folder):
    return imports.classified(sheet(spark, folder), known(spark, folder))


@query("A15_sheet_scan", "SELECT row_number, name, url FROM d6_sheet")
def _(spark, folder):
    import uuid

    path = f"{shared_folder(spark)}/tidepost/sheets-{uuid.uuid4().hex}"
    write_sheets(sheet(spark, folder), path)
    return read_sheets(spark, path).select("row_number", "name", "url")


@query("W1_sheet_sections", f"WITH {IMPORT_SQL} SELECT file_id, row_number, category FROM placed WHERE heading IS NULL")
def _(spark, folder):
    return imports.with_section(sheet(spark, folder)).select("file_id", "row_number", "category")


@query(
    "W2_first_rows",
    f"WITH {IMPORT_SQL} SELECT s.file_id, row_number, CASE WHEN usable THEN min(row_number) OVER (PARTITION BY s.file_id, usable, url) END AS first_row FROM marked s",
)
def _(spark, folder):
    return imports.with_first_row(sheet(spark, folder)).select("file_id", "row_number", "first_row")


@query("P7_usable_url", f"WITH {IMPORT_SQL} SELECT file_id, row_number, usable FROM marked")
def _(spark, folder):
    return sheet(spark, folder).select("file_id", "row_number", imports.usable_url(F.col("url")).alias("usable"))


@query("J10_existing_sources", f"WITH {IMPORT_SQL} SELECT file_id, row_number, k.source_id AS existing_id FROM sheet s LEFT JOIN known k ON k.user_id = s.user_id AND k.url = s.url")
def _(spark, folder):
    return imports.with_existing(sheet(spark, folder), known(spark, folder)).select("file_id", "row_number", "existing_id")


@query("M14_import_classify", f"WITH {IMPORT_SQL} SELECT file_id, row_number, name, url, category, action, reason FROM outcomes")
def _(spark, folder):
    return outcomes(spark, folder).drop("user_id")


@query("P10_import_preview", f"WITH {IMPORT_SQL} SELECT file_id, row_number, url, action FROM outcomes WHERE action <> 'skip'")
def _(spark, folder):
    return imports.preview(outcomes(spark, folder)).select("file_id", "row_number", "url", "action")


@query(
    "M15_import_apply",
    f"""WITH {IMPORT_SQL}, acts AS (SELECT * FROM outcomes WHERE action IN ('create', 'update')),
    last AS (SELECT user_id, url, arg_max(name, (file_id, row_number)) AS name, arg_max(category, (file_id, row_number)) AS category,
     arg_min(category, (file_id, row_number)) FILTER (action = 'create') AS born FROM acts GROUP BY user_id, url)
    SELECT k.user_id, k.url, coalesce(l.name, k.name) AS name, coalesce(l.category, k.category) AS category, enabled FROM known k LEFT JOIN last l ON l.user_id = k.user_id AND l.url = k.url
    UNION ALL SELECT user_id, url, name, category, born = 'vc_portfolio' FROM last WHERE born IS NOT NULL""",
)
def _(spark, folder):
    after = imports.imported_sources(known(spark, folder), outcomes(spark, folder))
    return after.select("user_id", "url", "name", "category", "enabled")


IMPORT_COUNTS = """SELECT file_id, count(*) FILTER (action = 'create') AS created_count, count(*) FILTER (action = 'update') AS updated_count,
 count(*) FILTER (action = 'skip') AS skipped_count, count(*) FILTER (action = 'flag') AS flagged_count FROM outcomes GROUP BY file_id"""


@query("G4_import_summary", f"WITH {IMPORT_SQL} {IMPORT_COUNTS}")
def _(spark, folder):
    return imports.import_runs(outcomes(spark, folder), F.lit(None)).drop("user_id", "completed_at")


@query("G4_flagged_rows", f"WITH {IMPORT_SQL} SELECT file_id, row_number, name, url, reason FROM outcomes WHERE action = 'flag'")
def _(spark, folder):
    return imports.flagged_rows(outcomes(spark, folder)).drop("user_id")


@query(
    "T4_import_runs",
    f"""WITH {IMPORT_SQL}, times AS (SELECT user_id AS file_id, max(ts) AS completed_at FROM events GROUP BY user_id), counts AS ({IMPORT_COUNTS})
    SELECT file_id, created_count, flagged_count, completed_at FROM counts JOIN times USING (file_id) ORDER BY completed_at DESC, file_id""",
)
def _(spark, folder):
    done = sql(spark, folder, "SELECT user_id AS file_id, max(ts) AS completed_at FROM events GROUP BY user_id")
    rows = imports.import_runs(outcomes(spark, folder), F.lit(None)).drop("completed_at").join(done, "file_id")
    return imports.list_import_runs(rows).select("file_id", "created_count", "flagged_count", "completed_at")


@query(
    "A16_source_catalog",
    """SELECT source_id, '| ' || name || ' | ' || url || ' | ' || CASE WHEN source_id % 2 = 0 THEN 'lever' ELSE '—' END || ' | ' || adapter || ' / '
     || CASE WHEN source_id % 2 = 0 THEN 'supported' ELSE 'not probed' END || ' | ' || CASE WHEN source_id % 2 = 0 THEN url || '/found' ELSE '—' END || ' |' AS line
    FROM d2_sources WHERE category = 'vc_portfolio'""",
)
def _(spark, folder):
    even = F.col("source_id") % 2 == 0
    rows = registered(spark, folder).withColumns(
        {
            "detection_status": F.when(even, "supported"), "detected_platform": F.when(even, "lever"),
            "detected_application_url": F.when(even, F.concat("url", F.lit("/found"))),
        }
    )
    return catalog_rows(rows).select("source_id", "line")


@query(
    "M18_daily_plan",
    f"""WITH {RUNS_SQL}, due AS (SELECT user_id, source_id, priority, name, 'collect_source:' || CAST(source_id AS STRING) || ':' ||
      CASE WHEN user_id % 2 = 0 THEN '2024-01-20' ELSE '2024-01-19' END AS idempotency_key FROM d2_sources WHERE enabled),
    planned AS (SELECT DISTINCT source_id % 10 AS user_id, 'collect_source:' || CAST(source_id AS STRING) || ':' || CAST(run_day AS STRING) AS idempotency_key FROM runs WHERE status = 'success')
    SELECT user_id, source_id, 'collect_source' AS task_type, priority, name, idempotency_key, 1 AS payload_version FROM due d
    WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.user_id = d.user_id AND p.idempotency_key = d.idempotency_key)""",
)
def _(spark, folder):
    rows = registered(spark, folder)
    users = rows.select("user_id").distinct().withColumn(
        "timezone", F.when(F.col("user_id") % 2 == 0, "Asia/Tokyo")
    )
    planned = runs(spark, folder).where("status = 'success'").select(
        "user_id",
        F.concat(F.lit("collect_source:"), F.col("source_id").cast("string"), F.lit(":"), F.col("run_day").cast("string")).alias("idempotency_key"),
    )
    as_of = F.lit("2024-01-20 03:00:00").cast("timestamp")
    return sources.daily_plan(rows, users, planned, as_of)
