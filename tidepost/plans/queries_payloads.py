"""Queries: landed payloads built from the tables, read back through the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.fixed import AGGREGATORS
from tidepost.operators import probe
from tidepost.plans.book import query
from tidepost.plans.queries_scalars import plain_text_sql
from tidepost.plans.views import sql, table, view
from tidepost.sources import adapters, landed
from tidepost.sources.page_postings import first_text, page_postings, place

PARTS = """
SELECT p_partkey AS k, s_suppkey AS source_id, s_suppkey % 10 AS user_id, s_name AS source_name, p_name AS title, p_brand AS brand,
 p_type AS kind, n_name AS town, p_size AS size, CAST(floor(p_retailprice) AS INT) AS pay,
 '2024-03-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') AS day,
 CASE WHEN p_partkey % 50 <> 0 THEN 'https://Jobs.example.com/apply/' || CAST(p_partkey AS STRING) || '?utm_source=x&id=1' END AS apply_url,
 '<p>' || p_brand || ' &amp; <b>' || p_type || '</b></p>' AS html
FROM part JOIN supplier ON s_suppkey = CAST(floor(p_partkey / 20.0) AS BIGINT) JOIN nation ON n_nationkey = p_partkey % 25
"""
TEXT = "brand || ' & ' || kind"
EMPTY = "CAST(NULL AS STRING)"
HOSTS = {
    "ashby": "https://jobs.ashbyhq.com/board-",
    "greenhouse": "https://boards.greenhouse.io/board-",
    "lever": "https://jobs.lever.co/board-",
    "jsonld": "https://careers.example.com/board-",
}


def _bodies(rows, item, before: str, after: str, adapter: str):
    """One landed body per source; every 50th item is a bare string."""
    text = F.when(F.col("k") % 50 == 1, F.lit('"bare"')).otherwise(F.to_json(item))
    items = F.array_sort(F.collect_list(F.struct("k", text.alias("item"))))
    body = F.concat(
        F.lit(before), F.array_join(F.transform(items, lambda i: i["item"]), ","), F.lit(after)
    )
    return rows.groupBy("user_id", "source_id", "source_name").agg(body.alias("body")).select(
        "user_id", "source_id", "source_name",
        F.concat(F.lit(HOSTS[adapter]), F.col("source_id").cast("string")).alias("source_url"),
        F.lit("auto").alias("adapter"),
        F.concat(F.lit("run-"), F.col("source_id").cast("string")).alias("run_id"),
        F.lit("2024-04-01 00:00:00").cast("timestamp").alias("started_at"),
        F.lit(0).alias("skip"), F.lit(200).alias("http_status"), "body",
    )


def _c(name):
    return F.col(name)


def nowhere():
    """An address without town, region and country."""
    parts = ("addressLocality", "addressRegion", "addressCountry")
    return F.struct(F.struct(*[F.lit(None).cast("string").alias(p) for p in parts]).alias("address"))


def ashby_landed(spark, folder):
    k = _c("k")
    salary = F.struct(
        F.lit("Salary").alias("compensationType"),
        F.when(k % 50 == 2, 60.58).otherwise(_c("pay").cast("double")).alias("minValue"),
        (_c("pay") + 1000).alias("maxValue"), F.lit("USD").alias("currencyCode"),
    )
    equity = F.struct(
        F.lit("Equity").alias("compensationType"), F.lit(1.0).alias("minValue"), F.lit(2).alias("maxValue"),
        F.lit("EUR").alias("currencyCode"),
    )
    item = F.struct(
        F.concat(F.lit("a-"), k.cast("string")).alias("id"), _c("title"),
        F.when(k % 7 != 0, _c("apply_url")).alias("applyUrl"),
        F.when(k % 50 != 0, F.concat(F.lit("https://jobs.example.com/"), k.cast("string"))).alias("jobUrl"),
        F.when(k % 2 == 0, F.concat("brand", F.lit(" plain"))).alias("descriptionPlain"),
        _c("html").alias("descriptionHtml"),
        F.when(k % 3 != 0, _c("brand")).alias("department"), F.lit("Team").alias("team"),
        _c("town").alias("location"), F.when(k % 4 != 0, "Hybrid").alias("workplaceType"),
        (k % 8 == 0).alias("isRemote"), _c("kind").alias("employmentType"),
        F.concat("day", F.lit("T12:00:00Z")).alias("publishedAt"),
        F.struct(F.array(equity, salary).alias("summaryComponents")).alias("compensation"),
    )
    return _bodies(sql(spark, folder, PARTS), item, '{"jobs":[', "]}", "ashby")


def greenhouse_landed(spark, folder):
    k = _c("k")
    item = F.struct(
        k.alias("id"), F.when(k % 9 != 0, _c("title")).alias("title"),
        F.when(k % 3 != 0, _c("brand")).alias("company_name"), _c("apply_url").alias("absolute_url"),
        F.replace(F.replace("html", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("content"),
        F.array(F.struct(_c("kind").alias("name")), F.struct(F.lit("Other").alias("name"))).alias("departments"),
        F.struct(_c("town").alias("name")).alias("location"),
        F.concat("day", F.lit("T09:30:00-04:00")).alias("first_published"),
    )
    return _bodies(sql(spark, folder, PARTS), item, '{"jobs":[', "]}", "greenhouse")


def lever_landed(spark, folder):
    k = _c("k")
    item = F.struct(
        F.concat(F.lit("l-"), k.cast("string")).alias("id"), _c("title").alias("text"),
        F.when(k % 7 != 0, _c("apply_url")).alias("applyUrl"), _c("apply_url").alias("hostedUrl"),
        F.when(k % 2 == 0, _c("html")).alias("description"), _c("html").alias("descriptionBody"),
        F.struct(
            F.when(k % 3 != 0, _c("brand")).alias("department"), F.lit("Team").alias("team"),
            _c("town").alias("location"), _c("kind").alias("commitment"),
        ).alias("categories"),
        F.struct(
            F.when(k % 50 == 2, 60.58).otherwise(_c("pay").cast("double")).alias("min"),
            (_c("pay") + 1000).alias("max"), F.lit("USD").alias("currency"),
        ).alias("salaryRange"),
        F.unix_millis(F.to_timestamp(_c("day"))).alias("createdAt"),
    )
    return _bodies(sql(spark, folder, PARTS), item, "[", "]", "lever")


def jsonld_landed(spark, folder):
    k = _c("k")
    kinds = F.when(k % 2 == 0, F.array(F.lit("JobPosting"), F.lit("Thing"))).otherwise(F.array(F.lit("JobPosting")))
    address = F.struct(
        F.when(k % 3 != 0, _c("town")).alias("addressLocality"), _c("brand").alias("addressRegion"),
        F.lit("US").alias("addressCountry"),
    )
    item = F.struct(
        kinds.alias("@type"), _c("title"), _c("html").alias("description"), _c("day").alias("datePosted"),
        F.array(_c("kind"), F.lit("OTHER")).alias("employmentType"), F.lit("TELECOMMUTE").alias("jobLocationType"),
        _c("apply_url").alias("url"), F.when(k % 5 != 0, k).alias("identifier"),
        F.struct(F.when(k % 4 != 0, _c("brand")).alias("name")).alias("hiringOrganization"),
        F.array(nowhere(), F.struct(address.alias("address"))).alias("jobLocation"),
    )
    return _bodies(
        sql(spark, folder, PARTS), item,
        '<html><!-- <script type="application/ld+json">{"@type":"JobPosting"}</script> --><script type="application/ld+json">{broken</script>'
        '<script type="application/ld+json">{"@context":"x","@graph":[{"a":{"b":[[', ']]}}]}</script><p>x</p></html>', "jsonld",
    )


OUT = (
    "user_id", "source_id", "run_id", "position", "company_name", "title", "application_url", "source_job_url",
    "description_text", "department", "location", "remote_type", "employment_type",
    "compensation_min", "compensation_max", "currency", "ats_type", "external_job_id", "published_at",
)


def _shown(postings):
    return postings.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")).select(*OUT)


def _expected(keep: str, **fields: str) -> str:
    fields = {
        "user_id": "user_id", "source_id": "source_id", "run_id": "'run-' || CAST(source_id AS STRING)",
        "position": "rn - 1", **fields,
    }
    picked = ", ".join(f"{fields[name]} AS {name}" for name in OUT)
    return f"""WITH parts AS ({PARTS}), numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k) AS rn FROM parts)
    SELECT {picked} FROM numbered WHERE {keep}"""


NO_REJECT = "k % 50 NOT IN (0, 1)"


@query("A1_ashby_postings", _expected(
    NO_REJECT, company_name="source_name", title="title",
    application_url="CASE WHEN k % 7 <> 0 THEN apply_url ELSE 'https://jobs.example.com/' || CAST(k AS STRING) END",
    source_job_url="'https://jobs.example.com/' || CAST(k AS STRING)",
    description_text=f"CASE WHEN k % 2 = 0 THEN brand || ' plain' ELSE {TEXT} END",
    department="CASE WHEN k % 3 <> 0 THEN brand ELSE 'Team' END", location="town",
    remote_type="CASE WHEN k % 4 <> 0 THEN 'Hybrid' WHEN k % 8 = 0 THEN 'Remote' END", employment_type="kind",
    compensation_min="CASE WHEN k % 50 <> 2 THEN pay END", compensation_max="pay + 1000", currency="'USD'",
    ats_type="'ashby'", external_job_id="'a-' || CAST(k AS STRING)", published_at="CAST(day || ' 12:00:00' AS TIMESTAMP)",
))
def _(spark, folder):
    return _shown(adapters.collect(ashby_landed(spark, folder)).postings)


@query("A2_greenhouse_postings", _expected(
    NO_REJECT, company_name="CASE WHEN k % 3 <> 0 THEN brand ELSE source_name END",
    title="CASE WHEN k % 9 <> 0 THEN title ELSE 'Untitled role' END", application_url="apply_url", source_job_url="apply_url",
    description_text=TEXT, department="kind", location="town", remote_type=EMPTY, employment_type=EMPTY,
    compensation_min="CAST(NULL AS INT)", compensation_max="CAST(NULL AS INT)", currency=EMPTY, ats_type="'greenhouse'",
    external_job_id="CAST(k AS STRING)", published_at="CAST(day || ' 13:30:00' AS TIMESTAMP)",
))
def _(spark, folder):
    return _shown(adapters.collect(greenhouse_landed(spark, folder)).postings)


@query("A3_lever_postings", _expected(
    "k % 50 NOT IN (0, 1, 2)", company_name="source_name", title="title", application_url="apply_url", source_job_url="apply_url",
    description_text=TEXT, department="CASE WHEN k % 3 <> 0 THEN brand ELSE 'Team' END", location="town",
    remote_type="kind", employment_type="kind", compensation_min="pay", compensation_max="pay + 1000", currency="'USD'",
    ats_type="'lever'", external_job_id="'l-' || CAST(k AS STRING)", published_at="CAST(day || ' 00:00:00' AS TIMESTAMP)",
))
def _(spark, folder):
    return _shown(adapters.collect(lever_landed(spark, folder)).postings)


PAGE_URL = f"'{HOSTS['jsonld']}' || CAST(source_id AS STRING)"
PLACE = "CASE WHEN k % 3 <> 0 THEN town || ', ' ELSE '' END || brand || ', US'"
# A page position counts postings, not list entries: bare strings are none.
JSONLD_SQL = _expected(
    "true", company_name="CASE WHEN k % 4 <> 0 THEN brand ELSE source_name END", title="title",
    application_url=f"coalesce(apply_url, {PAGE_URL})", source_job_url=f"coalesce(apply_url, {PAGE_URL})",
    description_text=TEXT, department=EMPTY, location=PLACE, remote_type="'TELECOMMUTE'", employment_type="kind",
    compensation_min="CAST(NULL AS INT)", compensation_max="CAST(NULL AS INT)", currency=EMPTY, ats_type="'jsonld'",
    external_job_id="CASE WHEN k % 5 <> 0 THEN CAST(k AS STRING) ELSE coalesce(apply_url, '') END",
    published_at="CAST(day || ' 00:00:00' AS TIMESTAMP)",
).replace("FROM parts)", "FROM parts WHERE k % 50 <> 1)")


@query("A5_jsonld_postings", JSONLD_SQL)
def _(spark, folder):
    return _shown(adapters.collect(jsonld_landed(spark, folder)).postings)


@query(
    "A6_nested_postings",
    f"SELECT source_id, count(*) AS postings, count(DISTINCT title) AS titles FROM ({PARTS}) p WHERE k % 50 <> 1 GROUP BY source_id",
)
def _(spark, folder):
    found = jsonld_landed(spark, folder).select("source_id", F.explode(page_postings(F.col("body"))).alias("v"))
    title = F.try_variant_get("v", "$.title", "string")
    return found.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("postings"), F.count_distinct(title).alias("titles")
    )


@query("A7_place", f"SELECT k, {PLACE} AS place FROM ({PARTS}) p")
def _(spark, folder):
    k = _c("k")
    address = F.struct(F.when(k % 3 != 0, _c("town")).alias("addressLocality"), _c("brand").alias("addressRegion"), F.lit("US").alias("addressCountry"))
    one = F.struct(address.alias("address"))
    value = F.when(k % 2 == 0, F.to_json(one)).otherwise(
        F.to_json(F.array(nowhere(), one))
    )
    return sql(spark, folder, PARTS).select("k", place(F.parse_json(value)).alias("place"))


@query(
    "A8_first_text",
    f"SELECT k, CASE k % 4 WHEN 0 THEN kind WHEN 1 THEN kind WHEN 2 THEN CAST(size AS STRING) END AS first FROM ({PARTS}) p",
)
def _(spark, folder):
    kind = F.col("k") % 4
    quoted = F.concat(F.lit('"'), "kind", F.lit('"'))
    value = (
        F.when(kind == 0, quoted).when(kind == 1, F.concat(F.lit("["), quoted, F.lit(',"x"]')))
        .when(kind == 2, F.col("size").cast("string")).otherwise("[]")
    )
    return sql(spark, folder, PARTS).select("k", first_text(F.parse_json(value)).alias("first"))


@query(
    "A10_response_shape",
    f"""SELECT source_id, run_id, 'CollectorError' AS error_type, 'Unexpected ' || CASE source_id % 3 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' ELSE 'lever' END
     || ' response shape' AS error_message FROM (SELECT DISTINCT source_id, 'run-' || CAST(source_id AS STRING) AS run_id FROM ({PARTS}) p)""",
)
def _(spark, folder):
    """Boards that answer with the other format's shape are failed runs, not empty boards."""
    bare = lever_landed(spark, folder).where("source_id % 3 <> 2")
    board = F.when(F.col("source_id") % 3 == 0, HOSTS["ashby"]).otherwise(HOSTS["greenhouse"])
    bare = bare.withColumn("source_url", F.concat(board, F.col("source_id").cast("string")))
    listed = ashby_landed(spark, folder).where("source_id % 3 = 2")
    listed = listed.withColumn("source_url", F.concat(F.lit(HOSTS["lever"]), F.col("source_id").cast("string")))
    return adapters.collect(bare.unionByName(listed)).failures.select("source_id", "run_id", "error_type", "error_message")


@query(
    "A11_rejects_per_run",
    f"""SELECT 'run-' || CAST(source_id AS STRING) AS run_id, CASE k % 50 WHEN 0 THEN 'no application URL' WHEN 1 THEN 'not an object' ELSE 'wrong field type' END AS reject_reason,
     count(*) AS rejected FROM ({PARTS}) p WHERE k % 50 IN (0, 1, 2) GROUP BY 1, 2""",
)
def _(spark, folder):
    rejects = adapters.collect(lever_landed(spark, folder)).rejects
    return rejects.groupBy("run_id", "reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "U1_all_adapters",
    f"""WITH parts AS ({PARTS}) SELECT 'ashby' AS ats_type, source_id, count(*) AS postings FROM parts WHERE k % 50 NOT IN (0, 1) GROUP BY source_id
    UNION ALL SELECT 'greenhouse', source_id, count(*) FROM parts WHERE k % 50 NOT IN (0, 1) GROUP BY source_id
    UNION ALL SELECT 'lever', source_id, count(*) FROM parts WHERE k % 50 NOT IN (0, 1, 2) GROUP BY source_id
    UNION ALL SELECT 'jsonld', source_id, count(*) FROM parts WHERE k % 50 <> 1 GROUP BY source_id""",
)
def _(spark, folder):
    rows = ashby_landed(spark, folder)
    for other in (greenhouse_landed, lever_landed, jsonld_landed):
        rows = rows.unionByName(other(spark, folder))
    return adapters.collect(rows).postings.groupBy("ats_type", "source_id").agg(F.count(F.lit(1)).alias("postings"))


PAGES_SQL = """pages_landed AS (SELECT CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
 CAST(2 * floor(extract(hour FROM ts) / 8.0) AS INT) AS skip, least(count(*), 2) AS page_items FROM events GROUP BY 1, 2)"""


@query(
    "A4_counted_pages",
    f"""WITH {PAGES_SQL}, ends AS (SELECT run_id, min(skip) FILTER (page_items < 2) AS last_skip FROM pages_landed GROUP BY run_id),
    kept AS (SELECT p.*, last_skip FROM pages_landed p JOIN ends USING (run_id) WHERE skip <= coalesce(last_skip, skip))
    SELECT run_id, count(*) AS pages, sum(page_items) AS items, max(skip) AS max_skip,
     last_skip IS NULL OR count(*) * 2 <> max(skip) + 2 AS truncated FROM kept GROUP BY run_id, last_skip""",
)
def _(spark, folder):
    pages = sql(spark, folder, f"SELECT * FROM ({PAGES_SQL.split(' AS ', 1)[1][1:-1]}) p")
    return adapters.page_summary(pages, page_size=2)


STATUS = "CASE page_id % 10 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 500 ELSE 200 END"


@query(
    "A12_fetch_outcome",
    f"""WITH p AS (SELECT page_id, url, {STATUS} AS status, strlen(html) AS bytes FROM pages)
    SELECT page_id, CASE WHEN status = 429 THEN 'RateLimitError' WHEN status IN (401, 403) THEN 'AccessDeniedError' WHEN status >= 400 OR bytes > 12000 THEN 'CollectorError' END AS error_type,
     CASE WHEN status = 429 THEN 'Rate limited by ' || url WHEN status IN (401, 403) THEN 'Access denied by ' || url || ': HTTP ' || CAST(status AS STRING)
      WHEN status >= 400 THEN 'Request to ' || url || ' failed with status ' || CAST(status AS STRING) WHEN bytes > 12000 THEN 'Response from ' || url || ' exceeded 12000 bytes' END AS error_message FROM p""",
)
def _(spark, folder):
    status, size = F.expr(STATUS), F.octet_length("html")
    return table(spark, folder, "pages").select(
        "page_id",
        landed.fetch_error_type(status, size, 12000).alias("error_type"),
        landed.fetch_error_message(F.col("url"), status, size, 12000).alias("error_message"),
    )


BOARD_URL = """CASE page_id % 6 WHEN 0 THEN 'https://jobs.ashbyhq.com/x' WHEN 1 THEN 'https://Boards.Greenhouse.io/x' WHEN 2 THEN 'https://job-boards.greenhouse.io/x'
 WHEN 3 THEN 'https://jobs.lever.co/x' ELSE url END"""
REQUESTED = "CASE page_id % 4 WHEN 0 THEN 'lever' WHEN 1 THEN 'workday' ELSE 'auto' END"


@query(
    "A13_adapter_routing",
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 < 2 THEN {REQUESTED} ELSE CASE page_id % 6 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse'
     WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'lever' ELSE 'jsonld' END END AS adapter FROM pages)
    SELECT page_id, adapter, CASE WHEN adapter = 'workday' THEN 'Unsupported collector adapter: workday' END AS error FROM p""",
)
def _(spark, folder):
    routed = table(spark, folder, "pages").select(
        "page_id", landed.routed_adapter(F.expr(BOARD_URL), F.expr(REQUESTED)).alias("adapter")
    )
    return routed.withColumn("error", landed.unsupported(F.col("adapter")))


@query(
    "A14_collect_url",
    """SELECT source_id, CASE WHEN source_id % 3 = 0 AND source_id % 2 = 0 THEN 'https://found.example.com/' || CAST(source_id AS STRING) ELSE url END AS collect_url FROM d2_sources""",
)
def _(spark, folder):
    rows = view(spark, folder, "d2_sources")
    status = F.when(F.col("source_id") % 3 == 0, "supported").when(F.col("source_id") % 3 == 1, "uncertain")
    found = F.when(F.col("source_id") % 2 == 0, F.concat(F.lit("https://found.example.com/"), F.col("source_id").cast("string")))
    return rows.select("source_id", landed.collect_url(F.col("url"), status, found).alias("collect_url"))


# One posting page in five, aggregator text in others, failed fetches in others.
PROBED_SQL = f"""probed AS (SELECT page_id, {BOARD_URL} AS final_url,
 CASE WHEN page_id % 5 = 4 THEN html || '<script type="application/ld+json">{{"a":[{{"@type":"JobPosting"}}]}}</script>'
  WHEN page_id % 7 = 4 THEN html || '<a href="https://cdn.getro.com/x">b</a>' ELSE html END AS html,
 CASE WHEN page_id % 11 = 3 THEN 'GET https://x/?token=abc timed out' END AS error FROM pages)"""
PROBE_RESULT = """CASE WHEN error IS NOT NULL THEN 'error' WHEN page_id % 6 < 4 OR page_id % 5 = 4 THEN 'supported' WHEN page_id % 7 = 4 THEN 'unsupported' ELSE 'uncertain' END AS status,
 CASE WHEN error IS NOT NULL THEN NULL WHEN page_id % 6 = 0 THEN 'ashby' WHEN page_id % 6 IN (1, 2) THEN 'greenhouse' WHEN page_id % 6 = 3 THEN 'lever'
  WHEN page_id % 5 = 4 THEN 'jsonld' ELSE 'unsupported' END AS adapter,
 CASE WHEN error IS NOT NULL THEN NULL WHEN page_id % 6 = 0 THEN 'ashby' WHEN page_id % 6 IN (1, 2) THEN 'greenhouse' WHEN page_id % 6 = 3 THEN 'lever'
  WHEN page_id % 5 = 4 THEN 'jsonld' WHEN page_id % 7 = 4 THEN 'getro' END AS detected_platform,
 CASE WHEN error IS NULL THEN final_url END AS detected_application_url, error"""


def probed_pages(spark, folder):
    return sql(spark, folder, f"SELECT * FROM ({PROBED_SQL.split(' AS ', 1)[1][1:-1]}) p")


@query("M16_platform_probe", f"WITH {PROBED_SQL} SELECT page_id, {PROBE_RESULT} FROM probed")
def _(spark, folder):
    return probe.probe(probed_pages(spark, folder)).select(
        "page_id", "status", "adapter", "detected_platform", "detected_application_url", "error"
    )


@query(
    "U2_aggregator_signatures",
    """SELECT page_id, CASE WHEN html LIKE '%data-%' THEN 'tagged' WHEN html LIKE '%/en/%' THEN 'english' END AS platform FROM pages""",
)
def _(spark, folder):
    marks = {"data-": "tagged", "/en/": "english"}
    return table(spark, folder, "pages").select(
        "page_id", probe.aggregator(F.lit(""), F.col("html"), marks).alias("platform")
    )


@query(
    "M17_probe_apply",
    f"""WITH {PROBED_SQL}, r AS (SELECT page_id, {PROBE_RESULT} FROM probed)
    SELECT source_id, CASE WHEN page_id IS NULL OR status = 'error' THEN s.adapter ELSE r.adapter END AS adapter,
     CASE WHEN page_id IS NULL OR status = 'error' THEN NULL ELSE r.detected_platform END AS detected_platform,
     r.detected_application_url, CASE WHEN page_id IS NULL THEN last_error WHEN status = 'error' THEN 'GET https://x/?token=[redacted] timed out' END AS last_error,
     status AS detection_status, CASE WHEN page_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS detected_at
    FROM d2_sources s LEFT JOIN r ON page_id = source_id AND category = 'vc_portfolio'""",
)
def _(spark, folder):
    sources = view(spark, folder, "d2_sources").withColumns(
        {c: F.lit(None).cast("string") for c in ("detected_platform", "detected_application_url", "detection_status")}
    ).withColumn("detected_at", F.lit(None).cast("timestamp_ntz"))
    results = probe.probe(probed_pages(spark, folder)).withColumn("source_id", F.col("page_id"))
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return probe.probe_applied(sources, results, as_of).select(
        "source_id", "adapter", "detected_platform", "detected_application_url", "last_error", "detection_status", "detected_at"
    )


@query(
    "P11_missing_url_guard",
    f"""SELECT 'run-' || CAST(source_id AS STRING) AS run_id, count(*) FILTER (k % 50 = 0) AS missing, count(*) FILTER (k % 50 = 0) > 0 AS failed FROM ({PARTS}) p GROUP BY source_id""",
)
def _(spark, folder):
    from tidepost.operators.upsert import runs_missing_url

    rows = sql(spark, folder, PARTS).select(
        F.concat(F.lit("run-"), F.col("source_id").cast("string")).alias("run_id"), F.col("apply_url").alias("application_url")
    )
    return runs_missing_url(rows)
