"""The registry: its tables, their columns, and versions of them on disk.

On disk a table is cut into buckets by a hash of the column its rows are looked up by. A version writes the buckets that a
batch touches and nothing else: files are never changed, and a version's list of parts says which of them are its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.session import exists, names_in, removed, written
from tidepost.sources.landed import LANDED_PARTS

SNAPSHOT = (
    "struct<application_url:string,ats_type:string,company_name:string,compensation_max:int,"
    "compensation_min:int,currency:string,department:string,description_html:string,"
    "description_text:string,employment_type:string,external_job_id:string,location:string,"
    "published_at:string,remote_type:string,title:string>"
)
SCHEMAS = {
    "sources": "user_id string, source_id string, name string, url string, category string, "
    "portfolio_firm string, adapter string, enabled boolean, priority int, frequency string, notes string, "
    "last_error string, last_attempt_at timestamp, last_success_at timestamp, last_job_count bigint, "
    "consecutive_failures bigint, detected_platform string, detected_application_url string, "
    "detection_status string, detected_at timestamp",
    "runs": "user_id string, source_id string, run_id string, status string, started_at timestamp, "
    "completed_at timestamp, jobs_found bigint, jobs_created bigint, jobs_updated bigint, "
    "jobs_rejected bigint, error_type string, error_message string, complete boolean",
    "companies": "user_id string, company_id string, company_name string, normalized_name string",
    "jobs": "user_id string, job_id string, company_id string, title string, normalized_title string, "
    "description_text string, description_html string, department string, location string, "
    "remote_type string, employment_type string, compensation_min int, compensation_max int, "
    "currency string, application_url string, canonical_url string, ats_type string, "
    "external_job_id string, published_at timestamp, fingerprint string, content_hash string, "
    "raw_payload variant, first_seen_at timestamp, last_seen_at timestamp, status string, "
    "removed_at timestamp, merged_into_job_id string, reposted_from_job_id string, user_decision string",
    "links": "user_id string, job_id string, source_id string, origin_job_id string, source_job_url string, "
    "first_seen_at timestamp, last_seen_at timestamp, is_active boolean, removed_at timestamp",
    "versions": f"user_id string, job_id string, content_hash string, origin_job_id string, material_hash string, "
    f"seen_at timestamp, snapshot {SNAPSHOT}, is_material boolean",
    "candidates": "user_id string, candidate_id string, job_id string, candidate_job_id string, "
    "similarity_score double, company_score double, title_score double, location_score double, "
    "status string, created_at timestamp, resolved_at timestamp, kept_job_id string, merged_job_id string",
    "moves": "user_id string, candidate_id string, kind string, origin_job_id string, moved_key string",
    "events": "user_id string, event_type string, entity_type string, entity_id string, "
    "message string, data string, created_at timestamp",
}


#: What tells the rows of a table apart that a batch may replace; the other tables only grow.
ROW_KEYS = {
    "sources": ["user_id", "source_id"],
    "jobs": ["user_id", "job_id"],
    "links": ["user_id", "job_id", "source_id"],
    "candidates": ["user_id", "candidate_id"],
}
#: The column whose hash is a row's bucket.
BUCKETED_BY = {
    "sources": "source_id", "runs": "run_id", "companies": "normalized_name", "jobs": "job_id", "links": "job_id",
    "versions": "job_id", "candidates": "candidate_id", "moves": "candidate_id", "events": "entity_id",
}
#: Buckets of a new folder, and parts of a bucket of a growing table from which they are written as one.
BUCKETS, CROWDED = 32, 8


@dataclass(frozen=True)
class Registry:
    """All tables of the registry; operators take one and return the next."""

    sources: DataFrame
    runs: DataFrame
    companies: DataFrame
    jobs: DataFrame
    links: DataFrame
    versions: DataFrame
    candidates: DataFrame
    moves: DataFrame
    events: DataFrame

    def changed(self, **tables: DataFrame) -> Registry:
        return Registry(**{name: tables.get(name, getattr(self, name)) for name in SCHEMAS})

    def near(self, table: str, ids: DataFrame) -> DataFrame:
        """The rows of a table that belong to ``ids``, a frame of the column its buckets go by."""
        return getattr(self, table).join(ids, BUCKETED_BY[table], "left_semi")


@dataclass(frozen=True)
class StoredRegistry(Registry):
    """A version on disk: what is near some ids is looked for in their buckets alone."""

    store: Store

    def near(self, table: str, ids: DataFrame) -> DataFrame:
        touched = buckets_of(ids, BUCKETED_BY[table], self.store.buckets)
        return self.store.read(ids.sparkSession, table, touched).join(ids, BUCKETED_BY[table], "left_semi")


@dataclass(frozen=True)
class Changes:
    """What a batch does to the registry: rows that take the place of those with their key, and rows that are added."""

    replaced: dict[str, DataFrame] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)

    def applied(self, registry: Registry) -> Registry:
        after = {}
        for name, rows in self.replaced.items():
            keys = ROW_KEYS[name]
            left = getattr(registry, name).join(rows.select(*keys), keys, "left_anti")
            after[name] = left.unionByName(rows)
        for name, rows in self.added.items():
            after[name] = getattr(registry, name).unionByName(rows)
        return registry.changed(**after)


def empty_registry(spark: SparkSession) -> Registry:
    return Registry(**{name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()})


def bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")


def buckets_of(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """The buckets that hold these rows: no more numbers than there are buckets."""
    return sorted(r[0] for r in rows.select(bucket(column, buckets)).distinct().collect())


MARK = "version int, stream string, batch bigint, buckets int"
PARTS = "table string, bucket int, version int"


@dataclass(frozen=True)
class Store:
    """The live parts of one version: for each table the (bucket, version) folders that hold its rows."""

    folder: str
    buckets: int
    parts: dict[str, list[tuple[int, int]]]

    def paths(self, table: str, among: Iterable[int] | None = None) -> list[str]:
        wanted = None if among is None else set(among)
        return [
            f"{self.folder}/{table}/v={version}/bucket={number}"
            for number, version in self.parts.get(table, [])
            if wanted is None or number in wanted
        ]

    def read(self, spark: SparkSession, table: str, among: Iterable[int] | None = None) -> DataFrame:
        paths = self.paths(table, among)
        if not paths:
            return spark.createDataFrame([], SCHEMAS[table])
        return spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def _put(self, rows: DataFrame, table: str, version: int) -> list[tuple[int, int]]:
        """Writes rows to this version's folder of a table, which an attempt that failed may have left; the parts made."""
        path = f"{self.folder}/{table}/v={version}"
        rows = rows.withColumn("bucket", bucket(BUCKETED_BY[table], self.buckets))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        found = [n for n in names_in(rows.sparkSession, path) if n.startswith("bucket=")]
        return sorted((int(n.removeprefix("bucket=")), version) for n in found)

    def with_changes(self, spark: SparkSession, changes: Changes, version: int) -> Store:
        """Writes what changes, and whole only the buckets with rows that are replaced, or with many small parts."""
        parts = dict(self.parts)
        for table, rows in changes.replaced.items():
            # Whole rows move once, into their buckets; what they replace is told by their keys.
            keys = ROW_KEYS[table]
            ids = written(rows.select(*keys), table)
            touched = buckets_of(ids, BUCKETED_BY[table], self.buckets)
            left = self.read(spark, table, touched).join(ids, keys, "left_anti")
            made = self._put(left.unionByName(rows), table, version)
            parts[table] = [p for p in parts.get(table, []) if p[0] not in touched] + made
        for table, rows in changes.added.items():
            numbers = [p[0] for p in parts.get(table, [])]
            full = {n for n in numbers if numbers.count(n) >= CROWDED}
            made = self._put(rows.unionByName(self.read(spark, table, full)), table, version)
            parts[table] = [p for p in parts.get(table, []) if p[0] not in full] + made
        return Store(self.folder, self.buckets, parts)


def _commit(
    spark: SparkSession, store: Store, version: int, stream: str, batch: int, held: DataFrame | None
) -> None:
    """A version counts once its mark stands, which is written last and names the stream and batch that made it."""
    if held is not None:
        held.write.mode("overwrite").parquet(f"{store.folder}/held/v{version}")
    rows = [(t, b, v) for t, parts in store.parts.items() for b, v in parts]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.mode("overwrite").parquet(f"{store.folder}/parts/v{version}")
    spark.createDataFrame([(version, stream, batch, store.buckets)], MARK).coalesce(1).write.mode("overwrite").parquet(
        f"{store.folder}/committed/v{version}"
    )


def write_registry(
    registry: Registry, folder: str, version: int, stream: str = "", batch: int = -1, held: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Writes all tables whole as one version. ``held`` are landed rows of runs that go on."""
    spark = registry.jobs.sparkSession
    store = Store(folder, buckets, {})
    tables = {name: getattr(registry, name) for name in SCHEMAS}
    _commit(spark, store.with_changes(spark, Changes(added=tables), version), version, stream, batch, held)


def write_changes(
    changes: Changes, before: Registry | None, folder: str, version: int, stream: str = "", batch: int = -1,
    held: DataFrame | None = None, buckets: int = BUCKETS,
) -> None:
    """Writes the version that ``changes`` make of ``before``, a stored registry or none in a new folder."""
    spark = next(iter((changes.replaced | changes.added).values())).sparkSession
    store = before.store if isinstance(before, StoredRegistry) else Store(folder, buckets, {})
    _commit(spark, store.with_changes(spark, changes, version), version, stream, batch, held)


def read_registry(spark: SparkSession, folder: str, version: int) -> StoredRegistry:
    buckets = spark.read.schema(MARK).parquet(f"{folder}/committed/v{version}").first()["buckets"]
    parts: dict[str, list[tuple[int, int]]] = {}
    # As many rows as parts: buckets of each table, times the parts of a bucket.
    for row in spark.read.schema(PARTS).parquet(f"{folder}/parts/v{version}").collect():
        parts.setdefault(row["table"], []).append((row["bucket"], row["version"]))
    store = Store(folder, buckets, {t: sorted(p) for t, p in parts.items()})
    return StoredRegistry(**{name: store.read(spark, name) for name in SCHEMAS}, store=store)


def read_held(spark: SparkSession, folder: str, version: int | None) -> DataFrame:
    """Landed rows a version holds back until their runs are whole."""
    path = f"{folder}/held/v{version}"
    if version is None or not exists(spark, path):
        return spark.createDataFrame([], LANDED_PARTS)
    return spark.read.schema(LANDED_PARTS).parquet(path)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The marks of complete versions."""
    if not exists(spark, f"{folder}/committed"):
        return spark.createDataFrame([], MARK)
    return spark.read.schema(MARK).parquet(f"{folder}/committed/*")


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version, none for a new folder."""
    return committed(spark, folder).agg({"version": "max"}).first()[0]


def forget(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes the parts that none of the newest ``keep`` versions reads; how many folders went.

    Readers of those versions go on; marks stay, so that a replayed batch is still known. For one writer's folder, between
    its batches: parts of a version that is being written belong to no mark yet.
    """
    versions = sorted(r["version"] for r in committed(spark, folder).select("version").collect())[-max(keep, 1) :]
    live = {p for v in versions for r in [read_registry(spark, folder, v).store] for t in SCHEMAS for p in r.paths(t)}
    gone = 0
    for table in SCHEMAS:
        base = f"{folder}/{table}"
        for version in names_in(spark, base):
            for name in names_in(spark, f"{base}/{version}"):
                if name.startswith("bucket=") and f"{base}/{version}/{name}" not in live:
                    gone += removed(spark, f"{base}/{version}/{name}")
    return gone
