"""Web archives on Spark: written, read back, and cleared of payloads that stand in them more than once.

An archive is a folder of gzip files whose records end in two line ends, so Spark's text sink and source write and read
them with that as their separator: tasks commit whole files, and a gzip file is never split. Inside a task records are cut
by their declared length, not by the separator, so a payload may hold anything.

Revisit resolution shuffles headers only: by payload digest, to choose the response of each payload, and by record id, to
find what a revisit refers to. Payloads move once, by record id, which no two records share, to get their fresh headers.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.llm.frames import only, whole
from tidepost.session import shared_folder, written

END = "\r\n"
BETWEEN = END + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE = "application/http;msgtype=response"
#: Smaller payloads are not worth a revisit record.
LEAST_BYTES = 1000
#: Bytes of records that a task gathers before it sends them on.
SENT_BYTES = 8 << 20

HEAD = "record_id string, kind string, uri string, date string, page_id long, refers_to string, content string, http string, payload_bytes long, payload_digest string, identity binary"
RECORD = HEAD + ", payload binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


class Broken(ValueError):
    """An archive file that does not consist of whole records."""


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None


def parsed(head: bytes, block: bytes, payloads: bool) -> tuple:
    """One record as the fields of ``RECORD``. The payload of a record with an HTTP head is what stands behind that."""
    lines = head.decode("utf-8", "replace").split(END)
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    kind, http, payload = fields.get("warc-type"), None, block
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        front, _, payload = block.partition(BETWEEN.encode())
        http = front.decode("latin-1")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = identity = None
    if kind != "revisit":
        digest, size, identity = hashlib.sha1(payload).hexdigest(), len(payload), hashlib.sha256(payload).digest()
    ids = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), _number(fields.get("x-page-id")))
    return (*ids, fields.get("warc-refers-to"), fields.get("content-type"), http, size, digest, identity, payload if payloads else None)


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    gap = BETWEEN.encode()
    file, held = None, bytearray()
    rows: list[tuple] = []
    size = 0

    def sent() -> pa.RecordBatch:
        kinds = [_KINDS[x.split()[1]] for x in RECORD.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    def closed() -> None:
        if held.strip(b"\r\n"):
            raise Broken(f"{file}: the last record is cut off")
        held.clear()

    length = front = None
    for batch in batches:
        for name, start, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if start:
                raise Broken(f"{name}: read in parts; archives are to be compressed")
            if name != file:
                closed()
                file, length = name, None
            held += chunk.as_buffer()
            held += gap
            while True:
                if length is None:
                    while held.startswith(b"\r\n"):
                        del held[:2]
                    if (front := held.find(gap)) < 0 or not held.startswith(b"WARC/"):
                        if held:
                            raise Broken(f"{file}: no record begins where one should")
                        break
                    declared = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", held[:front])
                    if not declared:
                        raise Broken(f"{file}: a record without length")
                    length = int(declared[1])
                if len(held) < front + len(gap) + length + len(gap):
                    break
                at = front + len(gap)
                row = parsed(bytes(held[:front]), bytes(held[at : at + length]), payloads)
                del held[: at + length + len(gap)]
                length = None
                rows.append(row)
                size += len(row[-1] or b"") + 300
                if size > SENT_BYTES:
                    yield sent()
                    rows, size = [], 0
    closed()
    yield sent()


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive as ``RECORD``; ``payload`` is null unless wanted. Sizes and digests (SHA-1, and SHA-256 as
    ``identity``) are those of the payload as read; a revisit has the digest that its header states. A file that does not
    consist of whole records fails."""
    chunks = spark.read.option("lineSep", BETWEEN).text(folder)
    chunks = chunks.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")
    )
    return chunks.mapInArrow(lambda batches: _records(batches, payloads), RECORD)


def _field(name: str, value: Column) -> Column:
    """A header line, left out where there is no value; line ends inside a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), safe))


def _record(kind: str, refers: dict[str, Column]) -> Column:
    """A record with fresh headers from the columns of ``RECORD``. A revisit ends with the HTTP head."""
    c = F.col
    block = F.when(c("http").isNotNull(), F.concat(c("http"), F.lit(BETWEEN))).otherwise("")
    if kind != "revisit":
        block = F.concat(block, c("payload").cast("string"))
    lines = [
        F.lit("WARC/1.1"),
        _field("WARC-Type", c("kind") if kind == "any" else F.lit(kind)),
        _field("WARC-Record-ID", c("record_id")),
        _field("WARC-Date", c("date")),
        _field("WARC-Target-URI", c("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        *[_field(name, value) for name, value in refers.items()],
        _field("X-Page-Id", c("page_id").cast("string")),
        _field("Content-Type", c("content")),
        _field("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(BETWEEN), block).alias("value")


def _written(records: DataFrame, folder: str) -> None:
    """Compression is most of an archive's work: the fastest level, which takes about a tenth more room."""
    out = records.select("value").write.option("lineSep", BETWEEN).option("compression", "gzip")
    out.option("zlib.compress.level", "BEST_SPEED").text(folder)


def capture(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", payload: str = "html"
) -> None:
    """Writes each row of ``pages`` as a response. Pages have no time of their own, so ``date`` is an argument.

    Record ids are hashes of the row and its place; once written they stay, whatever the table's files do."""
    rows = only(pages, page_id=page_id, uri=url, payload=payload).select(
        F.col("page_id").cast("long").alias("page_id"), "uri", whole(F.col("payload")).alias("payload")
    )
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    number = F.md5(F.to_json(F.struct("page_id", "uri", "payload_digest", F.monotonically_increasing_id().alias("row"))))
    uuid = F.regexp_replace(number, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size)
    rows = rows.withColumns({"record_id": uuid, "kind": F.lit("response"), "date": F.lit(date), "content": F.lit(RESPONSE), "http": http})
    _written(rows.select(_record("any", {})), folder)


def resolved(heads: DataFrame) -> DataFrame:
    """``heads`` with ``origin`` (record_id, page_id) of revisits and the size, digest and identity of what they refer to.

    Revisits of which the response is missing keep what their header says and have no origin."""
    heads = heads.drop("payload")
    found = heads.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"),
        F.struct(F.col("record_id").alias("record_id"), F.col("page_id").alias("page_id")).alias("origin"),
        F.struct("payload_bytes", "payload_digest", "identity").alias("of"),
    )
    revisits = heads.filter("kind = 'revisit'").join(found, "refers_to", "left")
    stated = [F.coalesce(F.col(f"of.{c}"), F.col(c)).alias(c) for c in ("payload_bytes", "payload_digest", "identity")]
    keep = [c for c in heads.columns if c not in ("payload_bytes", "payload_digest", "identity")]
    rest = heads.filter("kind is null or kind <> 'revisit'").withColumn("origin", F.lit(None).cast("struct<record_id:string,page_id:bigint>"))
    return revisits.select(*keep, *stated, "origin").unionByName(rest)


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes the archive ``source`` anew: of records with equal payloads of at least ``least_bytes`` bytes the one with the
    largest page id (then record id) is a response, the others revisit it; everything else keeps its kind.

    Payloads are equal when their SHA-256 is. Revisits of the source count with the payload of their response, so the
    largest of a payload's records can take over from an older response; those without one are written as they are.
    """
    heads = written(resolved(read(spark, source, payloads=False)), "heads")
    known = heads.filter("kind in ('response', 'revisit') and identity is not null").filter(F.col("payload_bytes") >= least_bytes)
    fields = ["record_id", "uri", "date", "page_id", "content", "http"]
    winner = F.max_by(F.struct(*fields), F.struct("page_id", "record_id")).alias("winner")
    holder = F.min(F.when(F.col("kind") == "response", F.col("record_id"))).alias("holder")
    groups = written(known.groupBy("identity").agg(winner, holder, F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many"), "groups")
    members = known.join(groups, "identity")
    # Revisits are made of headers alone.
    again = members.filter(F.col("record_id") != F.col("winner.record_id"))
    refers = {
        "WARC-Profile": F.lit(PROFILE),
        "WARC-Refers-To": F.col("winner.record_id"),
        "WARC-Refers-To-Target-URI": F.col("winner.uri"),
        "WARC-Refers-To-Date": F.col("winner.date"),
    }
    lost = heads.filter("kind = 'revisit' and identity is null")
    lost = lost.select(_record("revisit", {"WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": F.col("refers_to")}))
    small = heads.filter(F.col("kind") == "revisit").filter(F.col("payload_bytes") < least_bytes)
    small = small.select(_record("revisit", {"WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": F.col("refers_to")}))
    # The response of a group is written from the payload of one holder under the winner's headers.
    parts = members.filter("kind = 'response'").select(
        "record_id", F.when(F.col("record_id") == F.col("holder"), F.col("winner")).alias("winner"), F.lit(True).alias("grouped")
    )
    records = read(spark, source).filter("kind is null or kind <> 'revisit'").join(written(parts, "parts"), "record_id", "left")
    records = records.filter("grouped is null or winner is not null")
    fresh = {f: F.when(F.col("grouped"), F.col(f"winner.{f}")).otherwise(F.col(f)) for f in fields}
    records = records.withColumns(fresh).select(_record("any", {}))
    _written(records.unionByName(again.select(_record("revisit", refers))).unionByName(lost).unionByName(small), target)


def digest(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit, the latter with size
    and digest of the response it leads to."""
    rows = resolved(records).filter("kind in ('response', 'revisit')")
    return rows.select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("origin.page_id").alias("refers_to")
    )


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``digest`` of the deduplicated archive of ``pages``, one row a page, read back from the files in the shared folder.

    A null payload is empty; payloads under 1000 bytes are all responses. Repeated rows are records of their own: one of
    them is the response, the others revisit it under the same page id. A page without id yields to any with one; a page
    without address has no such header. Extra columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/tidepost/archive-{uuid.uuid4().hex}"
    capture(pages, f"{folder}/captured", page_id=page_id, url=url, payload=payload)
    deduplicate(spark, f"{folder}/captured", f"{folder}/deduplicated")
    return digest(written(read(spark, f"{folder}/deduplicated", payloads=False), "heads"))


ARCHIVED_SQL = f"""
WITH p AS (
    SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), r AS (
    SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, row) AS place,
           first(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, row) AS best
    FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND place > 1 THEN best END AS refers_to
FROM r
"""
