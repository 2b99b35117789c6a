"""Exact dedup by counting quotient filters.

A text's fingerprint is cut into a quotient, which names a place, and a remainder, which is kept there. Each partition
builds a filter of its fingerprints for each range of quotients: the quotients that occur, where the run of remainders of
each ends, and the remainders in order, with counts for those that occur more than once. Filters of one range merge by
their sorted remainders and lose nothing. Only texts whose fingerprint counts above one go on to be compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import only, whole
from tidepost.session import written

#: A range of quotients holds about so many fingerprints, whatever the input.
RANGE_ROWS = 1 << 20
REMAINDER_BITS = 40
_MASK = np.uint64((1 << REMAINDER_BITS) - 1)


def build(sorted_fingerprints: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of distinct sorted fingerprints (unsigned) with their counts."""
    quotient = sorted_fingerprints >> np.uint64(REMAINDER_BITS)
    occupied, runs = np.unique(quotient, return_counts=True)
    ends = np.zeros(len(quotient), bool)
    ends[np.cumsum(runs) - 1] = True
    remainder = np.ascontiguousarray((sorted_fingerprints & _MASK).astype("<u8")).view(np.uint8).reshape(-1, 8)
    many = np.flatnonzero(counts > 1)
    head = np.array([len(quotient), len(occupied), len(many)], "<u4")
    parts = (
        head,
        np.diff(occupied, prepend=np.uint64(0)).astype("<u4"),
        np.packbits(ends),
        np.ascontiguousarray(remainder[:, : REMAINDER_BITS // 8]),
        many.astype("<u4"),
        counts[many].astype("<u8"),
    )
    return b"".join(p.tobytes() for p in parts)


def opened(filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (sorted) and counts of a filter."""
    slots, quotients, many = np.frombuffer(filter_, "<u4", 3).tolist()
    at = 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(filter_, kind, count, at)
        at += part.nbytes
        return part

    occupied = np.cumsum(take("<u4", quotients).astype(np.uint64), dtype=np.uint64)
    ends = np.unpackbits(take("u1", -(-slots // 8)), count=slots).astype(bool)
    remainder = np.zeros((slots, 8), np.uint8)
    remainder[:, : REMAINDER_BITS // 8] = take("u1", slots * (REMAINDER_BITS // 8)).reshape(slots, -1)
    run = np.concatenate([[0], np.cumsum(ends)[:-1]]) if slots else np.zeros(0, np.int64)
    counts = np.ones(slots, np.int64)
    index = take("<u4", many)
    counts[index] = take("<u8", many)
    low = remainder.reshape(-1).view("<u8").astype(np.uint64)
    return (occupied[run] << np.uint64(REMAINDER_BITS)) | low, counts


def merged(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two filters' fingerprints as one, counts of equal ones added."""
    both, at = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    counts = np.zeros(len(both), np.int64)
    np.add.at(counts, at, np.concatenate([left[1], right[1]]))
    return both, counts


def filters(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(range, filter): one merged counting quotient filter for each range of quotients, about ``RANGE_ROWS`` rows each.

    ``fingerprints`` has one column of longs. Partitions send filters, not rows, so a fingerprint that a third of all
    rows share travels once from each partition.
    """
    # At least as many ranges as keep a range's filter small; two to some power, so that a range is the top bits.
    bits = max(4, (-(-rows // RANGE_ROWS)).bit_length() + 1)
    shift = np.uint64(64 - bits)
    name = fingerprints.columns[0]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(waiting[-1])
            if size >= RANGE_ROWS:
                yield parts(np.concatenate(waiting))
                waiting, size = [], 0
        if size:
            yield parts(np.concatenate(waiting))

    def parts(values: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(values, return_counts=True)
        ranges, starts = np.unique(values >> shift, return_index=True)
        ends = [*starts[1:].tolist(), len(values)]
        made = [build(values[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), pa.array(made, pa.binary())], ["part", "filter"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition's filters come sorted by range, so one range is open at a time.
        part, held = None, None
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != part:
                    if held is not None:
                        yield shut(part, held)
                    part, held = key, opened(blob)
                else:
                    held = merged(held, opened(blob))
        if held is not None:
            yield shut(part, held)

    def shut(part: int, held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([build(*held)], pa.binary())], ["part", "filter"])

    schema = "part long, filter binary"
    sent = fingerprints.select(F.col(name)).mapInArrow(local, schema)
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(joined, schema)


def repeated(merged_filters: DataFrame) -> DataFrame:
    """(fingerprint, seen): the fingerprints that count above one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                values, counts = opened(blob)
                many = counts > 1
                arrays = [pa.array(values[many].view(np.int64)), pa.array(counts[many], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["fingerprint", "seen"])

    return merged_filters.mapInArrow(run, "fingerprint long, seen long")


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", " ")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document.

    Texts are equal when their normalised bytes are; of equal texts the smallest doc_id stays (a null id only where there
    is no other). A doc_id that occurs twice with one text gives two rows that are both marked by that id. An empty table
    gives no rows.
    """
    cols = only(docs, doc_id=doc_id, text=text)
    norm = normalised(F.col("text"))
    marked = written(
        cols.select("doc_id", F.xxhash64(norm).alias("fingerprint"), F.sha2(norm.cast("binary"), 256).alias("text_sha256")),
        "exact",
    )
    suspects = written(repeated(filters(marked.select("fingerprint"), marked.count())), "suspects")
    # Byte verification: grouping by the text itself compares whole texts; copies meet inside their partition first.
    texts = cols.select("doc_id", norm.alias("norm")).withColumn("fingerprint", F.xxhash64("norm"))
    groups = (
        texts.join(suspects, "fingerprint", "left_semi")
        .groupBy("fingerprint", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > 1)
        .select("fingerprint", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    out = marked.join(written(groups, "equal"), ["fingerprint", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


DEDUP_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
