"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Each shard owns arcs that end at its virtual nodes. A key hashes to a cell and
belongs to the next virtual node clockwise; what a full shard cannot take continues clockwise to the next shard with
room. The cells' counts (their number is a parameter, not a matter of the data) decide on the driver how many keys of
each cell stay and where the others go; the keys themselves are ranked inside their cell by a window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidepost.llm.frames import free_name, only, whole
from tidepost.session import written


@dataclass(frozen=True)
class Ring:
    """``headroom`` 0 fills all shards alike (counts at most one apart); 0.25 lets a shard hold a quarter more than its part."""

    shards: int = 8
    virtual_nodes: int = 64
    headroom: float = 0.0
    cells: int = 1 << 16

    def owners(self) -> list[tuple[int, int]]:
        """(last cell, shard) of each arc, clockwise. A shard's virtual nodes do not depend on the other shards."""
        taken: dict[int, int] = {}
        for node in range(self.virtual_nodes):
            for shard in range(self.shards):
                mark = hashlib.sha256(f"shard {shard} node {node}".encode()).digest()
                taken.setdefault(int.from_bytes(mark[:8], "little") % self.cells, shard)
        return sorted(taken.items())

    def capacities(self, rows: int) -> list[int]:
        """What each shard may hold: together at least ``rows``."""
        total = max(rows, int(rows * (1 + self.headroom)))
        return [total // self.shards + (shard < total % self.shards) for shard in range(self.shards)]

    def deal(self, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
        """(cell, first rank, end rank, shard, slot of the first rank) for keys counted by cell.

        Keys stay at home as far as there is room, cells taken clockwise; what is left goes around, first in first out.
        """
        arcs = self.owners()
        ends = [cell for cell, _ in arcs]
        room = self.capacities(sum(counts.values()))
        filled = [0] * self.shards
        out: list[tuple[int, int, int, int, int]] = []

        def place(cell: int, low: int, high: int, shard: int) -> int:
            taken = min(high - low, room[shard] - filled[shard])
            if taken > 0:
                out.append((cell, low, low + taken, shard, filled[shard]))
                filled[shard] += taken
            return low + taken

        left: dict[int, deque[tuple[int, int, int]]] = {}
        for cell in sorted(counts):
            arc = bisect_left(ends, cell) % len(arcs)
            low = place(cell, 0, counts[cell], arcs[arc][1])
            if low < counts[cell]:
                left.setdefault(arc, deque()).append((cell, low, counts[cell]))
        going: deque[tuple[int, int, int]] = deque()
        for step in range(2 * len(arcs)):
            arc = step % len(arcs)
            going.extend(left.pop(arc, ()))
            while going and filled[arcs[arc][1]] < room[arcs[arc][1]]:
                cell, low, high = going.popleft()
                low = place(cell, low, high, arcs[arc][1])
                if low < high:
                    going.appendleft((cell, low, high))
        return out


DEALT = T.StructType(
    [T.StructField("cell", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("low", "high")]]
    + [T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]
)


def assign(df: DataFrame, key: str, ring: Ring, order: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    A row's place on the ring depends on its key alone; which rows of a cell overflow depends on the hash, then the key,
    then the columns ``order``, so rows that tie in all of them are alike. A null key has a place like any other, an
    empty table gives no rows. Put few and small columns in: the rows are written once and shuffled by cell.
    """
    spark = df.sparkSession
    place, cell, rank = (free_name(df, n) for n in ("ring_place", "ring_cell", "ring_rank"))
    placed = df.withColumn(place, F.xxhash64(df[f"`{key}`"]))
    bits = ring.cells.bit_length() - 1
    placed = written(placed.withColumn(cell, F.shiftrightunsigned(place, 64 - bits).cast("int")), "ring")
    counted = placed.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ring.cells rows
    dealt = spark.createDataFrame(ring.deal({r[0]: r[1] for r in counted}), DEALT)
    by = Window.partitionBy(cell).orderBy(place, key, *(order or []))
    ranked = placed.withColumn(rank, F.row_number().over(by) - 1)
    joined = ranked.join(
        dealt, (F.col(cell) == dealt.cell) & (F.col(rank) >= dealt.low) & (F.col(rank) < dealt.high)
    )
    return joined.select(
        *[ranked[f"`{c}`"] for c in df.columns], dealt.shard, (dealt.base + F.col(rank) - dealt.low).alias("slot")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null as none, plus 1) and CRC-32 of the text."""
    text = whole(F.col("text"))
    return only(docs, doc_id="doc_id", text="text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, ring: Ring | None = None) -> DataFrame:
    """Documents dealt into shards whose counts are at most one apart (law ``rows``)."""
    dealt = assign(document_sizes(docs), "doc_id", ring or Ring(), ["text_crc32", "size"])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
