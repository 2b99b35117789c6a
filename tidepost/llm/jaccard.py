"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Texts with one set of n-grams form a class, and classes are what is joined. Classes that share a band meet in a bucket.
A class's home is the smallest class that a bucket or two lead to, so a large group of near copies has one home, and pairs of
homes that share a bucket are few. The classes of a home (and of two homes that share a bucket) are compared in blocks of
bounded size inside tasks, every pair on its full sets; tasks send one row a class, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.components import components
from tidepost.llm.frames import free_name, only, whole
from tidepost.llm.words import constants, mixed, sets_of
from tidepost.session import written

#: A block has about so many classes, or so many n-grams, whichever is reached first.
BLOCK_CLASSES, BLOCK_GRAMS = 256, 1 << 20
#: A class's home is the smallest class within so many buckets. More hops leave fewer pairs of homes that share a bucket.
HOPS = 2


@dataclass(frozen=True)
class Bands:
    count: int
    rows: int

    @staticmethod
    def for_recall(similarity: float, recall: float, most: int = 128) -> Bands:
        """The longest bands (fewest needless candidates) that find a pair at ``similarity`` with probability ``recall`` by
        at most ``most`` hash functions; the recall of pairs more alike is higher."""
        best = Bands(most, 1)
        for rows in range(1, most + 1):
            count = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
            if count * rows > most:
                break
            best = Bands(count, rows)
        return best


@dataclass(frozen=True)
class Join:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9995

    @property
    def bands(self) -> Bands:
        return Bands.for_recall(self.similarity, self.recall)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


class Signer:
    """MinHash bands of a set of 64-bit hashes."""

    def __init__(self, bands: Bands) -> None:
        functions = bands.count * bands.rows
        self.bands = bands
        self.factors = (constants(21, functions) >> np.uint64(20)).astype(np.uint32) | np.uint32(1)
        self.turns = (constants(22, functions) >> np.uint64(13)).astype(np.uint32)
        self.joiners = constants(23, bands.rows)
        self.places = constants(24, bands.count)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), 2048):
            np.minimum(least, ((short[i : i + 2048, None] ^ self.turns) * self.factors).min(axis=0), out=least)
        rows = least.reshape(self.bands.count, self.bands.rows).astype(np.uint64)
        return mixed((rows * self.joiners).sum(axis=1, dtype=np.uint64) + self.places)


def marked(docs: DataFrame, how: Join) -> DataFrame:
    """(key, doc_id, class, grams, bands) of (key, doc_id, text): class is a hash of the whole set, grams its size."""
    signer, size = Signer(how.bands), how.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = constants(25, 1)
        for batch in batches:
            classes, counts, bands = [], [], []
            for grams in sets_of(batch.column(2), size):
                classes.append(mixed(grams * seeds).sum(dtype=np.uint64))
                counts.append(len(grams))
                bands.append(signed(signer.sign(grams)) if len(grams) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, bands)])
            flat = np.concatenate([np.zeros(0, np.int64), *bands])
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array(signed(np.array(classes, np.uint64))),
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "class", "grams", "bands"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, class long, grams long, bands array<long>")


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of ``left`` are at least so similar to which of ``right`` (None: to later ones of ``left``)."""
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    rows, number = rows[shared], np.cumsum(new[shared]) - 1
    cut = len(left)
    common = np.zeros((cut, len(sets) - cut if right is not None else cut), np.float32)
    # The columns of the incidence matrix in strips, so that memory does not depend on the sets.
    width = 4096
    bounds = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + 1 + width, width))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        strip = np.zeros((len(sets), width), np.float32)
        strip[rows[a:b], number[a:b] - i * width] = 1
        common += strip[:cut] @ strip[cut:].T if right is not None else strip @ strip.T
    one, other = sizes[:cut, None], (sizes[cut:] if right is not None else sizes)[None, :]
    alike = common >= similarity * (one + other - common) - 1e-6
    return np.triu(alike, 1) if right is None else alike


def roots(count: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes the smallest node of its component, given the links (rows of two nodes)."""
    root = np.arange(count)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def verified(tasks: DataFrame, how: Join) -> DataFrame:
    """(class, links, root) from (task, side, class, size, text), sorted by task and side inside partitions.

    Side 0 meets side 1; side 2 stands for both. ``links`` counts the documents of linked classes, ``root`` is a class that
    the class is connected to inside its task. Classes without link send nothing.
    """
    words, similarity = how.words, how.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, task = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for row, grams in zip(zip(*columns, strict=True), sets_of(batch.column(4), words), strict=True):
                if row[0] != task:
                    if open_:
                        yield from done(open_)
                    open_, task = [], row[0]
                open_.append((*row, grams))
        if open_:
            yield from done(open_)

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # A row that the table holds twice is one member of its class.
        rows = list({(r[1], r[2]): r for r in rows}.values())
        left = [i for i, r in enumerate(rows) if r[1] != 1]
        right = [i for i, r in enumerate(rows) if r[1] == 1]
        both = rows[0][1] == 2
        if len(left) < 2 if both else not (left and right):
            return
        grams = [r[4] for r in rows]
        alike = compare([grams[i] for i in left], None if both else [grams[i] for i in right], similarity)
        i, j = np.nonzero(alike)
        if not len(i):
            return
        pairs = np.stack([np.array(left)[i], np.array(left if both else right)[j]], axis=1)
        size = np.array([r[3] for r in rows], np.int64)
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, pairs[:, 0], size[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], size[pairs[:, 0]])
        root, name = roots(len(rows), pairs), np.array([r[2] for r in rows], np.int64)
        used = links > 0
        arrays = [pa.array(name[used]), pa.array(links[used]), pa.array(name[root][used])]
        yield pa.RecordBatch.from_arrays(arrays, ["class", "links", "root"])

    return tasks.mapInArrow(run, "class long, links long, root long")


def similar(docs: DataFrame, how: Join | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (key, doc_id, class, grams, group, links) and the groups (group, doc_id, key of the one to keep).

    ``links`` is the number of other documents whose n-gram sets are at least ``how.similarity`` alike, ``group`` names the
    connected component. Words are what stands between ASCII white space; a text of fewer words than ``how.words`` has one
    n-gram, of all its words. A text without words is alike to nothing: its group is null and it has no links. Repeated
    rows are documents of their own; a null doc_id takes part like any other. ``key`` is a hash of id and text.
    """
    how = how or Join()
    cols = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = cols.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", whole(F.col("text")).alias("text"))
    signed_ = written(marked(keyed, how), "signed")
    real = signed_.filter("grams > 0")
    # One row a class; copies meet inside their partition first.
    classes = real.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("key", "grams", "bands")).alias("one"))
    classes = written(classes.select("class", "size", "one.key", "one.grams", "one.bands"), "classes")

    banded = classes.select("class", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = written(banded.join(buckets, "band"), "members")
    homes = members.groupBy("class").agg(F.min("least").alias("home"))
    for _ in range(HOPS - 1):
        # The smallest home that a bucket knows becomes the home of all its classes.
        known_ = members.select("band", "class").join(homes, "class")
        nearest = known_.groupBy("band").agg(F.min("home").alias("home"))
        homes = members.select("band", "class").join(nearest, "band").groupBy("class").agg(F.min("home").alias("home"))
    facts = classes.select("class", "size", "key", "grams")
    homes = written(homes.join(facts, "class"), "homes")
    blocks = homes.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("grams"))
    blocks = blocks.select(
        "home", "n", F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    blocks = written(blocks, "blocks")
    met = members.join(homes.select("class", "home"), "class").select("band", "home").distinct()
    several = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    met = met.join(several, "band", "left_semi")
    pairs = met.alias("x").join(met.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.home") < F.col("y.home")))
    pairs = pairs.select(F.col("x.home").alias("one"), F.col("y.home").alias("other")).distinct()

    own = blocks.filter("n > 1").select("home", F.col("home").alias("one"), F.col("home").alias("other"), "blocks", F.col("blocks").alias("across"), F.lit(2).alias("side"))
    across = lambda mine, theirs, side: pairs.join(
        blocks.select(F.col("home").alias(theirs), F.col("blocks").alias("across")), theirs
    ).join(blocks.select(F.col("home").alias(mine), "blocks"), mine).select(F.col(mine).alias("home"), "one", "other", "blocks", "across", F.lit(side).alias("side"))
    meetings = written(own.union(across("one", "other", 0)).union(across("other", "one", 1)), "meetings")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    tasks = homes.select("class", "key", "size", "home").join(meetings, "home").withColumn("block", block)
    tasks = tasks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    first = F.when(F.col("side") == 1, F.col("with")).when(F.col("side") == 0, F.col("block")).otherwise(F.least("block", "with"))
    second = F.when(F.col("side") == 1, F.col("block")).when(F.col("side") == 0, F.col("with")).otherwise(F.greatest("block", "with"))
    side = F.when((F.col("side") < 2) | (F.col("block") == F.col("with")), F.col("side")).otherwise((F.col("block") > F.col("with")).cast("int"))
    tasks = tasks.select(F.xxhash64("one", "other", first, second).alias("task"), side.alias("side"), "class", "size", "key")
    # A row that the table holds many times is one text here: merged inside the partitions first, then met once a task.
    texts = keyed.select("key", "text").join(tasks.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    ready = tasks.join(texts, "key").select("task", "side", "class", "size", "text")
    found = written(verified(ready.repartition("task").sortWithinPartitions("task", "side"), how), "verified")

    root = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    root = root.withColumnRenamed("node", "class").withColumnRenamed("root", "group")
    known = written(facts.join(linked, "class", "left").join(root, "class", "left").select(
        "class", F.coalesce("group", "class").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")
    ), "known")
    plain = signed_.select("key", "doc_id", "class", "grams")
    out = plain.filter("grams > 0").join(known, "class").select("key", "doc_id", "class", "grams", "group", "links")
    empty = plain.filter("grams = 0").select("key", "doc_id", "class", "grams", F.lit(None).cast("long"), F.lit(0).cast("long"))
    members_ = written(out.unionAll(empty), "similar")
    best = members_.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    return members_, written(best.select("group", "best.doc_id", "best.key"), "kept")


def join(docs: DataFrame, how: Join | None = None) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group) and links of every document.

    A text without words is a class of its own.
    """
    members, groups = similar(docs, how)
    named = groups.select("group", F.col("doc_id").alias("class_id"))
    return members.join(named, "group", "left").select(
        "doc_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "links"
    )


def keep_one(docs: DataFrame, how: Join | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest doc_id. Texts without words are near
    copies of equal texts only (null is a text of its own)."""
    key = free_name(docs, "jaccard_key")
    members, groups = similar(docs, how, doc_id, text)
    rows = members.filter("group is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    best = groups.select("key").join(rows, "key")
    wordless = members.filter("group is null").select("key").distinct()
    keyed = docs.withColumn(key, F.xxhash64(docs[f"`{doc_id}`"].cast("long"), docs[f"`{text}`"]))
    bare = keyed.join(wordless.withColumnRenamed("key", key), key, "left_semi")
    first = F.min(F.struct(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`").alias("id"), F.col(key).alias("key")))
    first_bare = bare.groupBy(F.col(f"`{text}`").alias("bare")).agg(first.alias("best")).select(F.col("best.key").alias(key))
    once = best.filter("n = 1").select(F.col("key").alias(key))
    kept = keyed.join(once, key, "left_semi")
    # A row that the table holds several times stays once.
    several = best.filter("n > 1").select(F.col("key").alias(key)).union(first_bare)
    copies = keyed.join(several, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(copies).drop(key)
