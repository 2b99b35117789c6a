"""How far the sources of a language differ in the terms they use, in exact whole numbers.

Texts are counted in pieces of many and Spark sums up inside its tasks before it shuffles, so what moves grows with the
vocabulary. From there on single
terms are not ranked: the terms of a group that have the same count in the group and the same count in the language form a
cell, the value is worked out once a cell, cells of equal value are merged, and cells are ranked by how many terms come
before them. Only the cells that reach into the wanted ranks are expanded into terms.

Sources are compared two by two on blocks of terms: a block is a table of terms against a tile of sources, and what leaves
it is one sum for each pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepost.llm.frames import only, whole
from tidepost.llm.words import text_bytes
from tidepost.session import written

#: A term is kept in a language if so many of its documents have it; ranks of terms go so far.
LEAST_DOCUMENTS, TERM_RANKS = 10, 10
SCALE = 1_000_000_000
#: Sources and terms of a block.
TILE, BLOCK_TERMS = 256, 2048
#: Bytes of text that are counted at a time; a longer text is counted alone, in parts.
PIECE = 1 << 24

#: Bytes that are no part of a term become blanks, A to Z become a to z; bytes of other characters stay.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_FOLD = np.frombuffer(FOLD, np.uint8)
_OUT = ["group", "term", "n", "docs"]


def terms_of(data: bytes) -> Counter[bytes]:
    """How often a long text has each term. It is split in parts that end between terms, so that the list of all its
    occurrences never stands in memory."""
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        part = data[at : at + PIECE // 16].translate(FOLD)
        end = len(part) if at + len(part) == len(data) else part.rfind(b" ") + 1
        if not end:  # one term fills the part
            rest = data.translate(FOLD)
            end = rest.find(b" ", at)
            end = (len(rest) if end < 0 else end) - at
            part = rest[at : at + end]
        found.update(part[:end].split())
        at += end
    return found


def _counted_piece(data: np.ndarray, at: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """(group, term, n, docs) of the texts of a piece, whose groups are numbered."""
    texts = pa.LargeStringArray.from_buffers(len(groups), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_FOLD[data]))
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    solid = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(groups)), pc.list_value_length(split).to_numpy())[solid.to_numpy(zero_copy_only=False)]
    coded = words.filter(solid).dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, many = np.unique(text * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    cells, place = np.unique(groups[pairs // size] * size + pairs % size, return_inverse=True)
    n = np.bincount(place, many, len(cells)).astype(np.int64)
    docs = np.bincount(place, minlength=len(cells)).astype(np.int64)
    term = coded.dictionary.take(pa.array(cells % size)).cast(pa.large_binary())
    return pa.RecordBatch.from_arrays([pa.array(cells // size), term.cast(pa.binary()), pa.array(n), pa.array(docs)], _OUT)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = pa.table({"lang": batch.column(0), "source": batch.column(1)}).to_pandas()
        numbers, names = pd.factorize(pd.MultiIndex.from_frame(pairs))
        numbers = numbers.astype(np.int64)
        lang, source = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
        data, at = text_bytes(batch.column(2))
        row = 0
        while row < len(numbers):
            end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
            if at[end] - at[row] > PIECE:
                found = terms_of(data[at[row] : at[end]].tobytes())
                columns = [[int(numbers[row])] * len(found), list(found), list(found.values()), [1] * len(found)]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _OUT)
            else:
                made = _counted_piece(data[at[row] : at[end]], at[row : end + 1] - at[row], numbers[row:end])
            group = made.column(0)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), *made.columns[1:]], ["lang", "source", *_OUT[1:]])
            row = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the group's documents that have it."""
    rows = only(docs, lang=lang, source=source, text=text).select(*[whole(F.col(c)).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("term", F.col("term").cast("string"))


def part_of(count: Column, total: Column, vocabulary: Column) -> Column:
    """The smoothed share of a term in billionths, from 1: decimals, so that no product is rounded or overflows."""
    over = ((count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return (F.lit(1) + F.call_function("div", over, (total + 2 * vocabulary).cast("decimal(38,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """At most 10**18 is divided: shares are at most a billion and one."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Of one block: for each pair of sources of two tiles, the sum over the block's terms and how many they are."""
    lang, left, right, _ = key
    row = pd.factorize(terms["term"])[0]
    n = int(row.max()) + 1 if len(row) else 0
    sides = []
    for tile in (left, right):
        mine = sources[sources["tile"] == tile].sort_values("place")
        table = np.repeat(mine["base"].to_numpy(np.int64)[None, :], n, axis=0)
        here = (terms["of_tile"] == tile).to_numpy()
        table[row[here], np.searchsorted(mine["place"].to_numpy(), terms["of"].to_numpy()[here])] = terms["p"].to_numpy(np.int64)[here]
        sides.append((mine["place"].to_numpy(np.int64), table))
    (a, p), (b, q) = sides
    made = []
    for i in range(len(a)):
        other = b > a[i]  # either order of two sources gives the same sum
        gap = q[:, other] - p[:, i : i + 1]
        value = (gap * gap // (q[:, other] + p[:, i : i + 1])).sum(axis=0)
        made.append(pd.DataFrame({"a": a[i], "b": b[other], "value": value}))
    out = pd.concat(made) if made else pd.DataFrame({"a": [], "b": [], "value": []})
    return out.assign(lang=lang, terms=n)[["lang", "a", "b", "value", "terms"]]


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    ``groups``: (lang, source, place, vocabulary, base), ``counts``: (lang, source, term, p) of the kept terms. A block
    holds at most ``BLOCK_TERMS`` terms or so of at most two tiles of sources, whatever a language has of both.
    """
    blocks = groups.groupBy("lang").agg(F.max("vocabulary").alias("vocabulary"), F.max("place").alias("last"))
    blocks = blocks.select(
        "lang",
        F.ceil(F.col("vocabulary") / BLOCK_TERMS).cast("int").alias("blocks"),
        F.floor(F.col("last") / TILE).cast("int").alias("last_tile"),
    ).filter("blocks > 0")
    tile = F.floor(F.col("place") / TILE).cast("int").alias("tile")
    mine = groups.select("lang", "source", "place", tile, "base")
    # The other tile of each pair of tiles, the smaller of the two first.
    dealt = F.explode(F.sequence(F.lit(0), F.col("last_tile"))).alias("other")
    ends = [F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right")]
    held = mine.join(blocks, "lang").select("lang", "source", "place", "tile", "base", "blocks", dealt)
    held = held.select("lang", "place", "tile", "base", *ends, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = counts.join(mine, ["lang", "source"]).join(blocks, "lang")
    found = found.select("lang", "place", "tile", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), dealt)
    found = found.select("lang", F.col("place").alias("of"), F.col("tile").alias("of_tile"), "term", "p", "block", *ends)
    keys = ["lang", "left", "right", "block"]
    blocked = found.alias("f").groupBy(*[F.col(f"f.{k}") for k in keys]).cogroup(held.alias("h").groupBy(*[F.col(f"h.{k}") for k in keys]))
    sums = blocked.applyInPandas(_block_sums, "lang string, a long, b long, value long, terms long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", F.col("place").alias("a"), F.col("source").alias("one"), F.col("base").alias("p"), "vocabulary")
    two = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("two"), F.col("base").alias("q"))
    # The result itself has a row for each two sources; terms that neither has are worth the same each.
    pairs = one.join(two, "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    rest = (F.col("vocabulary") - F.coalesce("terms", F.lit(0))) * divergence(F.col("p"), F.col("q"))
    value = F.when(F.col("vocabulary") > 0, F.coalesce("value", F.lit(0)) + rest).otherwise(0).cast("long")
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    return pairs.select("lang", both.alias("x"), value.alias("value")).select("lang", "x.*", "value")


def _ranked_terms(counts: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank) of each group's ``ranks`` first terms, from ``counts`` (lang, source, term, n, total,
    group_total, lang_total, vocabulary)."""
    cell = ["lang", "source", "n", "total"]
    cells = counts.groupBy(*cell).agg(F.count(F.lit(1)).alias("many"), *[F.first(c).alias(c) for c in ("group_total", "lang_total", "vocabulary")])
    p = part_of(F.col("n"), F.col("group_total"), F.col("vocabulary"))
    q = part_of(F.col("total"), F.col("lang_total"), F.col("vocabulary"))
    cells = cells.withColumns({"p": p, "q": q}).filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    cells = written(cells.select(*cell, "many", "value"), "cells")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    # Each value has a term at least, so no more values than ranks are looked at; Spark cuts groups before the shuffle.
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = values.withColumn("at", F.row_number().over(falling)).filter(F.col("at") <= ranks)
    before = F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < ranks)
    reached = cells.join(values.select("lang", "source", "value"), ["lang", "source", "value"]).select(*cell, "value")
    terms = counts.select(*cell, "term").join(reached, cell)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term")))
    return terms.withColumn("rank", rank).filter(F.col("rank") <= ranks).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    ranks: int = TERM_RANKS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of language and source, the other sources of its language by
    divergence (part ``pair``, all of them), and the terms that set it apart from its language (part ``term``, up to
    ``ranks``). Falling values, ties by the bytes of the item.

    A term is a run of characters that are ASCII letters or not ASCII, A to Z lower-cased; the vocabulary of a language
    are the terms that ``least_documents`` of its documents have. Null text, language or source is the empty one. Each row
    is a document, repeated rows too. Groups without terms are compared like others; where a language has no vocabulary
    all values are 0. A language with one source has no pairs. Extra columns are ignored; an empty table gives no rows.
    """
    counts = written(term_counts(docs, text, lang, source), "terms")
    groups = only(docs, lang=lang, source=source).select(whole(F.col("lang")).alias("lang"), whole(F.col("source")).alias("source")).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = written(kept.filter(F.col("docs") >= least_documents).select("lang", "term", "total"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("total").alias("lang_total"))
    counts = written(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").withColumn("place", place)
    groups = groups.na.fill(0, ["group_total", "lang_total", "vocabulary"])
    # Without a vocabulary nothing is divided by: such values are set to 0 where pairs are made.
    base = F.when(F.col("vocabulary") > 0, part_of(F.lit(0).cast("long"), F.col("group_total"), F.col("vocabulary"))).otherwise(1)
    groups = written(groups.withColumn("base", base.cast("long")), "groups")
    sized = counts.join(groups.select("lang", "source", "group_total", "lang_total", "vocabulary"), ["lang", "source"])
    shares = sized.select("lang", "source", "term", part_of(F.col("n"), F.col("group_total"), F.col("vocabulary")).alias("p"))
    pairs = _pairs(groups, shares)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).select(*out)
    return pairs.unionByName(_ranked_terms(sized, ranks).withColumn("part", F.lit("term")).select(*out))


AUDIT_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
    SELECT id, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM d)
), c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL), k AS (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}
), v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), gt AS (
    SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS total
    FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source LEFT JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY g.lang, g.source
), p AS (
    SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n,
           1 + ({SCALE} * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (CAST(gt.total AS HUGEINT) + 2 * v.v) AS p,
           1 + ({SCALE} * (k.total + 2)) // (CAST(v.total AS HUGEINT) + 2 * v.v) AS q
    FROM gt JOIN k ON gt.lang = k.lang JOIN v ON v.lang = gt.lang
    LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), t AS (
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM r
)
SELECT * FROM t WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
