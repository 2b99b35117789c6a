"""How filters of documents act on each other: what each removes, repeats and loses in every order they can be applied in.

A document is a mask, one bit for each filter that it fails. Documents of a part that have one mask form a cell, so a part
has 32 cells at most whatever its size. Each cell folds once over a constant array of the 120 orders: an order is a fold
over its five filters that carries whether the cell is still there. A cell comes out as 600 structs weighted by its number
of documents; the cells of a part are added up element by element. Only masks are shuffled, never texts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import only, whole
from tidepost.session import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SPACE = r"[\x20\x09-\x0D]+"


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def text_mask(text: Column) -> Column:
    """The bits of the four filters that need nothing but the text: A few words, B repeated words, C capitals, D symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def of(w: Column) -> Column:
        few = _bit(F.size(w) < 200, "A")
        repeated = _bit(100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long"), "B")
        return few + repeated

    # One element, so that the words of a text are made once and used twice.
    counted = F.transform(F.array(words), of)[0]
    capitals = _bit(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"), "C")
    return counted + capitals + _bit(text.rlike("[#$%&*|]"), "D")


def masks(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(part, mask, good, toxic) of every row of ``docs``.

    Texts are equal when their SHA-256 is. Only texts that occur under several ids are joined back to their rows, by
    hash: a text that a third of the rows have is a skewed join key, which Spark splits.
    """
    rows = only(docs, doc_id=doc_id, text=text, part=part).select(
        "doc_id", whole(F.col("part")).alias("part"), whole(F.col("text")).alias("text")
    )
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), text_mask(F.col("text")).alias("mask"))
    rows = written(rows, "masks")
    firsts = rows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = written(firsts.filter("first < last").select("hash", "first"), "firsts")
    rows = rows.join(firsts, "hash", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    known = only(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id")
    known = known.agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    is_one = {n: F.coalesce(F.col(n) == 1, F.lit(False)).cast("long") for n in ("quality", "toxic")}
    return rows.join(known, "doc_id", "left").select(
        "part", (F.col("mask") + _bit(later, "E")).alias("mask"), is_one["quality"].alias("good"), is_one["toxic"].alias("toxic")
    )


def _orders() -> Column:
    return F.array(*[F.array(*[F.lit(FILTERS.index(x)) for x in order]) for order in ORDERS])


def folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of ``COUNTS``, order by order and step by step, of one cell."""
    zero = F.lit(0).cast("long")
    # A filter is first among those that a document fails in one order of as many as the document fails.
    share = F.call_function("div", n * F.lit(len(ORDERS)), F.greatest(F.bit_count(mask), F.lit(1)))

    def step(state: Column, number: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), number)
        fails = mask.bitwiseAND(bit) != 0
        here = state["there"] & fails
        made = F.struct(
            F.when(state["there"] & ~fails, n).otherwise(zero).alias("kept"),
            F.when(here, n).otherwise(zero).alias("removed"),
            F.when(fails & ~state["there"], n).otherwise(zero).alias("redundant"),
            F.when(mask == bit, n).otherwise(zero).alias("unique_fails"),
            F.when(here, good).otherwise(zero).alias("good_lost"),
            F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
            F.when(fails, share).otherwise(zero).alias("shapley"),
        )
        return F.struct((state["there"] & ~fails).alias("there"), F.concat(state["made"], F.array(made)).alias("made"))

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("there"), F.array().cast(kind).alias("made"))
    return F.flatten(F.transform(_orders(), lambda order: F.aggregate(order, start, step, lambda s: s["made"])))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row
    for each part, order of the filters and step.

    Words are what stands between ASCII white space; a null text is empty, a null part is the empty one. A text without
    words fails A alone. Every row counts, repeated rows each. E asks for a smaller id, so rows that share id and text
    do not fail by each other, and rows without id neither fail nor make others fail. Several labels of an id count as 1
    if one of them is 1; an id without labels has neither. Extra columns are ignored; an empty table gives no rows.
    """
    cells = masks(docs, labels, doc_id, text, part).groupBy("part", "mask")
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # At most 32 cells a part come together.
    parts = cells.select("part", folded(*[F.col(c) for c in ("mask", "n", "good", "toxic")]).alias("made"))
    parts = parts.groupBy("part").agg(F.collect_list("made").alias("cells"))

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))

    first, rest = F.element_at("cells", 1), F.expr("slice(cells, 2, 32)")
    rows = parts.select("part", F.posexplode(F.aggregate(rest, first, added)).alias("at", "sums"))
    order = F.element_at(F.array(*[F.lit(x) for x in ORDERS]), F.floor(F.col("at") / STEPS).cast("int") + 1)
    rows = rows.select("part", order.alias("filter_order"), (F.col("at") % STEPS + 1).cast("int").alias("step"), "sums")
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1)).alias("filter")
    return rows.select("part", "filter_order", "step", letter, "sums.*")


AUDIT_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text), l AS (
    SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT d.part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) AS c,
           regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > f.first, false) AS e,
           coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
    FROM d JOIN f ON d.text = f.text LEFT JOIN l ON d.doc_id = l.doc_id
), cells AS (
    SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
                  || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
           count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM m GROUP BY 1, 2
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = {STEPS}
), s AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, n, good, toxic, fails,
           contains(fails, substr(filter_order, step, 1)) AS hit,
           translate(substr(filter_order, 1, step - 1), fails, '') <> substr(filter_order, 1, step - 1) AS gone
    FROM cells, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
    SELECT part, filter_order, step, filter,
           sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM s GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
