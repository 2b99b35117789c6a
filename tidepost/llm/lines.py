"""Line dedup by site-relative frequency: lines that too large a part of a host's pages share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import free_name, only, whole
from tidepost.session import written

#: Lines on more than this part of a host's pages go, if they are on at least so many of its pages.
RATIO, LEAST_PAGES = 0.05, 3


def stripped(line: Column) -> Column:
    """A line without white space at its ends (tabs, carriage returns and the like count)."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def split_lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _marks(text: Column) -> Column:
    """Hashes of the distinct lines of a text that are not blank."""
    lines = F.filter(F.transform(split_lines(text), stripped), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate(
    docs: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False
) -> DataFrame:
    """(host, marks): hashes of each host's boilerplate lines. A host has at most (lines a page on average) / ratio.

    Pages are counted by (host, line) and by host; both sums are taken inside the partitions first, so a host with a
    third of all pages sends one row a line and partition. With ``copies_once`` the pages of a host that have one text
    count as one page, told apart by two 64-bit hashes; they too are merged inside the partitions first.
    """
    pages = only(docs, host=host, text=text).select("host", "text", _marks(F.col("text")).alias("marks"))
    if copies_once:
        hashes = [F.xxhash64(F.lit(seed), whole(F.col("text"))).alias(name) for seed, name in ((1, "one"), (2, "two"))]
        pages = pages.select("host", *hashes, "marks").groupBy("host", "one", "two").agg(F.first("marks").alias("marks"))
        pages = written(pages, "pages")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    shares = (
        pages.select("host", F.explode("marks").alias("mark"))
        .groupBy("host", "mark")
        .agg(F.count(F.lit(1)).alias("seen"))
        .filter(F.col("seen") >= least_pages)
    )
    common = shares.alias("s").join(totals.alias("t"), F.col("s.host").eqNullSafe(F.col("t.host")))
    return (
        common.filter(F.col("seen") / F.col("pages") > ratio)
        .groupBy(F.col("s.host").alias("host"))
        .agg(F.collect_set("mark").alias("marks"))
    )


def drop_lines(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    dropped: str | None = None,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``dropped``, also the number of lines taken out.

    A page counts once for a line however often it has it. Pages without host form a group of their own. Blank lines are
    never boilerplate. A null text stays null, a text that loses all its lines becomes empty; no row is dropped.
    With ``copies_once`` exact copies on a host count as one page, so that no number of them makes lines boilerplate.
    """
    marks = free_name(docs, "line_marks")
    theirs = free_name(docs, "line_host")
    found = written(boilerplate(docs, host, text, ratio, least_pages, copies_once), "lines")
    found = found.select(F.col("host").alias(theirs), F.col("marks").alias(marks))
    joined = docs.join(found, docs[f"`{host}`"].eqNullSafe(F.col(theirs)), "left")
    lines = split_lines(F.col(f"`{text}`"))
    good = F.filter(lines, lambda x: ~F.array_contains(F.col(marks), F.xxhash64(stripped(x))))
    changed = F.col(marks).isNotNull() & F.col(f"`{text}`").isNotNull()
    out = [
        F.when(changed, F.array_join(good, "\n")).otherwise(F.col(f"`{text}`")).alias(text) if c == text else docs[f"`{c}`"]
        for c in docs.columns
    ]
    if dropped:
        out.append(F.when(changed, F.size(lines) - F.size(good)).otherwise(0).cast("long").alias(dropped))
    return joined.select(*out)


LINES_SQL = rf"""
WITH l AS (
    SELECT doc_id, source, text, i, line, trim(line, E' \t\n\v\f\r') AS bare
    FROM (SELECT doc_id, source, text, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i
          FROM documents)
), t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), b AS (
    SELECT l.source, bare FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE bare <> ''
    GROUP BY l.source, bare
    HAVING count(DISTINCT doc_id) >= {LEAST_PAGES} AND count(DISTINCT doc_id) / max(pages) > {RATIO}
), k AS (
    SELECT doc_id, count(*) FILTER (WHERE b.bare IS NOT NULL) AS n_dropped,
           coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE b.bare IS NULL), '') AS text
    FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare GROUP BY doc_id
)
SELECT d.doc_id, d.source, k.text, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN k USING (doc_id)
"""
