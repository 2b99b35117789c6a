"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power alpha, normalised. Alpha is found by bisection so that the weights
meet a target entropy, or so that no source is repeated more often than allowed. The weights become token budgets, and a
source's budget is realised by passes over its documents, each pass in an order of its own (a block permutation); the last
pass ends where the budget does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepost.llm.frames import free_name, only, whole
from tidepost.session import written


@dataclass(frozen=True)
class Mix:
    """``entropy`` (in nats) is the target if given, else ``repetition``: the most passes a source gets when the largest
    gets one. ``budget`` is the number of tokens to give out; without it the source that gains least is read just once, so
    nothing is lost. ``block_tokens`` is the size of the blocks that the mixture comes in."""

    repetition: float = 1.5
    entropy: float | None = None
    budget: float | None = None
    block_tokens: int = 1_000_000


#: A pass over a source is summed up in so many slices of its order before single rows are looked at.
SLICES = 4096
#: Halvings of the exponent's interval that one pass over the sources settles, and passes.
HALVINGS, PASSES = 5, 8


def tokens_of(text: Column) -> Column:
    """The number of runs of characters that are no white space."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bisect_repetition(least: float, most: float, repetition: float) -> float:
    """The exponent at which the smallest share is read ``repetition`` times as often as the largest, 1 if it never is."""
    low, high = 0.0, 1.0
    if least <= 0 or (most / least) ** (1 - low) <= repetition:
        return low if least > 0 else high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (most / least) ** (1 - middle) > repetition else (low, middle)
    return high


def bisect_entropy(shares: DataFrame, entropy: float) -> float:
    """The exponent whose weights have this entropy; each pass over the sources evaluates the middles of several halvings.

    Entropy falls as the exponent grows: 0 gives equal weights (the most entropy there is), large ones the largest source.
    """
    low, high = 0.0, 8.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
        power = [F.pow("share", F.lit(a)) for a in grid]
        sums = [F.sum(p).alias(f"z{i}") for i, p in enumerate(power)]
        logs = [F.sum(p * F.log("share") * F.lit(a)).alias(f"s{i}") for i, (p, a) in enumerate(zip(power, grid, strict=True))]
        row = shares.agg(*sums, *logs).first()
        for i, a in enumerate(grid):
            z = row[f"z{i}"]
            if z and math.log(z) - row[f"s{i}"] / z > entropy:
                low = a
            else:
                high = a
                break
    return (low + high) / 2


def weights(rows: DataFrame, how: Mix) -> DataFrame:
    """(source, tokens, share, weight, budget, passes) for each source of ``rows`` (source, tokens).

    Sources without tokens have weight 0 and are read once. Nothing is collected but the total, the least and the largest.
    """
    totals = written(rows.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens")), "sources")
    positive = totals.filter("tokens > 0")
    whole_, least, most = positive.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not whole_:
        zero = [F.lit(0.0).alias(n) for n in ("share", "weight", "budget")]
        return totals.select("source", "tokens", *zero, F.lit(1.0).alias("passes"))
    shares = positive.select("source", "tokens", (F.col("tokens") / whole_).alias("share"))
    if how.entropy is None:
        alpha = bisect_repetition(least, most, how.repetition)
    else:
        alpha = bisect_entropy(shares, how.entropy)
    norm = shares.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0]
    weight = F.pow("share", F.lit(alpha)) / norm
    if how.budget is None:
        # Passes are budget * weight / tokens; the least of them, which belongs to the largest or smallest source, is 1.
        factor = max(t * norm / (t / whole_) ** alpha for t in (least, most))
    else:
        factor = how.budget
    out = shares.withColumn("weight", weight).withColumn("budget", F.lit(float(factor)) * weight)
    out = out.withColumn("passes", F.round(F.col("budget") / F.col("tokens"), 9))
    rest = totals.filter("tokens <= 0").select(
        "source", "tokens", *[F.lit(0.0).alias(n) for n in ("share", "weight", "budget")], F.lit(1.0).alias("passes")
    )
    return written(out.unionByName(rest), "weights")


def place_of(key: Column, epoch: Column) -> Column:
    """A document's place in the order of a pass: 63 bits that differ from pass to pass."""
    return F.shiftrightunsigned(F.xxhash64(key, epoch), 1)


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, full, cut): the number of whole passes, and the place up to which the last one goes (-1: not begun).

    Sums go by slices of the order first; only the slice in which a budget ends is read row by row.
    """
    parts = plan.filter("tokens > 0").select("source", F.floor("passes").cast("int").alias("full"), (F.col("budget") - F.floor("passes") * F.col("tokens")).alias("left"))
    placed = rows.join(parts, rows.source.eqNullSafe(parts.source)).select(
        rows.source, "tokens", "full", "left", place_of(F.col("key"), F.col("full")).alias("place")
    )
    placed = placed.withColumn("slice", F.shiftright("place", 51).cast("int"))
    sliced = placed.groupBy("source", "slice").agg(F.sum("tokens").alias("tokens"), F.first("full").alias("full"), F.first("left").alias("left"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = sliced.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ends = written(sliced.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("tokens") > F.col("left"))), "slices")
    near = placed.alias("p").join(
        ends.select("source", "slice", "before").alias("e"),
        F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.slice") == F.col("e.slice")),
    )
    so_far = Window.partitionBy("p.source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("sum", F.col("before") + F.sum("tokens").over(so_far)).filter(F.col("sum") <= F.col("left"))
    last = near.groupBy(F.col("p.source").alias("source")).agg(F.max("place").alias("fits"))
    base = ends.select("source", (F.col("slice").cast("long") * F.lit(1 << 51) - 1).alias("below"))
    out = parts.alias("a").join(last.alias("l"), F.col("a.source").eqNullSafe(F.col("l.source")), "left")
    out = out.join(base.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    whole_pass = F.lit((1 << 63) - 1)  # no slice holds the end: all of the pass fits
    cut = F.when(F.col("left") < 0.5, F.lit(-1)).otherwise(F.coalesce("fits", "below", whole_pass))
    return out.select(F.col("a.source").alias("source"), F.col("full"), cut.cast("long").alias("cut"))


def copies(docs: DataFrame, doc_id: str, text: str, source: str, how: Mix) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the mixture is made from: rows (key, source, tokens), written once; weights; and where each source ends."""
    rows = only(docs, doc_id=doc_id, text=text, source=source)
    rows = rows.select(mix_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "source", tokens_of(F.col("text")).alias("tokens"))
    rows = written(rows, "tokens")
    plan = weights(rows, how)
    return rows, plan, written(cuts(rows, plan), "cuts")


def mix_key(doc_id: Column, text: Column) -> Column:
    """Repeated rows have one key and so move together."""
    return F.xxhash64(doc_id, text)


def repeated(rows: DataFrame, ends: DataFrame, key: str, source: str, epoch: str) -> DataFrame:
    """``rows`` once for each pass that reaches them, the pass (from 0) in ``epoch``."""
    full, cut, theirs = (free_name(rows, n) for n in ("mix_full", "mix_cut", "mix_source"))
    small = ends.select(F.col("source").alias(theirs), F.col("full").alias(full), F.col("cut").alias(cut))
    joined = rows.join(small, F.col(f"`{source}`").eqNullSafe(F.col(theirs)), "left")
    # A source without tokens is in no plan: it is read once.
    times = F.coalesce(F.col(full) + (place_of(F.col(key), F.col(full)) <= F.col(cut)).cast("int"), F.lit(1))
    passes = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn(epoch, F.explode(passes)).drop(full, cut, theirs)


def mixture(docs: DataFrame, how: Mix | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens, epoch, block, slot, weight): one row for each time a document is read.

    Blocks hold ``how.block_tokens`` tokens each, the last perhaps fewer; every source gives its weight's part to every
    block, to within a document. Inside a block documents are in an order of their own, ``slot`` counts from 0. A null
    source is a source; a null or empty text has no tokens and is read with its source; an empty table gives no rows.
    """
    how = how or Mix()
    rows, plan, ends = copies(docs, doc_id, text, source, how)
    read = repeated(rows, ends, "key", "source", "epoch")
    read = read.withColumn("place", place_of(F.col("key"), F.col("epoch"))).withColumn("slice", F.shiftright("place", 51).cast("int"))
    read = written(read, "read")
    # Where each reading begins in its source's budget: sums by slice, then rows inside their slice.
    slices = read.groupBy("source", "epoch", "slice").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("epoch", "slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).alias("s")
    inside = Window.partitionBy("source", "epoch", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = read.withColumn("begun", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.epoch") == F.col("s.epoch")) & (F.col("r.slice") == F.col("s.slice"))
    placed = begun.join(slices, same).select("r.doc_id", "r.source", "r.tokens", "r.epoch", "r.key", (F.col("begun") + F.col("offset")).alias("begun"))
    tokens = read.agg(F.sum("tokens")).first()[0] or 0
    blocks = max(1, math.ceil(tokens / how.block_tokens))
    given = plan.select("source", "weight", F.greatest("budget", F.lit(1.0)).alias("budget")).alias("w")
    placed = placed.alias("p").join(given, F.col("p.source").eqNullSafe(F.col("w.source")))
    block = F.least(F.floor(F.col("begun") / F.col("budget") * blocks), F.lit(blocks - 1)).cast("int")
    placed = placed.select("doc_id", F.col("p.source").alias("source"), "tokens", "epoch", block.alias("block"), "weight", "key")
    order = Window.partitionBy("block").orderBy(F.xxhash64("key", "epoch", F.lit(1)), "doc_id", "epoch")
    return placed.withColumn("slot", (F.row_number().over(order) - 1).cast("long")).select(
        "doc_id", "source", "tokens", "epoch", "block", "slot", "weight"
    )


def resample(docs: DataFrame, how: Mix | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` itself in the mixture's proportions: each row as often as ``mixture`` reads it, with its columns alone."""
    how = how or Mix()
    _, _, ends = copies(docs, doc_id, text, source, how)
    key = free_name(docs, "mix_key")
    epoch = free_name(docs, "mix_epoch")
    keyed = docs.withColumn(key, mix_key(docs[f"`{doc_id}`"], docs[f"`{text}`"]))
    return repeated(keyed, ends, key, source, epoch).drop(key, epoch)
