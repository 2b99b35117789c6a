"""Fuzzy match: the stored posting a new posting most resembles.

The score needs three string ratios per pair of postings. No row pairs are formed for it:
equal postings join by key; the others meet as distinct titles, then as distinct companies
under matching titles, and only then as distinct (company, title, place) triples. Titles meet
in the class of their lengths, through their rarest three-character grams. Two names can reach
a ratio only if they share a certain number of grams, so a head of each name's grams, rarest
first, must have one in common: nothing that passes the gates is lost. An edit-distance bound,
also lossless, runs inside the joins before any ratio.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.similarity import MatchRule, composite, gates_pass, ratio
from tidepost.operators.ordered import lowest_before
from tidepost.session import written

#: Ratio of the lengths a class of names spans.
CLASS_WIDTH = 1.1
TRIPLE = ["user_id", "company", "title", "location"]
# Characters of a normalised name from frequent to rare in job titles.
_FREQUENT_FIRST = " eatnirosclmgdpuhvybfwkxjqz1230456789"
_RANKS = "".join(chr(ord("A") + 40 - i) for i in range(len(_FREQUENT_FIRST)))


def _rare_first(grams: Column) -> Column:
    """(gram, occurrence) tokens in one global order, grams with a rare character first."""
    ordered = F.array_sort(grams)

    def token(gram: Column, i: Column) -> Column:
        nth = (i + 2 - F.array_position(ordered, gram)).cast("string")
        ranks = F.array_sort(F.split(F.translate(gram, _FREQUENT_FIRST, _RANKS), ""))
        return F.concat(F.concat_ws("", ranks), F.lit("/"), gram, nth)

    return F.array_sort(F.transform(ordered, token))


def _length_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(CLASS_WIDTH)).cast("int")


def _head(tokens: Column, shared: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(F.least(F.size(tokens) - shared + 1, F.size(tokens)), F.lit(0)))


def blocked(rows: DataFrame, name: str, gate: float) -> DataFrame:
    """Rows with a ``key``; two names with a ratio of at least ``gate`` share one.

    Names meet in the class of their two lengths. Of n + m characters M >= gate (n + m) / 2 on
    either side are matched, and every unmatched one breaks two grams of three characters at
    most, so 5M - 2 - 2 (n + m) grams stay whole. Where the lengths of a class leave one at
    least, its keys are grams: the rarest n - shared + 1 of two names have one in common.
    Otherwise they are pairs of the rarest characters, of which n - M + 2 have two in common
    (single ones, if the class is too short for two).
    """
    size, text = F.length(name), F.col(name)
    starts = F.when(size > 2, F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))))
    grams = F.coalesce(F.transform(starts, lambda at: F.substring(text, at, 3)), F.array().cast("array<string>"))
    reach = gate / (2 - gate)
    lengths = F.sequence(F.ceil(size * reach - 1e-9).cast("int"), F.floor(size / reach + 1e-9).cast("int"))
    classes = F.transform(lengths, lambda m: F.struct(_length_class(m).alias("other"), m.alias("least")))
    # The first length of each class is the least: lengths ascend.
    firsts = F.filter(
        classes, lambda c, i: (i == 0) | (_length_class(c["least"] - F.when(i > 0, F.lit(1)).otherwise(F.lit(0))) != c["other"])
    )
    out = rows.where(size > 0).withColumns(
        {
            "grams": _rare_first(grams),
            "chars": _rare_first(F.filter(F.split(text, ""), lambda c: c != "")),
            "partner": F.explode(firsts),
        }
    )
    own, other, both = _length_class(size), F.col("partner.other"), size + F.col("partner.least")
    floor = F.pow(F.lit(CLASS_WIDTH), own) + F.pow(F.lit(CLASS_WIDTH), other)
    whole = 2.5 * gate - 2
    by_gram = floor * whole - 2 > 1e-6
    by_pair = floor * gate / 2 > 1 + 1e-6
    shared_grams = F.ceil(both * whole - 2 - 1e-9).cast("int")
    shared_chars = F.ceil(both * gate / 2 - 1e-9).cast("int")
    pair_head = _head(F.col("chars"), shared_chars - 1)
    pairs = F.flatten(
        F.transform(
            pair_head,
            lambda first, i: F.transform(
                F.slice(pair_head, i + 2, F.greatest(F.size(pair_head) - i - 1, F.lit(0))),
                lambda second: F.concat(first, second),
            ),
        )
    )
    keys = (
        F.when(by_gram, _head(F.col("grams"), shared_grams)).when(by_pair, pairs).otherwise(_head(F.col("chars"), shared_chars))
    )
    lengths_tag = F.concat_ws("-", F.least(own, other).cast("string"), F.greatest(own, other).cast("string"))
    out = out.select(*rows.columns, lengths_tag.alias("lengths"), F.explode(keys).alias("token"))
    return out.select(*rows.columns, F.concat_ws(" ", "lengths", "token").alias("key"))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def bag(name: str) -> Column:
    """What characters a normalised name has, and which it has twice and three times: a bit each, in three longs."""
    step_bit = lambda c: F.when(F.instr(F.lit(_ALPHABET), c) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(_ALPHABET), c) - 1)).otherwise(F.lit(0).cast("long"))

    def step(seen: Column, char: Column) -> Column:
        return F.transform(F.array(step_bit(char)), lambda bit: F.struct(
            seen["one"].bitwiseOR(bit).alias("one"),
            seen["two"].bitwiseOR(seen["one"].bitwiseAND(bit)).alias("two"),
            seen["three"].bitwiseOR(seen["two"].bitwiseAND(bit)).alias("three"),
        ))[0]

    none = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("one", "two", "three")])
    return F.aggregate(F.filter(F.split(F.col(name), ""), lambda c: c != ""), none, step)


def _apart(left: str, right: str) -> Column:
    """Characters that one of two names has and the other cannot match: at most as many as are unmatched in any ratio."""
    return sum((F.bit_count(F.col(f"{left}.{n}").bitwiseXOR(F.col(f"{right}.{n}"))) for n in ("one", "two", "three")), F.lit(0))


def _may_reach(left: str, right: str, gate: Column, left_bag: str, right_bag: str) -> Column:
    """Lossless bounds on the ratio of two columns: lengths first, then characters, then edit distance.

    Unmatched characters are edits, so a ratio of g leaves at most (1 - g) * total of them.
    """
    a, b = F.length(left), F.length(right)
    lengths = 2.0 * F.least(a, b) >= (gate - 1e-9) * (a + b)
    edits = F.floor((1.0 - gate + 1e-9) * (a + b)).cast("int")
    return lengths & (_apart(left_bag, right_bag) <= edits) & (F.call_function("levenshtein", F.col(left), F.col(right), edits) >= 0)


def title_pairs(new: DataFrame, existing: DataFrame, rule: MatchRule) -> DataFrame:
    """Distinct (new, existing) titles per user with a ratio at or above the title gate."""
    left = new.select("user_id", F.col("title").alias("new_title")).distinct()
    right = existing.select("user_id", F.col("title").alias("old_title")).distinct()
    same = left.join(right, (left["user_id"] == right["user_id"]) & (F.col("new_title") == F.col("old_title"))).select(
        left["user_id"], "new_title", "old_title", F.lit(1.0).alias("title_score")
    )
    left_keys = blocked(left.withColumn("new_bag", bag("new_title")), "new_title", rule.title_gate)
    right_keys = blocked(right.withColumn("old_bag", bag("old_title")), "old_title", rule.title_gate)
    may = _may_reach("new_title", "old_title", F.lit(rule.title_gate), "new_bag", "old_bag")
    close = (
        left_keys.join(right_keys, ["user_id", "key"])
        .where((F.col("new_title") != F.col("old_title")) & may)
        .select("user_id", "new_title", "old_title")
        .distinct()
    )
    # Users share most titles: score each pair of strings once.
    scores = close.select("new_title", "old_title").distinct().withColumn(
        "title_score", ratio("new_title", "old_title")
    )
    close = close.join(scores.where(F.col("title_score") >= rule.title_gate), ["new_title", "old_title"])
    return same.unionByName(close.select(*same.columns))


def close_companies(asked: DataFrame, right: DataFrame, rule: MatchRule) -> DataFrame:
    """Distinct (new, old) companies per user that are unequal and may reach the gate.

    They meet under matching titles only. The title's score says what the company's must be
    for the composite, and lengths, characters and edit distance what it can be, all inside the
    join; at the gates of a company no key of characters would keep names apart. Both sides are
    on disk before they meet, so that Spark splits a title that very many companies have.
    """
    fields = ["user_id", "old_title"]
    new = asked.groupBy(*fields, "new_company").agg(F.max("title_score").alias("title_score"))
    new = written(new.withColumn("new_bag", bag("new_company")), "new-companies")
    old = written(right.select(*fields, "old_company", bag("old_company").alias("old_bag")), "old-companies")
    rest = rule.title_weight * F.col("title_score") + rule.location_weight
    needed = F.greatest((rule.composite_gate - rest) / rule.company_weight - 1e-9, F.lit(rule.company_gate))
    may = _may_reach("new_company", "old_company", needed, "new_bag", "old_bag")
    return (
        new.join(old, fields)
        .where((F.col("new_company") != F.col("old_company")) & may)
        .select("user_id", "new_company", "old_company")
        .distinct()
    )


def name_pairs(new: DataFrame, existing: DataFrame, titles: DataFrame, rule: MatchRule) -> DataFrame:
    """(title, company) of both sides under matching titles, companies passing too.

    A pair can be left out when its score with an equal place stays below the gate, or below
    what a stored posting of another pair reaches at whatever place.
    """
    left = new.select("user_id", F.col("title").alias("new_title"), F.col("company").alias("new_company")).distinct()
    right = existing.groupBy(
        "user_id", F.col("title").alias("old_title"), F.col("company").alias("old_company")
    ).agg(F.bool_or(_throughout()).alias("stored"))
    asked = left.join(titles, ["user_id", "new_title"])
    asked, right = written(asked, "asked"), written(right, "right")
    close = close_companies(asked, right, rule)
    scores = close.select("new_company", "old_company").distinct().withColumn(
        "company_score", ratio("new_company", "old_company")
    )
    close = close.join(scores.where(F.col("company_score") >= rule.company_gate), ["new_company", "old_company"])
    equal = left.select("user_id", "new_company").distinct().withColumns(
        {"old_company": F.col("new_company"), "company_score": F.lit(1.0)}
    )
    companies = written(equal.unionByName(close.select(*equal.columns)), "companies")
    pairs = asked.join(companies, ["user_id", "new_company"])
    sure = composite(F.col("company_score"), F.col("title_score"), F.lit(0.0), rule)
    best = composite(F.col("company_score"), F.col("title_score"), F.lit(1.0), rule)
    pairs = pairs.where(best >= rule.composite_gate - 1e-9).join(right, ["user_id", "old_title", "old_company"])
    pairs = written(pairs.withColumn("sure", F.when(F.col("stored") & (sure >= rule.composite_gate), sure)), "pairs")
    names = ["user_id", "new_title", "new_company"]
    reached = pairs.groupBy(*names).agg(F.max("sure").alias("reached"))
    pairs = pairs.join(reached, names).where(F.col("reached").isNull() | (best >= F.col("reached") - 1e-9))
    return pairs.drop("sure", "stored", "reached")


SCORES = ["company_score", "title_score", "location_score", "score"]


def _offers(rows: DataFrame, existing: DataFrame, rule: MatchRule, same_place: bool) -> DataFrame:
    """Rows of new triples and matching names against the existing triples of those names.

    Either only existing triples at the same place, met by key, or only those elsewhere, whose
    lengths must leave room for the score ``reached`` already. Rows of single jobs, with their ``ord``,
    meet only what holds then.
    """
    by_job = "ord" in rows.columns
    holds = _there() if by_job else F.lit(True)
    who = [*TRIPLE, "job_id"] if by_job else TRIPLE
    right = existing.select(
        "user_id", F.col("title").alias("old_title"), F.col("company").alias("old_company"),
        F.col("location").alias("old_location"), "match_id", "since", "until",
    )
    if same_place:
        pairs = rows.join(
            right.withColumnRenamed("old_location", "location"),
            ["user_id", "old_title", "old_company", "location"],
        ).where(holds).withColumn("location_score", F.lit(1.0))
    else:
        pairs = rows.join(right, ["user_id", "old_title", "old_company"]).where((F.col("location") != F.col("old_location")) & holds)
        a, b = F.length("location"), F.length("old_location")
        at_most = composite(
            F.col("company_score"), F.col("title_score"),
            2.0 * F.least(a, b) / F.greatest(a + b, F.lit(1)) + 1e-9, rule,
        )
        pairs = written(pairs.where(at_most >= F.col("reached")), "places")
        # However many postings stand at two places, their names are compared once.
        places = pairs.select("location", "old_location").distinct()
        places = places.withColumn("location_score", ratio("location", "old_location"))
        pairs = pairs.join(places, ["location", "old_location"])
    company, title, place = F.col("company_score"), F.col("title_score"), F.col("location_score")
    pairs = pairs.withColumn("score", composite(company, title, place, rule))
    return pairs.where(gates_pass(company, title, F.col("score"), rule)).select(*who, "match_id", *SCORES)


def _still_open(rows: DataFrame, reached: DataFrame, rule: MatchRule) -> DataFrame:
    """Rows whose names can still reach the score a new triple has, with that score."""
    limit = composite(F.col("company_score"), F.col("title_score"), F.lit(1.0), rule)
    known = reached.select(*TRIPLE, F.col("score").alias("reached"))
    rows = rows.join(known, TRIPLE, "left")
    rows = rows.withColumn("reached", F.coalesce("reached", F.lit(rule.composite_gate - 1e-9)))
    return rows.where(limit >= F.col("reached"))


def _with_names(new: DataFrame, names: DataFrame) -> DataFrame:
    """New triples with the matching names of either title and company."""
    return new.withColumns({"new_title": F.col("title"), "new_company": F.col("company")}).join(
        names, ["user_id", "new_title", "new_company"]
    ).drop("new_title", "new_company")


def triple_matches(new: DataFrame, stored: DataFrame, names: DataFrame, rule: MatchRule) -> DataFrame:
    """Of the existing triples that hold throughout, the best for each new triple.

    First the best triple at the same place, then triples elsewhere, only under names that could beat it.
    """
    rows = _with_names(new, names)
    here = written(_best(_offers(rows, stored, rule, True), TRIPLE), "here")
    elsewhere = _offers(_still_open(rows, here, rule), stored, rule, False)
    return _best(here.unionByName(elsewhere), TRIPLE)


def arrived_matches(
    new_jobs: DataFrame, arrived: DataFrame, names: DataFrame, reached: DataFrame, rule: MatchRule
) -> DataFrame:
    """Offers by new job of triples that hold for a part of the batch, where they may beat the score ``reached`` already.

    A job meets those that hold at its place, so there are as many rows as postings that stand there then, however often
    their names change in the batch.
    """
    rows = _still_open(_with_names(new_jobs.select(*TRIPLE).distinct(), names), reached, rule)
    rows = rows.join(new_jobs.select(*TRIPLE, "job_id", "ord"), TRIPLE)
    return _offers(rows, arrived, rule, True).unionByName(_offers(rows, arrived, rule, False))


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The highest score per key, equal scores by the lowest match id."""
    fields = ["match_id", *SCORES]
    best = F.min_by(F.struct(*fields), F.struct(-F.col("score"), F.col("match_id"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*")


def _throughout() -> Column:
    return F.col("since").isNull() & F.col("until").isNull()


def _there(mine: str = "ord") -> Column:
    """The existing posting holds at the place of the new one."""
    begun = F.col("since").isNull() | (F.col("since") < F.col(mine))
    return begun & (F.col("until").isNull() | (F.col(mine) < F.col("until")))


def standing(existing: DataFrame) -> DataFrame:
    """(triple, match_id, since, until): the jobs that may stand for equal postings, the lowest id at any place.

    Of those that hold throughout that is one; of those that end at one place, the ones with a lower id than all that began
    before them.
    """
    throughout = existing.where(_throughout()).groupBy(*TRIPLE).agg(F.min("job_id").alias("match_id"))
    out = [*TRIPLE, "match_id", "since", "until"]
    none = F.lit(None).cast(existing.schema["since"].dataType)
    throughout = throughout.withColumns({"since": none, "until": none}).select(*out)
    parts = existing.where(~_throughout()).select(*TRIPLE, F.col("job_id").alias("match_id"), "since", "until")
    if parts.isEmpty():
        return throughout
    parts = lowest_before(parts, [*TRIPLE, "until"], ["since", "match_id"], "match_id", "lower")
    parts = parts.where(F.col("lower").isNull() | (F.col("match_id") < F.col("lower")))
    return throughout.unionByName(parts.select(*out))


def best_matches(new: DataFrame, existing: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """Per new job the existing job with the best composite, if any passes.

    Both sides hold ``user_id, job_id, company, title, location`` in normalised form, new jobs
    their place ``ord``, and existing ones ``since`` and, where they end, ``until``: only those
    that hold at the new job's place can match. Null is before and after all. Equal scores,
    and so equal postings, go to the lowest job id.
    """
    if "until" not in existing.columns:
        existing = existing.withColumn("until", F.lit(None).cast(existing.schema["since"].dataType))
    triples = written(standing(existing), "triples")
    # Equal triples score 1, which nothing beats.
    one = F.lit(1.0)
    equal = new.join(triples, TRIPLE).where(_there()).groupBy("user_id", "job_id").agg(F.min("match_id").alias("match_id")).select(
        "user_id", "job_id", "match_id", one.alias("company_score"), one.alias("title_score"),
        one.alias("location_score"), composite(one, one, one, rule).alias("score"),
    )
    equal = written(equal, "equal")
    rest = written(new.join(equal.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti"), "rest")
    asked = rest.select(*TRIPLE).distinct()
    titles = written(title_pairs(asked, triples, rule), "titles")
    names = written(name_pairs(asked, triples, titles, rule), "names")
    offered = triple_matches(asked, triples.where(_throughout()), names, rule)
    arrived = triples.where(~_throughout())
    if not arrived.isEmpty():
        offered = written(offered, "stored-best")
        found = rest.join(offered, TRIPLE).unionByName(arrived_matches(rest, arrived, names, offered, rule), allowMissingColumns=True)
    else:
        found = rest.join(offered, TRIPLE)
    return equal.unionByName(_best(found, ["user_id", "job_id"]))


def scored_pairs(pairs: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """ratios and composite of given pairs of postings, each string pair once.

    Takes normalised ``new_x`` and ``old_x`` for company, title and location.
    """
    out = pairs
    for part in ("company", "title", "location"):
        new, old = f"new_{part}", f"old_{part}"
        scores = pairs.select(new, old).distinct().withColumn(f"{part}_score", ratio(new, old))
        out = out.join(scores, [new, old])
    company, title, place = F.col("company_score"), F.col("title_score"), F.col("location_score")
    return out.withColumn("score", composite(company, title, place, rule))
