"""Spans of jobs whose names and status change often in one batch stay few."""

from pyspark.sql import functions as F

from tidepost.operators import fuzzy, lifespans

ORD = "struct<at:int>"


def test_overlaid_spans_are_the_overlaps(spark):
    names = spark.range(200).select(
        F.lit("u").alias("user_id"), F.lit("j").alias("job_id"), F.lit("a").alias("company"), F.col("id").cast("string").alias("title"),
        F.lit("x").alias("location"), F.struct((F.col("id") * 3).cast("int").alias("at")).alias("since"),
        F.when(F.col("id") < 199, F.struct((F.col("id") * 3 + 3).cast("int").alias("at"))).alias("until"),
    )
    states = spark.range(150).select(
        F.lit("u").alias("user_id"), F.lit("j").alias("job_id"), F.when(F.col("id") % 2 == 0, "active").otherwise("removed").alias("status"),
        F.struct((F.col("id") * 4 + 2).cast("int").alias("at")).alias("since"),
        F.when(F.col("id") < 149, F.struct((F.col("id") * 4 + 6).cast("int").alias("at"))).alias("until"),
    )
    found = lifespans._overlaid(names, states)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    overlaps = names.join(states.withColumnsRenamed({"since": "from", "until": "to"}), ["user_id", "job_id"]).select(
        "user_id", "job_id", "company", "title", "location", "status", F.greatest("since", "from").alias("since"), F.least("until", "to").alias("until")
    ).where("since is null or until is null or since < until")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, overlaps.collect()))


def test_new_jobs_meet_only_what_holds_at_their_place(spark, interpreted, monkeypatch):
    """One job moves between two places 200 times; a new job meets the one place where it is then."""
    new = spark.createDataFrame([("u", "n", "acme", "role one", "paris", (101,))], f"user_id string, job_id string, company string, title string, location string, ord {ORD}")
    old = spark.range(200).select(
        F.lit("u").alias("user_id"), F.lit("o").alias("job_id"), F.lit("acme").alias("company"), F.lit("role one").alias("title"),
        F.concat(F.lit("parma "), (F.col("id") % 7).cast("string")).alias("location"),
        F.struct(F.col("id").cast("int").alias("at")).cast(ORD).alias("since"), F.struct((F.col("id") + 1).cast("int").alias("at")).cast(ORD).alias("until"),
    ).where("id <> 101")
    sizes, plain = {}, fuzzy.written

    def counted(df, label):
        rows = plain(df, label)
        sizes[label] = rows.count()
        return rows

    monkeypatch.setattr(fuzzy, "written", counted)
    found = fuzzy.best_matches(new, old.unionByName(old.limit(1).select(
        "user_id", "job_id", "company", "title", F.lit("parma now").alias("location"),
        F.struct(F.lit(100).alias("at")).cast(ORD).alias("since"), F.struct(F.lit(102).alias("at")).cast(ORD).alias("until"),
    ))).collect()
    assert [(r["job_id"], r["match_id"]) for r in found] == [("n", "o")]
    assert sizes["places"] == 1
