"""Keys of varied titles: few pairs meet, none that counts is lost."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidepost.operators import fuzzy

SYLLABLES = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in ("", "n", "r", "s", "l")]


def titles(seed, count):
    made = random.Random(seed)
    words = ["".join(made.choices(SYLLABLES, k=made.randint(1, 3))) for _ in range(400)]
    return sorted({" ".join(made.choices(words, k=made.randint(2, 5))) for _ in range(count)})


def test_far_fewer_pairs_meet_than_there_are(spark):
    names = titles(7, 3000)
    rows = spark.createDataFrame([(n,) for n in names], "name string").repartition(8)
    keys = fuzzy.blocked(rows, "name", 0.85)
    sizes = keys.groupBy("key").count()
    joined = sizes.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    a, b = keys.withColumnRenamed("name", "a"), keys.withColumnRenamed("name", "b")
    met = a.join(b, "key").where("a < b").select("a", "b").distinct().count()
    pairs = len(names) * (len(names) - 1) / 2
    assert joined < 0.6 * pairs and met < 0.2 * pairs, (joined / pairs, met / pairs)


@pytest.mark.parametrize("gate", [0.6, 0.75, 0.85, 0.95])
def test_near_names_of_every_length_share_a_key(spark, gate):
    made = random.Random(int(gate * 100))
    pairs = set()
    for _ in range(3000):
        name = [made.choice("abce  nr") for _ in range(made.randint(1, 24))]
        other = list(name)
        for _ in range(made.randint(1, 8)):
            kind, at = made.randint(0, 2), made.randint(0, len(other))
            other[at : at + (kind != 0)] = [] if kind == 1 else [made.choice("abcenr")]
        a, b = "".join(name).strip(), "".join(other).strip()
        if a and b and a != b and SequenceMatcher(None, a, b).ratio() >= gate:
            pairs.add((a, b))
    assert len(pairs) > 100
    rows = spark.createDataFrame(sorted(pairs), "a string, b string")
    left, right = (fuzzy.blocked(rows.select(c).distinct(), c, gate) for c in ("a", "b"))
    met = left.join(right, "key").join(rows, ["a", "b"], "left_semi").select("a", "b").distinct()
    assert rows.exceptAll(met).collect() == []
