"""The slices of large groups give what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidepost.operators import ordered

BY = "OVER (PARTITION BY key ORDER BY at)"


@pytest.fixture(scope="module")
def rows(spark):
    made = random.Random(3)
    data = [
        ("hot" if made.random() < 0.5 else f"k{made.randint(0, 20)}", i, made.choice([None, "a", "b", "c"]))
        for i in range(3000)
    ]
    made.shuffle(data)
    return spark.createDataFrame(data, "key string, at int, value string").repartition(6)


@pytest.mark.parametrize(
    "step, window",
    [
        (lambda df: ordered.lagged(df, ["key"], ["at"], {"out": "value"}), f"lag(value) {BY}"),
        (
            lambda df: ordered.carried(df, ["key"], ["at"], {"out": "value"}),
            f"last_value(value) IGNORE NULLS {BY}",
        ),
        (lambda df: ordered.numbered(df, ["key"], ["at"], "out"), f"row_number() {BY}"),
    ],
)
def test_slices_equal_a_window(rows, step, window):
    plain = sorted(map(tuple, rows.withColumn("out", F.expr(window)).collect()), key=repr)
    assert sorted(map(tuple, step(rows).collect()), key=repr) == plain


@pytest.mark.parametrize(
    "step, window",
    [
        (lambda df: ordered.lagged(df, ["key"], ["at"], {"out": "value"}), f"lag(value) {BY}"),
        (lambda df: ordered.lagged(df, ["key"], ["at"], {"out": F.lit(1)}), f"lag(1) {BY}"),
        (lambda df: ordered.carried(df, ["key"], ["at"], {"out": "value"}), f"last_value(value) IGNORE NULLS {BY}"),
        (lambda df: ordered.numbered(df, ["key"], ["at"], "out"), f"row_number() {BY}"),
    ],
)
def test_crowded_keys_are_cut_and_the_rest_is_whole(rows, step, window, monkeypatch):
    monkeypatch.setattr(ordered, "CROWDED", 500)
    cut = []
    monkeypatch.setattr(ordered, "_sliced", lambda df, *rest, plain=ordered._sliced: cut.append(df.select("key").distinct().count()) or plain(df, *rest))
    plain = sorted(map(tuple, rows.withColumn("out", F.expr(window)).collect()), key=repr)
    assert sorted(map(tuple, step(rows).collect()), key=repr) == plain
    assert cut == [1]


def test_usual_keys_are_shuffled_once(rows):
    found = ordered.lagged(rows, ["key"], ["at"], {"out": "value"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_empty(rows):
    assert ordered.numbered(rows.where("false"), ["key"], ["at"], "n").count() == 0
