import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def tables():
    def rows(name):
        return duckdb.sql(f"SELECT * FROM '{os.path.join(FOLDER, name)}.parquet'").fetchall()

    return rows


@pytest.fixture(scope="session")
def make(spark):
    """A small documents table with a column whose name clashes with the operators' own."""

    def documents(rows, columns="doc_id long, text string, source string, score string"):
        return spark.createDataFrame(rows, columns)

    return documents


ODD = [
    (1, None, "a", "x"),
    (2, "", "a", None),
    (3, " \t\n ", None, "y"),
    (4, "one two three", None, "y"),
    (5, "one two three four five six seven", "b", "z"),
    (5, "one two three four five six seven", "b", "z"),
    (None, "one two three four five six seven", "b", "z"),
    (7, "wort " * 60_000, "b", "z"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
