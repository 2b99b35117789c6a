"""The corpus pipeline: documents in, encoded training documents out, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.llm import bpe, jaccard, lines, mixing, quality
from tidepost.llm.frames import free_name, table
from tidepost.llm.queries import GOOD, VOCABULARY
from tidepost.session import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score = free_name(docs, "quality_score")
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), score=score)
    return scored.filter(F.col(score) >= GOOD).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many different documents of their source share; ``n_chars`` follows the text.

    Copies count once: they are still there at this stage, and one of them is to reach the end with its text."""
    cleaned = lines.drop_lines(docs, copies_once=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one of each text without words."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights: those of small sources are repeated, none is lost."""
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that show the round trip."""
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), VOCABULARY))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained classifier, MinHash and BPE are beyond SQL: the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        path = f"{shared_folder(spark)}/tidepost/stage-{number}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
