"""The registered queries of this package, over whole tables, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.llm import bpe, divergence, exact, interaction, jaccard, lines, mainpage, mixing, nearest, quality, secrets, sharding, warc
from tidepost.llm.frames import table

#: The vocabulary file, as the workers see it.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Documents that score less are rejected.
GOOD = 0.7


def op1_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op2_curve_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return mainpage.digest(mainpage.main_text(table(spark, folder, "pages").select("page_id", "url", "html")))


def op4_quotient_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.dedup(table(spark, folder, "documents"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), VOCABULARY))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents").select("doc_id", "text")))


def op8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.score_documents(docs, table(spark, folder, "labels"))
    return found.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return lines.drop_lines(docs, dropped="n_dropped")


def op11_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_filter_interaction(spark: SparkSession, folder: str) -> DataFrame:
    return interaction.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ring_shards,
        op2_curve_neighbours,
        op3_main_text,
        op4_quotient_dedup,
        op5_jaccard_join,
        op6_bpe,
        op7_secrets,
        op8_mixture,
        op9_quality,
        op10_line_dedup,
        op11_warc_revisits,
        op12_source_divergence,
        op13_filter_interaction,
    )
}
COUNTERPARTS = {
    "op4_quotient_dedup": exact.DEDUP_SQL,
    "op10_line_dedup": lines.LINES_SQL,
    "op11_warc_revisits": warc.ARCHIVED_SQL,
    "op12_source_divergence": divergence.AUDIT_SQL,
    "op13_filter_interaction": interaction.AUDIT_SQL,
}
