"""Queries of the llm problems; __spark_entry__ adds them if this package can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm import garbled as garbled_text
from vellumflow.llm import mixing
from vellumflow.llm import personal
from vellumflow.llm import pieces as split
from vellumflow.llm import prose
from vellumflow.llm import tokens
from vellumflow.plans.registry import Registry
from vellumflow.session import checkpointed, spread, table

registry = Registry()


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "text_extractions").select("extraction_id", "text"), "extraction_id")


@registry.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_text.garbled(_extractions(spark, d)).select("extraction_id")


@registry.add("p1_restored")
def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_text.garbled(_extractions(spark, d))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    options = split.PieceOptions()
    return split.pieces(split.ranges_of_texts(_extractions(spark, d), "extraction_id", "text", options), options)


@registry.add("p4_found", "SELECT extraction_id FROM text_extractions WHERE length(text) > 16000")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("piece_no = 0").select(F.col("item").alias("extraction_id"))


@registry.add("p4_pieces")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("item", "extraction_id")


@registry.add(
    "p4_results",
    """WITH r AS (SELECT DISTINCT * EXCLUDE (chunks_processed, is_chunked) FROM extraction_results), n AS (SELECT extraction_id, coalesce(length(text), 0) AS n FROM text_extractions)
    SELECT r.*, CAST(CASE WHEN n > 16000 THEN ceil(n / 3000.0) WHEN n > 0 THEN 1 WHEN n = 0 THEN 0 END AS BIGINT) AS chunks_processed, n > 16000 AS is_chunked FROM r LEFT JOIN n USING (extraction_id)""",
)
def p4_results(spark: SparkSession, d: str) -> DataFrame:
    options = split.PieceOptions()
    ranges = split.ranges_of_texts(table(spark, d, "text_extractions"), "extraction_id", "text", options)
    return split.with_chunk_columns(table(spark, d, "extraction_results"), table(spark, d, "text_extractions"), split.piece_counts(ranges, options), options)


@registry.add("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", tokens.token_ids(spark, "text").alias("ids"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return prose.judged(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), table(spark, d, "common_words"), table(spark, d, "doc_labels"))


@registry.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("text_class <> 'prose'").select("doc_id", "text_class")


@registry.add("p9_statistics")
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.sparkContext.broadcast(personal.trained())
    texts = personal.spans_of(_extractions(spark, d), "text_extractions", "extraction_id", "text", weights)
    signers = personal.spans_of(spread(table(spark, d, "signatures").select("signature_id", "signer_name"), "signature_id"), "signatures", "signature_id", "signer_name", weights)
    mails = personal.spans_of(spread(table(spark, d, "employee_rows").select("row_id", "email"), "row_id").distinct(), "employee_rows", "row_id", "email", weights)
    return texts.unionByName(signers).unionByName(mails)


@registry.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.occurrences(_spans(spark, d))


@registry.add("p5_masked")
def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.masked(_spans(spark, d))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mixture_targets").dropDuplicates(["source"]).orderBy("source").toPandas()  # a fixed table
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")
    members = mixing.memberships(docs.withColumn("tokens", tokens.token_count(spark, "text")), targets["source"].tolist())
    return mixing.mixture(checkpointed(members), targets)


@registry.add("p8_mixture")
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).drop("posterior")


@registry.add("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), table(spark, d, "mixture_targets"))
