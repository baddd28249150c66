"""Text and delimited files as rows: decode, sniff, header, long cells; every value stays text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import formats
from vellumflow.functions import text as X

DELIMITERS = ",;\t|"
SNIFFED_CHARS = 8192


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def text_documents(files: DataFrame) -> DataFrame:
    """TextExtractionResult rows of path, content."""
    found = X.detected_encoding(F.col("content"))
    rows = files.select("path", "content", found.alias("e"), X.unix_lines(X.decoded(F.col("content"))).alias("text"))
    return rows.select("path", "text", F.col("e.encoding").alias("encoding"), F.col("e.confidence").alias("encoding_confidence"), X.line_count(F.col("text")).alias("line_count"), F.length("text").cast("long").alias("char_count"), X.has_bom(F.col("content")).alias("has_bom"), F.lit("plain_text").alias("structure_type"))


@F.pandas_udf(T.StringType())
def sniffed_delimiter(texts: pd.Series) -> pd.Series:
    """Among the four delimiters, from the start of a file; comma where the sniffer is unsure."""

    def one(text: str | None) -> str:
        try:
            return csv.Sniffer().sniff((text or "")[:SNIFFED_CHARS], DELIMITERS).delimiter
        except csv.Error:
            return ","

    return texts.map(one)


_CELLS = "path string, row_no long, columns array<string>, row array<string>, delimiter string"


def delimited_rows(files: DataFrame, batch: int = 10_000) -> DataFrame:
    """path, row_no, columns, row, delimiter of path, text: the first record is the header, empty values stay ''.

    Records are read off the text one by one and handed on in batches, never held together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, text, mark in zip(part["path"], part["text"], part["delimiter"], strict=True):
                records = (r for r in csv.reader(io.StringIO(text), delimiter=mark) if r)
                header = next(records, [])
                numbered = enumerate(records)
                while rows := [(path, i, header, [*r[: len(header)], *[""] * (len(header) - len(r))], mark) for i, r in islice(numbered, batch)]:
                    yield pd.DataFrame(rows, columns=["path", "row_no", "columns", "row", "delimiter"])

    return files.select("path", "text", sniffed_delimiter("text").alias("delimiter")).mapInPandas(run, _CELLS)


def row_document(columns: Column, row: Column) -> Column:
    """`column: value` lines of one row."""
    return F.array_join(F.transform(F.arrays_zip(columns.alias("c"), row.alias("v")), lambda z: F.concat(z["c"], F.lit(": "), z["v"])), "\n")


def tab_text(rows: DataFrame) -> DataFrame:
    """path, text: header and rows of a table joined by tabs and line ends."""
    body = rows.groupBy("path", "columns").agg(F.array_sort(F.collect_list(F.struct("row_no", F.array_join("row", "\t").alias("l")))).alias("b"))
    return body.select("path", F.concat_ws("\n", F.array_join("columns", "\t"), F.array_join(F.transform("b", lambda x: x["l"]), "\n")).alias("text"))


def csv_metadata(rows: DataFrame) -> DataFrame:
    """CSVMetadata of each file from its rows."""
    return rows.groupBy("path").agg(F.count("*").alias("row_count"), F.first("columns").alias("column_names"), F.first("delimiter").alias("delimiter")).select("*", F.size("column_names").cast("long").alias("column_count"), F.lit(True).alias("has_header"))


def text_scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of path, content: .txt and .csv files are read, others are rejected with the reason."""
    kind = formats.extension(F.col("path"))
    reason = F.concat(F.lit("Unsupported text format: "), F.coalesce(kind, F.lit("none")))
    return text_documents(files.filter(kind.isin(".txt", ".csv"))), files.filter(~F.coalesce(kind.isin(".txt", ".csv"), F.lit(False))).select("path", reason.alias("error"))


def page_documents(texts: DataFrame) -> DataFrame:
    """A text file as one document: path, page_content, metadata."""
    meta = F.create_map(F.lit("source"), F.col("path"), F.lit("original_source"), F.col("path"), F.lit("encoding"), F.col("encoding"))
    return texts.select("path", F.col("text").alias("page_content"), meta.alias("metadata"))


def row_documents(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """A delimited file's rows as documents: path, page_content (`column: value` lines), metadata with the row's number."""
    joined = rows.join(texts.select("path", "encoding"), "path")
    meta = F.create_map(F.lit("source"), F.col("path"), F.lit("original_source"), F.col("path"), F.lit("row"), F.col("row_no").cast("string"), F.lit("encoding"), F.col("encoding"), F.lit("delimiter"), F.col("delimiter"))
    return joined.select("path", "row_no", row_document(F.col("columns"), F.col("row")).alias("page_content"), meta.alias("metadata"))
