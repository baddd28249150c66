"""Markdown and JSON output by templates, as ordered string aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import fixed_two


def percent(value: Column) -> Column:
    """Whole per cent, ties to even."""
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def field_line(path: Column, value: Column, confidence: Column) -> Column:
    known = F.concat(F.lit("- **"), path, F.lit(":** "), value, F.coalesce(F.concat(F.lit(" ("), percent(confidence), F.lit(")")), F.lit("")))
    return F.when(value.isNull(), F.concat(F.lit("- **"), path, F.lit(":** *Not found*"))).otherwise(known)


def inline_pairs(pairs: Column) -> Column:
    """`key: value` of array<struct<k, v>>, nulls left out."""
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: F.concat(p["k"], F.lit(": "), p["v"])), ", ")


def ordered_lines(line: Column, order: Column, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), separator)


def documents_markdown(fields: DataFrame) -> DataFrame:
    """doc_id, markdown of doc_id, title, field_order, field_path, value, confidence."""
    body = fields.groupBy("doc_id", "title").agg(ordered_lines(field_line(F.col("field_path"), F.col("value"), F.col("confidence")), F.col("field_order")).alias("body"))
    return body.select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n## Extracted Data\n\n"), F.col("body")).alias("markdown"))


def source_reference(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def seconds(value: Column) -> Column:
    return F.concat(fixed_two(value), F.lit("s"))
