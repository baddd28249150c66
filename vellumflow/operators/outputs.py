"""What a caller gets: the Markdown summary, combined and API-shaped outputs, prompt parts.

A results table has doc_id, data (JSON text), model_used, processing_time_seconds, prompt_tokens,
completion_tokens, chunks_processed, is_chunked and fields (array<struct<field_path, value,
confidence, source_text, reasoning>>). Rendering goes down records of any shape, so the data section
is an Arrow UDF; all the rest are column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import records
from vellumflow.functions.text import fixed_two, truncated
from vellumflow.operators.render import ordered_lines

FIELDS = "array<struct<field_path:string,value:string,confidence:double,source_text:string,reasoning:string>>"
FOOTER = "*Generated by vellumflow*"


def _inline(record: Mapping[str, Any]) -> str:
    return ", ".join(f"{k}: {v}" for k, v in record.items() if v is not None)


def data_lines(record: Mapping[str, Any], confidence: Mapping[str, float], prefix: str = "", depth: int = 0) -> Iterator[str]:
    """Bullets of a record: objects under a heading and deeper, lists as bullets below their name, nulls as not found."""
    pad = "  " * depth
    for key, value in record.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(value, dict):
            yield from (f"{pad}### {key}", "")
            yield from data_lines(value, confidence, path, depth + 1)
        elif isinstance(value, list):
            yield f"{pad}- **{key}:**"
            yield from (f"{pad}  - {_inline(x) if isinstance(x, dict) else x}" for x in value)
        else:
            sure = confidence.get(path)
            yield f"{pad}- **{key}:** {'*Not found*' if value is None else value}" + ("" if sure is None else f" *(confidence: {sure:.0%})*")


@F.pandas_udf(T.StringType())
def _data_section(data: pd.Series, confidences: pd.Series) -> pd.Series:
    out = []
    for text, pairs in zip(data, confidences, strict=True):
        known: dict[str, float] = {}
        for p in pairs if pairs is not None else ():
            if p["confidence"] is not None:
                known.setdefault(p["field_path"], p["confidence"])
        record = json.loads(text) if text is not None else {}
        out.append("\n".join(data_lines(record if isinstance(record, dict) else {}, known)))
    return pd.Series(out, dtype=object)


def source_references(fields: Column) -> Column:
    """The fields that say where they come from."""
    return F.transform(F.filter(fields, lambda f: F.length(f["source_text"]) > 0), lambda f: F.struct(f["field_path"].alias("field"), f["source_text"].alias("source_text"), f["confidence"].alias("confidence")))


def _lines(*parts: Column) -> Column:
    """Lines joined; a null part is no line."""
    return F.concat_ws("\n", *parts)


def summary_markdown(with_sources: bool = True, with_confidence: bool = True, footer: str = FOOTER) -> Column:
    """Markdown of a results row: title, overview, data, source references, footer."""
    said = lambda label, value: F.concat(F.lit(f"- **{label}:** "), value)
    overview = _lines(
        F.lit("# Extraction Summary\n\n## Overview\n"), said("Model Used", F.coalesce("model_used", F.lit("None"))), said("Processing Time", F.concat(fixed_two(F.col("processing_time_seconds")), F.lit("s"))),
        said("Total Tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).cast("string")), F.when(F.col("is_chunked"), said("Chunks Processed", F.col("chunks_processed").cast("string"))),
    )
    known = F.transform(F.coalesce("fields", F.array().cast(FIELDS)), lambda f: F.struct(f["field_path"].alias("field_path"), (f["confidence"] if with_confidence else F.lit(None).cast("double")).alias("confidence")))
    section = F.nullif(_data_section("data", known), F.lit(""))
    cited = F.transform(source_references(F.col("fields")), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". **"), r["field"], F.lit('**: "'), F.left(r["source_text"], F.lit(100)), F.lit('..."')))
    sources = F.when(F.lit(with_sources) & (F.size(cited) > 0), F.concat(F.lit("\n## Source References\n\n"), F.array_join(cited, "\n")))
    return _lines(overview, F.lit("\n## Extracted Data\n"), section, sources, F.lit(f"\n---\n\n{footer}"))


def field_details(fields: Column, with_sources: bool = True, with_confidence: bool = True) -> Column:
    def line(f: Column) -> Column:
        return F.concat(
            F.lit("- "), f["field_path"], F.lit(": "), F.coalesce(f["value"], F.lit("None")),
            F.coalesce(F.when(F.lit(with_confidence), F.concat(F.lit(" (confidence: "), F.bround(f["confidence"] * 100, 0).cast("int").cast("string"), F.lit("%)"))), F.lit("")),
            F.coalesce(F.when(F.lit(with_sources) & (F.length(f["source_text"]) > 0), F.concat(F.lit('\n  Source: "'), F.left(f["source_text"], F.lit(100)), F.lit('..."'))), F.lit("")),
            F.coalesce(F.when(F.length(f["reasoning"]) > 0, F.concat(F.lit("\n  Reasoning: "), f["reasoning"])), F.lit("")),
        )

    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.array_join(F.transform(fields, line), "\n")).otherwise("No detailed field information available.")


def field_previews(fields: Column, limit: int = 100) -> Column:
    """`- path: confidence=0.85, value=...` lines with values cut at a limit."""
    cut = lambda v: F.when(F.length(v) > limit, F.concat(F.left(v, F.lit(limit)), F.lit("..."))).otherwise(v)
    line = lambda f: F.concat(F.lit("- "), f["field_path"], F.lit(": confidence="), F.when(f["confidence"].isNull(), "N/A").otherwise(fixed_two(f["confidence"])), F.lit(", value="), cut(F.coalesce(f["value"], F.lit("None"))))
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.array_join(F.transform(fields, line), "\n")).otherwise("No field extraction details available.")


def combined(results: DataFrame, schema: Mapping[str, Any], markdown: bool = True, with_sources: bool = True, with_confidence: bool = True) -> DataFrame:
    """Adds cleaned_data, validity, markdown, metadata and source_references: the whole output of a result."""
    out = results.withColumn("cleaned_data", records.cleaned_record(schema)("data"))
    out = out.withColumn("validity", records.validity(schema)("cleaned_data")).withColumn("markdown", summary_markdown(with_sources, with_confidence) if markdown else F.lit(""))
    total = (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens")
    passed = F.col("validity.is_valid").alias("validation_passed")
    retries = F.coalesce(F.col("retry_count"), F.lit(0)) if "retry_count" in results.columns else F.lit(0)
    meta = F.struct("processing_time_seconds", "model_used", "prompt_tokens", "completion_tokens", total, "chunks_processed", "is_chunked", retries.alias("retry_count"), passed)
    return out.withColumn("metadata", meta).withColumn("source_references", source_references(F.col("fields")) if markdown else F.array().cast("array<struct<field:string,source_text:string,confidence:double>>"))


def json_output(combined_rows: DataFrame) -> DataFrame:
    """doc_id, output: the combined output as JSON."""
    body = F.struct(F.try_parse_json("cleaned_data").alias("data"), F.col("markdown"), F.struct("validity.is_valid", "validity.errors", F.col("validity.missing_required").alias("missing_required_fields")).alias("validation"), F.col("metadata"), F.col("source_references"))
    return combined_rows.select("doc_id", F.to_json(body).alias("output"))


def api_response(combined_rows: DataFrame) -> DataFrame:
    """The API's shape: extracted_data, markdown_summary, is_valid, validation_errors, missing_required_fields, metadata."""
    return combined_rows.select("doc_id", F.col("cleaned_data").alias("extracted_data"), F.col("markdown").alias("markdown_summary"), "validity.is_valid", F.col("validity.errors").alias("validation_errors"), F.col("validity.missing_required").alias("missing_required_fields"), "metadata")


# ---- prompt parts -------------------------------------------------------------------------
def region_table(regions: DataFrame) -> DataFrame:
    """doc_id, section: `| id | type | page | confidence |` lines of a document's regions in order."""
    line = F.concat(F.lit("| "), F.col("region_id"), F.lit(" | "), F.col("region_type"), F.lit(" | "), F.col("page").cast("string"), F.lit(" | "), fixed_two(F.col("confidence")), F.lit(" |"))
    return regions.groupBy("doc_id").agg(ordered_lines(line, F.struct("page", "pos", "region_id")).alias("section"))


def sheet_overview(cells: DataFrame) -> DataFrame:
    """path, section: the sheets of a workbook with their sizes; the first is the active one."""
    sizes = cells.groupBy("path", "sheet").agg(F.max("row_idx").alias("rows"), F.max("col_idx").alias("cols"), F.min("sheet_no").alias("no"))
    line = F.format_string("- %s (%d rows x %d cols)", "sheet", "rows", "cols")
    per = sizes.groupBy("path").agg(ordered_lines(line, F.col("no")).alias("lines"), F.min_by("sheet", "no").alias("first"))
    return per.select("path", F.concat(F.lit("## Spreadsheet Overview\nSheets available:\n"), F.col("lines"), F.lit("\nActive sheet: "), F.col("first"), F.lit("\n")).alias("section"))


def extraction_prompt(text: Column, schema: Mapping[str, Any], *sections: Column) -> Column:
    """The document's part of a prompt: cut text, sections that aren't empty, the schema as JSON."""
    kept = [F.nullif(s, F.lit("")) for s in sections]
    return F.concat_ws("\n\n", F.concat(F.lit("## Document Text\n"), truncated(text)), *kept, F.lit("## Target Schema\n" + json.dumps(schema, indent=2)))


def refinement_prompt(prompt: Column, issues: Column, previous: Column) -> Column:
    """The same with what was wrong (array<string>) and the last extraction."""
    return F.concat_ws("\n\n", prompt, F.when(F.size(issues) > 0, F.concat(F.lit("## Issues to Fix\n"), F.array_join(F.transform(issues, lambda i: F.concat(F.lit("- "), i)), "\n"))), F.concat(F.lit("## Previous Extraction\n"), previous))


def combined_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: non-blank parts of a document joined by a blank line, in order of page."""
    parts = F.array_sort(F.collect_list(F.when(F.length(F.trim("text")) > 0, F.struct("page", "text"))))
    return pages.groupBy("doc_id").agg(parts.alias("_p")).select("doc_id", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n").alias("text"))


