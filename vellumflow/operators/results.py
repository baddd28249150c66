"""From regions and judged fields to what a caller gets: model inputs, checks, feedback, result records, the job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import fixed_two
from vellumflow.operators import quality
from vellumflow.operators.render import ordered_lines


def region_inputs(regions: DataFrame, images: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs, failures): regions with their image, text if there is one, and the parent's type; regions without an image fail."""
    keys = ["doc_id", "region_id"]
    parents = regions.select("doc_id", F.col("region_id").alias("parent_region_id"), F.col("region_type").alias("parent_type"))
    inputs = regions.join(images, keys).join(ocr, keys, "left").join(parents, ["doc_id", "parent_region_id"], "left")
    return inputs, regions.join(images, keys, "left_anti").withColumn("error", F.lit("E4001: no image"))


def attachments(regions: DataFrame, documents: DataFrame) -> DataFrame:
    """Tables and pictures; a document without regions gives its whole page as one picture."""
    kept = regions.filter(F.col("region_type").isin("table", "picture")).select("doc_id", "region_id", "region_type", F.lit(1.0).alias("confidence"))
    whole = documents.select("doc_id").join(regions, "doc_id", "left_anti").select("doc_id", F.lit("fallback_full_image").alias("region_id"), F.lit("picture").alias("region_type"), F.lit(1.0).alias("confidence"))
    return kept.unionByName(whole)


def passed_checks(schema_violations: Column | None = None, t: quality.Thresholds = quality.Thresholds()) -> Column:  # noqa: B008
    """What a row of quality.report passes, in words and in fixed order; schema_violations is the number of such issues, none by default."""
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    meets = lambda what, value, limit, show: F.concat(F.lit(f"{what} ("), show(value), F.lit(") meets threshold ("), show(F.lit(limit)), F.lit(")"))
    tests = (
        (F.col("required_coverage") >= t.min_required_coverage, meets("Required field coverage", F.col("required_coverage"), t.min_required_coverage, percent)),
        (F.col("overall_confidence") >= t.min_confidence, meets("Overall confidence", F.col("overall_confidence"), t.min_confidence, fixed_two)),
        ((F.lit(0) if schema_violations is None else schema_violations) == 0, F.lit("Schema validation passed")),
        (F.col("required_extracted") == F.col("required_fields"), F.lit("All required fields present")),
    )
    return F.array_compact(F.array(*[F.when(ok, words) for ok, words in tests]))


def issue_line(with_suggestion: str = " ({})") -> Column:
    """`[SEVERITY] path: message`, with the suggestion as the template says."""
    head, _, tail = with_suggestion.partition("{}")
    return F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("field_path"), F.lit(": "), F.col("message"), F.coalesce(F.concat(F.lit(head), F.col("suggestion"), F.lit(tail)), F.lit("")))


def feedback(found: DataFrame, limit: int = 10) -> DataFrame:
    """doc_id, feedback (lines of the most severe issues), focus_fields (the distinct paths in that order)."""
    top = quality.top_issues(found, limit)
    return top.groupBy("doc_id").agg(ordered_lines(issue_line(), F.col("place")).alias("feedback"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "field_path"))), lambda x: x["field_path"])).alias("focus_fields"))


def refinement_feedback(found: DataFrame, visual: bool = False) -> DataFrame:
    """doc_id, strategy, focus_fields, issues (text of all, by severity): what the next pass is told."""
    placed = quality.top_issues(found, 1 << 30)
    told = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("field_path"), F.lit(": "), F.col("message"), F.lit("\n   Suggestion: "), F.coalesce("suggestion", F.lit("Please address this issue")))
    per = placed.groupBy("doc_id").agg(F.collect_list("issue_type").alias("_k"), ordered_lines(told, F.col("place"), "\n\n").alias("issues"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "field_path"))), lambda x: x["field_path"])).alias("focus_fields"))
    return per.select("doc_id", strategy_of(F.col("_k"), visual).alias("strategy"), "focus_fields", "issues")


def strategy_of(issue_types: Column, visual: bool = False) -> Column:
    """The next pass's strategy by the gravest kind of issue there is (array<string> of types)."""
    ladder = (
        (("missing_required_field", "visual_region_reprocessing"), ("logical_inconsistency", "visual_context_enhanced")) if visual
        else (("missing_required_field", "text_comprehensive_search"), ("schema_violation", "text_type_correction"), ("low_confidence", "text_confidence_boost"), ("logical_inconsistency", "text_consistency_check"))
    )
    known = F.coalesce(issue_types, F.array().cast("array<string>"))
    steps = [F.when(F.array_contains(known, kind), F.lit(name)) for kind, name in ladder]
    return F.coalesce(*steps, F.lit("visual_targeted_refinement" if visual else "text_targeted_refinement"))


def result_records(judged: DataFrame, extracted: DataFrame, markdown: DataFrame | None = None) -> DataFrame:
    """doc_id, result: JSON of data, Markdown summary, status and the quality report."""
    joined = extracted.join(judged, "doc_id")
    joined = joined.join(markdown, "doc_id", "left") if markdown is not None else joined.withColumn("markdown", F.lit(None).cast("string"))
    report = F.struct(*[F.col(c) for c in ("required_coverage", "completeness", "overall_confidence", "consistency", "critical_issues", "high_issues")])
    return joined.select("doc_id", F.to_json(F.struct(F.try_parse_json("data").alias("extracted_data"), F.col("markdown").alias("markdown_summary"), F.col("status"), report.alias("quality_report"))).alias("result"))


def upserted(table: DataFrame, updates: DataFrame, key: str = "job_id", at: str = "updated_at") -> DataFrame:
    """The table with the newest row of each key; a null state deletes it."""
    both = table.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.col("state").isNull(), F.col("state"))).alias("_r")).select(key, "_r.*").filter(F.col("state").isNotNull())
