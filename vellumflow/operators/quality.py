"""Quality of extractions: field metrics, issues, status, scores, best pass and deltas.

A long field table has doc_id, field_path, value, required and confidence; passes add iteration.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions.records import fanned, validity
from vellumflow.functions.text import fixed_two
from vellumflow.plans.schema import Field

SEVERITIES = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Thresholds:
    min_confidence: float = 0.7
    min_field_confidence: float = 0.5
    min_required_coverage: float = 0.9
    max_iterations: int = 3

    def __post_init__(self) -> None:
        if not all(0 <= x <= 1 for x in (self.min_confidence, self.min_field_confidence, self.min_required_coverage)) or not 1 <= self.max_iterations <= 10:
            raise ValueError("thresholds lie in 0..1, iterations in 1..10")


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def metrics(fields: DataFrame, keys: Sequence[str] = ("doc_id",), t: Thresholds = Thresholds(), more: Sequence[Column] = ()) -> DataFrame:  # noqa: B008
    """One row a key: counts, coverages, completeness, confidence (derived where no field states one)."""
    there, required = F.col("value").isNotNull(), F.col("required")
    per = fields.groupBy(*keys).agg(
        F.count("*").alias("total_fields"), F.count_if(there).alias("extracted_fields"), F.count_if(required).alias("required_fields"), F.count_if(required & there).alias("required_extracted"), F.count_if(~required).alias("optional_fields"), F.count_if(~required & there).alias("optional_extracted"),
        F.avg("confidence").alias("stated_confidence"), F.min("confidence").alias("min_confidence"), F.count_if(F.col("confidence") < t.min_field_confidence).alias("low_confidence_fields"), *more,
    )
    per = per.withColumn("schema_coverage", _ratio(F.col("extracted_fields"), F.col("total_fields"), 0.0)).withColumn("required_coverage", _ratio(F.col("required_extracted"), F.col("required_fields"), 1.0)).withColumn("optional_coverage", _ratio(F.col("optional_extracted"), F.col("optional_fields"), 1.0))
    per = per.withColumn("completeness", 0.7 * F.col("required_coverage") + 0.3 * F.col("optional_coverage"))
    return per.withColumn("overall_confidence", F.coalesce("stated_confidence", derived_confidence(F.col("required_coverage"), F.col("schema_coverage"))))


def derived_confidence(required_coverage: Column, coverage: Column) -> Column:
    full = F.when(required_coverage >= 1.0, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 * required_coverage + 0.3 * coverage + 0.1 + full))


def consistency(critical: Column, high: Column, medium: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.3 * critical - 0.15 * high - 0.05 * medium)


def _found(t: Thresholds) -> Column:
    """array of the issues of one field row, in the order of the rules: missing required (critical), low confidence
    (medium, high below half), empty required array (high), null in a required nested field (high; rows may flag it in has_null)."""
    path, sure = F.col("field_path"), F.col("confidence")
    limit = f"{t.min_field_confidence:.2f}"
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rules = (
        (F.col("required") & F.col("value").isNull(), "missing_required_field", F.lit("critical"), text("Required field '", path, "' is missing"), text("Re-extract with focus on finding ", path)),
        (sure < t.min_field_confidence, "low_confidence", F.when(sure < t.min_field_confidence / 2, "high").otherwise("medium"), text("Field '", path, "' has low confidence (", fixed_two(sure), f" < {limit})"), F.lit("Re-extract this field or verify manually")),
        (F.col("required") & (F.regexp_replace("value", r"\s", "") == "[]"), "empty_array", F.lit("high"), text("Required array field '", path, "' is empty"), text("Re-extract to populate ", path, " array")),
    )
    issue = lambda i, when, kind, severity, message, suggestion: F.when(when, F.struct(F.lit(kind).alias("issue_type"), severity.alias("severity"), F.lit(i).alias("rule"), message.alias("message"), suggestion.alias("suggestion")))
    return F.array_compact(F.array(*[issue(i, *r) for i, r in enumerate(rules, 1)]))


def issues(fields: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """doc_id, field_path, issue_type, severity, rule, message, suggestion, in one pass: a field's issues are an array, and what applies is exploded."""
    return fields.select("doc_id", "field_path", F.inline(_found(t)))


def nested_nulls(records: DataFrame, tree: Sequence[Field]) -> DataFrame:
    """Issues (high) of doc_id, v (VARIANT): a required field within a required one that is there holds a null.

    For lists any element's null counts, an empty list doesn't."""
    tests = []
    for top in tree:
        for f in top.children if top.required else ():
            if f.required:
                value, there = fanned(F.col("v"), f.path), fanned(F.col("v"), top.path)
                listed = value.try_cast("array<variant>")
                holds = F.when(listed.isNotNull(), F.exists(listed, lambda x: F.coalesce(F.is_variant_null(x), F.lit(True)))).otherwise(value.isNull()) if "[]" in f.path else value.isNull()
                tests.append(F.when(there.isNotNull() & holds, F.struct(F.lit(f.path).alias("field_path"), F.lit(f"Nested required field '{f.path}' has null value").alias("message"), F.lit(f"Re-extract with focus on {f.path}").alias("suggestion"))))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<struct<field_path:string,message:string,suggestion:string>>")
    return records.select("doc_id", F.inline(found)).select("doc_id", "field_path", F.lit("null_value").alias("issue_type"), F.lit("high").alias("severity"), F.lit(4).alias("rule"), "message", "suggestion")


def schema_issues(records: DataFrame, schema: Mapping[str, Any]) -> DataFrame:
    """The one most telling violation (critical) of doc_id, data (JSON text), nulls at optional paths aside."""
    found = records.select("doc_id", validity(schema)("data")["violation"].alias("_v")).filter(F.col("_v").isNotNull())
    return found.select("doc_id", "_v.field_path", F.lit("schema_violation").alias("issue_type"), F.lit("critical").alias("severity"), F.lit(5).alias("rule"), "_v.message", F.lit("Fix the data to match schema requirements").alias("suggestion"))


def merged_issues(existing: DataFrame, more: DataFrame) -> DataFrame:
    """All of the first, and those of the second whose type and path aren't in it."""
    return existing.unionByName(more.join(existing, ["doc_id", "issue_type", "field_path"], "left_anti"), allowMissingColumns=True)


def of_severity(found: DataFrame, *severities: str) -> DataFrame:
    """Issues of the given severities: 'critical' alone, or 'critical' and 'high' for those to see to first."""
    return found.filter(F.col("severity").isin(*severities))


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in SEVERITIES])


def status(t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    """The ladder over metrics joined with issue counts and consistency."""
    return (
        F.when(F.col("critical_issues") > 0, "failed").when(F.col("required_coverage") < t.min_required_coverage, "failed").when(F.col("overall_confidence") < t.min_confidence, "needs_improvement")
        .when(F.col("high_issues") >= 3, "needs_improvement").when(F.col("consistency") < 0.5, "needs_improvement").otherwise("passed")
    )


def report(fields: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Metrics, issue counts, consistency, status and score of each document, in one aggregate over its fields."""
    listed = fields.withColumn("_issues", _found(t))
    grave = lambda s: F.size(F.filter("_issues", lambda i: i["severity"] == s))
    per_severity = [F.sum(grave(s)).cast("long").alias(f"{s}_issues") for s in SEVERITIES]
    full = metrics(listed, t=t, more=per_severity)
    full = full.withColumn("consistency", consistency(F.col("critical_issues"), F.col("high_issues"), F.col("medium_issues"))).withColumn("status", status(t))
    return full.withColumn("score", score())


def score() -> Column:
    raw = 0.3 * F.col("overall_confidence") + 0.4 * F.col("required_coverage") + 0.2 * F.col("completeness") + 0.1 * F.col("consistency") - 0.2 * F.col("critical_issues") + F.when(F.col("status") == "passed", 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def best_pass(passes: DataFrame, key: str = "doc_id", by: str = "score") -> DataFrame:
    """The pass of the highest score of each document; the earliest of equals."""
    rest = [c for c in passes.columns if c != key]
    return passes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), -F.col("iteration"))).alias("_b")).select(key, "_b.*")


def deltas(passes: DataFrame, columns: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Adds d_<column>, the change since the pass before; null for the first."""
    w = W.partitionBy(key).orderBy("iteration")
    return passes.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns], F.max(columns[0]).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("best_so_far"))


def top_issues(found: DataFrame, limit: int = 10) -> DataFrame:
    """The most severe issues of each document in order, at most `limit`: a report."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(rank, "rule", "field_path"))).filter(F.col("place") <= limit)


def carried_confidence(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fields with the confidence that a refinement gives: new 0.60, found where there was null 0.65, changed 0.70, else as before.

    A nested field that was null and is found counts as changed."""
    was = previous.select("doc_id", "field_path", F.col("value").alias("old"), F.col("confidence").alias("old_confidence"), F.lit(True).alias("known"))
    now = current.drop("confidence").join(was, ["doc_id", "field_path"], "left")
    nested = F.col("field_path").contains(".")
    value = F.when(F.col("known").isNull(), F.when(F.col("value").isNotNull(), 0.60)).when(F.col("value").eqNullSafe(F.col("old")), F.col("old_confidence")).when(F.col("old").isNull() & ~nested, 0.65).otherwise(0.70)
    return now.withColumn("confidence", value).drop("old", "old_confidence", "known")


def refreshed(found: DataFrame, data: DataFrame) -> DataFrame:
    """Issues with current_value from the final data (doc_id, field_path, value) where that has one."""
    final = data.select("doc_id", "field_path", F.col("value").alias("_final"))
    return found.join(final, ["doc_id", "field_path"], "left").withColumn("current_value", F.coalesce("_final", "current_value")).drop("_final")


def concerned_fields(fields: DataFrame, found: DataFrame) -> DataFrame:
    """Schema fields that an issue names."""
    return fields.join(found.select("doc_id", "field_path").distinct(), ["doc_id", "field_path"], "left_semi")
