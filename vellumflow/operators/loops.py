"""Extraction in attempts: retries after failed validation, and refinement from plan to result.

Every pass is cut off with a checkpoint, since a provider may be a model: without it each later use
of a pass would call the model again, and passes would be run again for the ones behind them. Only
documents that need another attempt go on; all passes are kept, and the best is picked at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import records
from vellumflow.operators import providers, quality, results
from vellumflow.plans import schema as S
from vellumflow.session import checkpointed

RETRIES = 3


def extract_valid(documents: DataFrame, schema: Mapping[str, Any], provider: str = "rules", retries: int = RETRIES) -> DataFrame:
    """doc_id, data, validity, retry_count, error: extraction until the cleaned record is valid, at most `retries` times more.

    A next attempt reads the document's text with the feedback behind it; the last attempt stands if none is valid."""
    names = [f.name for f in S.fields(schema)]
    texts, left, done = documents.select("doc_id", "text"), documents.select("doc_id", "text"), []
    for attempt in range(retries + 1):
        found = providers.extract(left, names, provider)
        cleaned = found.select("doc_id", "error", records.cleaned_record(schema)("data").alias("data"))
        judged = checkpointed(cleaned.withColumn("validity", records.validity(schema)("data")).withColumn("retry_count", F.lit(attempt)))
        ended = F.coalesce(F.col("validity.is_valid"), F.lit(False)) | F.lit(attempt == retries)
        done.append(judged.filter(ended))
        left = judged.filter(~ended).select("doc_id", records.feedback(F.col("validity")).alias("_f")).join(texts, "doc_id").select("doc_id", F.concat("text", F.lit("\n\n[IMPORTANT: "), F.col("_f"), F.lit("]")).alias("text"))
    return reduce(DataFrame.unionByName, done).select("doc_id", "data", "validity", "retry_count", "error")


def plan_of(schema: Mapping[str, Any], pages: int | None = None, category: str = "text_based") -> dict[str, Any]:
    """The plan without a model for text of simple or moderate schemas; others need a planner's reply (replies.plan_reply)."""
    level = S.complexity(schema)
    return S.plan(level, pages) | {"complexity": level, "needs_model": category != "text_based" or level == "complex"}


def agentic_loop(documents: DataFrame, schema: Mapping[str, Any], passes: Sequence[str], initial: DataFrame | None = None, category: str = "text_based") -> DataFrame:
    """Plan, extract, verify, refine: one row a document with its best pass.

    initial: results to begin with (doc_id, data), such as those of a visual scan; they count as the
    first pass. doc_id, iterations, best_iteration, converged, data, score, status, complexity, strategy
    (what the last pass's issues call for)."""
    tree = S.fields(schema)
    required, optional = [f.name for f in tree if f.required], [f.name for f in tree if not f.required]
    plan = plan_of(schema, category=category)
    t = plan["thresholds"]
    limits = quality.Thresholds(t["min_confidence"], t["min_field_confidence"], t["min_required_coverage"], t["max_iterations"])
    all_passes = providers.refine(documents, passes, required, optional, limits, initial)
    best = quality.best_pass(all_passes).withColumnRenamed("iteration", "best_iteration")
    counted = all_passes.groupBy("doc_id").agg(F.count("*").alias("iterations"), F.bool_or(F.col("status") == "passed").alias("converged"), F.max_by("issues", "iteration").alias("_issues"))
    kind = results.strategy_of(F.col("_issues"), visual=category == "visual")
    return best.drop("issues").join(counted, "doc_id").withColumn("complexity", F.lit(plan["complexity"])).withColumn("strategy", kind).drop("_issues")
