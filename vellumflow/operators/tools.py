"""Steps that ask a model and read its reply: visual tools, region reading, synthesis, verification, plans.

A reply provider maps (prompt, image) to reply text. Providers are registered by name and built once a
Python worker; a failing call is a row with an error, never a failed task. Everything before and
behind the call is column expressions, and calls are checkpointed so that none is made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import records, replies
from vellumflow.operators import outputs, quality
from vellumflow.plans.schema import fields
from vellumflow.session import checkpointed

ReplyProvider = Callable[[str | None, bytes | None], str]
_providers: dict[str, Callable[[], ReplyProvider]] = {}

#: The region type that each visual tool is made for, and how its remark calls it; null where it takes any.
TOOLS: dict[str, tuple[str | None, str]] = {
    "chart": ("picture", "picture/chart"), "table": ("table", "table"), "form": (None, ""), "signature": (None, ""), "diagram": ("picture", "picture/diagram"),
    "handwriting": (None, ""), "image": ("picture", "picture"), "logo": ("picture", "picture"), "math": ("formula", "formula"),
}


def register(name: str, factory: Callable[[], ReplyProvider]) -> None:
    _providers[name] = factory


def silent() -> ReplyProvider:
    """The provider without a model: an empty object, from which every shape takes its defaults."""
    return lambda prompt, image: "{}"


register("silent", silent)


def asked(rows: DataFrame, provider: str, prompt: Column, image: Column | None = None) -> DataFrame:
    """rows with reply and call_error."""
    factory = _providers[provider]
    sent = rows.withColumn("_prompt", prompt.cast("string")).withColumn("_image", image if image is not None else F.lit(None).cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", reply string, call_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for part in batches:
            out = []
            for prompt_text, image_bytes in zip(part["_prompt"], part["_image"], strict=True):
                try:
                    out.append((ask(prompt_text, image_bytes), None))
                except Exception as e:  # noqa: BLE001 - a provider may raise anything
                    out.append((None, f"E4001: {e}"))
            yield part.drop(columns=["_prompt", "_image"]).assign(reply=[o[0] for o in out], call_error=[o[1] for o in out])

    return checkpointed(sent.mapInPandas(run, schema))


def analysed(wanted: DataFrame, regions: DataFrame, kind: str, provider: str = "silent", context: Column | None = None) -> DataFrame:
    """doc_id, region_id, result (JSON text), notes, error of regions asked for by id (doc_id, region_id).

    regions: doc_id, region_id, region_type, image (binary), spans_pages; of several with one id the first by
    pos is meant. Unknown ids and regions without an image are rows with an error. context goes into the prompt."""
    expected, called = TOOLS[kind]
    known = regions.groupBy("doc_id", "region_id").agg(F.min_by(F.struct("region_type", "image", "spans_pages"), "pos").alias("r"))
    found = wanted.select("doc_id", "region_id").join(known, ["doc_id", "region_id"], "left").select("doc_id", "region_id", "r.*")
    missing = F.when(F.col("region_type").isNull(), F.concat(F.lit("Unknown region_id: "), F.col("region_id"))).when(F.col("image").isNull(), F.concat(F.lit("Region image not provided for region_id: "), F.col("region_id")))
    marked = found.withColumn("error", missing)
    prompt = F.concat_ws("\n", F.lit(f"analyze {kind}"), context if context is not None else F.lit(None).cast("string"))
    done = asked(marked.filter("error IS NULL").drop("error"), provider, prompt, F.col("image"))
    read = replies.object_or_raw(F.col("reply"))
    v = read["object"]
    if kind in replies.SHAPES:
        body = F.to_json(replies.shaped(F.coalesce(v, F.parse_json(F.lit("{}"))), replies.SHAPES[kind]))
    elif kind == "form":
        body = F.to_json(F.struct(replies.string(replies.field(v, "form_title")).alias("form_title"), replies.form_fields(replies.field(v, "fields")).alias("fields")))
    else:
        body = F.coalesce(F.to_json(v), F.to_json(F.struct(read["raw_response"].alias("raw_response"))))
    own = replies.string(replies.field(v, "notes"))
    notes = own if expected is None else replies.region_notes(own, F.col("region_type"), expected, called, F.col("spans_pages") if kind == "table" else None)
    answered = done.select("doc_id", "region_id", F.when(F.col("call_error").isNull(), body).alias("result"), notes.alias("notes"), F.col("call_error").alias("error"))
    return answered.unionByName(marked.filter("error IS NOT NULL").select("doc_id", "region_id", F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("notes"), "error"))


def read_regions(inputs: DataFrame, provider: str = "silent") -> DataFrame:
    """Region results of results.region_inputs: content (VARIANT), confidence, reasoning, error."""
    prompt = F.concat_ws("\n", F.concat(F.lit("region type: "), F.col("region_type")), F.concat(F.lit("inside: "), F.col("parent_type")), F.concat(F.lit("text: "), F.left("ocr_text", F.lit(4000))))
    done = asked(inputs.drop("image"), provider, prompt) if "image" not in inputs.columns else asked(inputs, provider, prompt, F.col("image"))
    r = replies.region_reply(F.col("reply"))
    return done.select("*", r["content"].alias("content"), r["confidence"].alias("confidence"), r["reasoning"].alias("reasoning"), F.coalesce("call_error", F.nullif(r["status"], F.lit("ok"))).alias("error")).drop("reply", "call_error")


def synthesised(content: DataFrame, schema: Mapping[str, Any], provider: str = "silent") -> DataFrame:
    """doc_id, data (JSON text), field_confidence, overall_confidence, error of doc_id, content (ordered text).

    A document without content gets the all-null record and no call."""
    blank = F.coalesce(F.length(F.trim("content")) == 0, F.lit(True))
    empty = content.filter(blank).select("doc_id", records.skeleton(schema).alias("data"), F.lit(None).cast("map<string,double>").alias("field_confidence"), F.lit(0.0).alias("overall_confidence"), F.lit(None).cast("string").alias("error"))
    prompt = F.concat(F.lit(records.listed(fields(schema)) + "\n\n"), F.col("content"))
    done = asked(content.filter(~blank), provider, prompt)
    s = replies.synthesis_reply(F.col("reply"))
    read = done.select("doc_id", F.to_json(s["data"]).alias("data"), s["field_confidence"].alias("field_confidence"), s["overall_confidence"].alias("overall_confidence"), F.coalesce("call_error", F.nullif(s["status"], F.lit("ok"))).alias("error"))
    return read.unionByName(empty)


def verified(judged: DataFrame, found: DataFrame, data: DataFrame, provider: str = "silent") -> tuple[DataFrame, DataFrame]:
    """(reports, issues): a model's verification laid over the rule-based one.

    judged: quality.report; found: issues; data: doc_id, data. The model's consistency replaces the computed
    one, its issues are added unless their type and path are known; where the call or its reply fails, the
    rules stand alone."""
    done = asked(data.select("doc_id", "data"), provider, F.col("data"))
    v = replies.verification_reply(F.col("reply"))
    read = done.select("doc_id", F.when(F.col("call_error").isNull(), v).alias("v"))
    sound = read.filter("v.status = 'ok'")
    said = sound.select("doc_id", F.inline("v.issues")).select("doc_id", "field_path", "issue_type", "severity", F.lit(6).alias("rule"), "message", "suggestion")
    reports = judged.join(sound.select("doc_id", F.col("v.consistency_score").alias("_c"), F.col("v.recommendations").alias("recommendations"), F.col("v.analysis").alias("analysis")), "doc_id", "left")
    return reports.withColumn("consistency", F.coalesce("_c", "consistency")).drop("_c"), quality.merged_issues(found, said)


def planned(documents: DataFrame, provider: str = "silent") -> DataFrame:
    """doc_id, steps, region_priorities, challenges, thresholds, error of doc_id, text: the start of a text stands for it in the prompt."""
    done = asked(documents.select("doc_id", "text"), provider, F.left("text", F.lit(500)))
    p = replies.plan_reply(F.col("reply"))
    return done.select("doc_id", p.alias("p"), F.coalesce("call_error", F.nullif(p["status"], F.lit("ok"))).alias("error")).select("doc_id", "p.steps", "p.region_priorities", "p.challenges", "p.thresholds", "error")


def summarised(results: DataFrame, provider: str | None = None) -> DataFrame:
    """doc_id, markdown, generated_by_model: a model's summary, or the template where there is none or it fails."""
    template = results.withColumn("markdown", outputs.summary_markdown())
    if provider is None:
        return template.select("doc_id", "markdown", F.lit(False).alias("generated_by_model"))
    done = asked(template.select("doc_id", "data", "markdown"), provider, F.col("data"))
    told = F.nullif(F.trim("reply"), F.lit(""))
    return done.select("doc_id", F.coalesce(told, "markdown").alias("markdown"), told.isNotNull().alias("generated_by_model"))


#: What a caller may ask for by name.
ACTIONS: dict[str, Callable[..., Any]] = {"plan": planned, "execute": read_regions, "verify": verified, "synthesise": synthesised, "summarise": summarised}


def dispatch(action: str, *args: Any, **options: Any) -> Any:
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}; known are {', '.join(ACTIONS)}")
    return ACTIONS[action](*args, **options)
