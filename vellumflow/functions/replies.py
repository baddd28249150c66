"""Replies of model-backed steps brought to fixed shapes: column builders over VARIANT, no Python.

A reply is text. `reply_object` finds its JSON object, and a shape (a struct column) reads the
fields with their defaults. What a reply calls true, blank or a number follows the rules of the
dynamic language that replies are written for: a value counts if it isn't null, false, zero or
empty, and texts are trimmed at both ends. Null replies and replies without an object give null
or the shape's defaults, as each builder says; unknown fields are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumflow.functions.text import literal_map
from vellumflow.functions.values import clamped, let, whole_json

Builder = Callable[[Column], Column]

# The words that replies may use.
LEVELS = ("high", "medium", "low")
STAMP_TYPES = ("company_seal", "notary", "certification", "watermark")
ANNOTATION_TYPES = ("margin_note", "correction", "answer", "signature_text", "comment", "label", "other")
WRITING_STYLES = ("cursive", "print", "mixed", "unknown")
OBJECT_TYPES = ("product", "item", "equipment", "damage", "vehicle", "property", "document", "person", "other")
CONDITIONS = ("excellent", "good", "fair", "poor", "damaged")
LOGO_TYPES = ("company_logo", "certification_badge", "official_seal", "brand_mark", "trade_mark")
MATH_TYPES = ("equation", "chemical_formula", "matrix", "notation", "mixed")
FIELD_TYPES = ("text", "checkbox", "radio", "dropdown", "signature", "date")
NODE_TYPES = ("start", "end", "process", "decision", "data", "entity", "component", "actor", "other")
EDGE_TYPES = ("directed", "bidirectional", "hierarchical")
TICKED, UNTICKED = ("true", "checked", "yes", "selected", "x", "✓", "☑"), ("false", "unchecked", "no", "unselected", "", "☐")
ISSUE_TYPES = ("missing_required_field", "low_confidence", "schema_violation", "logical_inconsistency", "incomplete_value", "type_mismatch", "format_error", "empty_array", "null_value", "potential_hallucination")
SEVERITIES = ("critical", "high", "medium", "low")
CHALLENGES = ("complex_table", "multi_column", "nested_layout", "handwritten_text", "chart_graph", "mixed_content", "low_quality_image", "dense_text", "sparse_content", "multilingual", "large_document")
CHALLENGE_ALIASES = {"table": "complex_table", "tables": "complex_table", "multi-column": "multi_column", "multicolumn": "multi_column", "chart": "chart_graph", "charts": "chart_graph", "graph": "chart_graph", "image": "low_quality_image", "nested": "nested_layout", "large": "large_document", "dense": "dense_text"}
_NOTHING = ("null", '""', "false", "0", "0.0", "[]", "{}")


# ---- values -------------------------------------------------------------------------------
def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def counts(v: Column) -> Column:
    """Does a value say anything?"""
    return F.coalesce(~F.to_json(v).isin(*_NOTHING), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.to_json(v).startswith('"'), F.lit(False))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def as_text(v: Column) -> Column:
    plain = F.to_json(v)
    return F.when(plain == "true", "True").when(plain == "false", "False").when(plain == "null", "None").otherwise(v.try_cast("string"))


def text(v: Column) -> Column:
    """Trimmed text of a value that says something, else null."""
    return F.when(counts(v), F.nullif(stripped(as_text(v)), F.lit("")))


def text_or_empty(v: Column) -> Column:
    return F.when(counts(v), stripped(as_text(v))).otherwise("")


def string(v: Column) -> Column:
    """Trimmed text of what is text already, else null."""
    return F.when(is_text(v), F.nullif(stripped(v.try_cast("string")), F.lit("")))


def string_or_empty(v: Column) -> Column:
    return F.coalesce(string(v), F.lit(""))


def word(allowed: Sequence[str], default: str | None) -> Builder:
    def build(v: Column) -> Column:
        found = F.lower(as_text(v))
        return F.when(counts(v) & found.isin(*allowed), found).otherwise(F.lit(default).cast("string"))

    return build


def spoken(allowed: Sequence[str], missing: str, default: str) -> Builder:
    """The same where a missing field reads as `missing` and anything else unknown as `default`."""

    def build(v: Column) -> Column:
        found = F.lower(F.coalesce(as_text(v), F.lit(missing)))
        return F.when(found.isin(*allowed), found).otherwise(default)

    return build


def strings(v: Column) -> Column:
    """The texts in a list that say something; null for none, and for what is no list."""
    found = F.filter(F.transform(v.try_cast("array<variant>"), text), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def whole(v: Column) -> Column:
    """A whole number of a number (cut), a flag, or digits as text; else null."""
    plain, inner = F.to_json(v), F.trim(v.try_cast("string"))
    return F.when(plain.startswith('"'), F.when(inner.rlike(r"\A[+-]?[0-9]+\z"), inner.try_cast("bigint"))).when(plain == "true", 1).when(plain == "false", 0).otherwise(v.try_cast("double").try_cast("bigint"))


def number(v: Column, default: float) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(default))


def objects(v: Column) -> Column:
    """array<variant> of the objects in a list; null if it is no list."""
    return F.filter(v.try_cast("array<variant>"), lambda x: x.try_cast("struct<_:boolean>").isNotNull())


def shaped(v: Column, shape: Mapping[str, Builder]) -> Column:
    return F.struct(*[let(field(v, name), build).alias(name) for name, build in shape.items()])


def shaped_list(shape: Mapping[str, Builder], needs: Sequence[str] = ()) -> Builder:
    """Each object of a list in its shape, without those that lack a needed field; an empty list for what is no list."""

    def build(v: Column) -> Column:
        kept = F.filter(objects(v), lambda o: _all(counts(field(o, n)) for n in needs)) if needs else objects(v)
        made = F.transform(kept, lambda o: shaped(o, shape))
        return F.coalesce(made, F.array())

    return build


def _all(tests) -> Column:  # noqa: ANN001
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _attributes(v: Column) -> Column:
    kept = F.map_filter(v.try_cast("map<string,variant>"), lambda k, x: (k != "") & ~F.is_variant_null(x))
    return F.when(F.size(kept) > 0, F.transform_values(kept, lambda _, x: as_text(x)))


def _variables(v: Column) -> Column:
    named = F.filter(F.map_entries(v.try_cast("map<string,variant>")), lambda e: ~F.is_variant_null(e["value"]))
    told = F.filter(F.transform(named, lambda e: F.struct(stripped(e["key"]).alias("key"), stripped(as_text(e["value"])).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.when(F.size(told) > 0, F.map_from_entries(told))


def as_is(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), v)


# ---- shapes of tool replies ---------------------------------------------------------------
OBJECT = {"object_type": word(OBJECT_TYPES, "other"), "description": text_or_empty, "count": whole, "attributes": _attributes, "confidence": word(LEVELS, "low")}
SIGNATURE = {
    "signature_present": counts, "stamp_present": counts, "is_complete": counts, "signer_name": text, "signer_title": text, "date_signed": text, "location": text,
    "stamp_type": word(STAMP_TYPES, None), "stamp_text": text, "certification_marks": strings, "missing_elements": strings, "notes": text,
}
HANDWRITING = {"transcribed_text": text_or_empty, "confidence": word(LEVELS, "low"), "annotation_type": word(ANNOTATION_TYPES, None), "position": text, "is_legible": counts, "alternative_readings": strings, "style": word(WRITING_STYLES, None), "notes": text}
IMAGE = {"description": text_or_empty, "objects": shaped_list(OBJECT), "total_items": whole, "condition_assessment": word(CONDITIONS, None), "extracted_text": strings, "notes": text}
LOGO = {"logo_type": word(LOGO_TYPES, "brand_mark"), "organization_name": text, "description": text_or_empty, "certification_type": text, "associated_text": strings, "confidence": word(LEVELS, "low"), "notes": text}
MATH = {"content_type": lambda v: spoken(MATH_TYPES, "equation", "equation")(v), "latex": string_or_empty, "plain_text": string_or_empty, "variables": _variables, "notes": string}
NODE = {"id": as_text, "label": lambda v: F.nullif(F.coalesce(as_text(v), F.lit("")), F.lit("")), "node_type": spoken(NODE_TYPES, "other", "other"), "description": string}
EDGE = {"from_node": as_text, "to_node": as_text, "label": string, "connection_type": spoken(EDGE_TYPES, "directed", "directed")}
DIAGRAM = {"nodes": shaped_list(NODE, ["id"]), "connections": shaped_list(EDGE, ["from_node", "to_node"])}
SHAPES = {"signature": SIGNATURE, "handwriting": HANDWRITING, "image": IMAGE, "logo": LOGO, "math": MATH, "diagram": DIAGRAM}


def form_field(label: Column, value: Column, field_type: Column, is_handwritten: Column, is_required: Column, position: Column, value_is_text: Column | bool = True) -> Column:
    """A form field: unknown types are text; ticked and unticked boxes and radios become `checked`, their option texts stay values."""
    kind = F.when(F.lower(field_type).isin(*FIELD_TYPES), F.lower(field_type)).otherwise("text")
    boxed = kind.isin("checkbox", "radio") & F.lit(value_is_text) & value.isNotNull()
    checked = F.when(boxed & F.lower(value).isin(*TICKED), True).when(boxed & F.lower(value).isin(*UNTICKED), False)
    return F.struct(F.coalesce(label, F.lit("Unknown")).alias("label"), F.when(checked.isNull(), value).alias("value"), checked.alias("checked"), kind.alias("field_type"), F.coalesce(is_handwritten, F.lit(False)).alias("is_handwritten"), is_required.alias("is_required"), position.alias("position"))


def form_fields(v: Column) -> Column:
    """The same of a reply's list of fields."""

    def one(o: Column) -> Column:
        value = field(o, "value")
        return form_field(as_text(field(o, "label")), F.when(F.is_variant_null(value), F.lit(None).cast("string")).otherwise(value.try_cast("string")), F.coalesce(as_text(field(o, "field_type")), F.lit("text")), counts(field(o, "is_handwritten")), field(o, "is_required").try_cast("boolean"), field(o, "position").try_cast("string"), is_text(value))

    return F.coalesce(F.transform(objects(v), one), F.array())


def noted(notes: Column, *remarks: tuple[Column, Column]) -> Column:
    """Notes with each remark whose condition holds added behind them: (condition, remark) pairs in order."""
    return F.nullif(F.array_join(F.array_compact(F.array(notes, *[F.when(when, say) for when, say in remarks])), " "), F.lit(""))


def region_notes(notes: Column, region_type: Column, wanted: str, expected: str, spans_pages: Column | None = None) -> Column:
    """What a tool remarks on a region that isn't of the type it is made for, or that goes on over pages."""
    wrong = (region_type != wanted, F.concat(F.lit("Region type is "), region_type, F.lit(f"; expected {expected}.")))
    more = [] if spans_pages is None else [(F.coalesce(spans_pages, F.lit(False)), F.lit("Table spans multiple pages; extraction may be partial."))]
    return noted(notes, wrong, *more)


# ---- whole replies ------------------------------------------------------------------------
def between_braces(reply: Column) -> Column:
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def reply_object(reply: Column) -> Column:
    """STRUCT<object VARIANT, clean, status>: the whole reply, else what stands between its first and its last brace.

    status: 'ok', or 'parse_error' where there is no object; a reply that is sound JSON of another kind is an error as well."""
    is_object = lambda v: v.try_cast("struct<_:boolean>").isNotNull()
    said = lambda clean, found: F.struct(found.alias("object"), is_object(clean).alias("clean"), F.when(found.isNull(), "parse_error").otherwise("ok").alias("status"))
    embedded = F.when(reply.isNotNull(), whole_json(between_braces(reply)))

    def judged(clean: Column) -> Column:
        inner = F.when(clean.isNull(), embedded)
        return let(F.when(is_object(clean), clean).otherwise(let(inner, lambda v: F.when(is_object(v), v))), lambda found: said(clean, found))

    return let(whole_json(reply), judged)


def object_or_raw(reply: Column, preview: int = 200) -> Column:
    """STRUCT<object, raw_response>: tools keep the start of a reply that holds no object."""

    def read(r: Column) -> Column:
        return F.struct(r["object"].alias("object"), F.when(r["object"].isNull(), F.left(reply, F.lit(preview))).alias("raw_response"))

    return let(reply_object(reply), read)


def region_reply(reply: Column) -> Column:
    """STRUCT<content, confidence, reasoning, status>; confidence is clamped only where the reply is nothing but JSON."""

    def read(r: Column) -> Column:
        o = r["object"]
        said = number(field(o, "confidence"), 0.5)
        return F.struct(as_is(field(o, "extracted_content")).alias("content"), F.when(r["clean"], clamped(said)).when(o.isNotNull(), said).alias("confidence"), field(o, "reasoning").try_cast("string").alias("reasoning"), r["status"].alias("status"))

    return let(reply_object(reply), read)


def synthesis_reply(reply: Column) -> Column:
    """STRUCT<data, field_confidence, overall_confidence, reasoning, status>; an embedded object without extracted_data is the data."""

    def read(r: Column) -> Column:
        o = r["object"]
        said, data = number(field(o, "overall_confidence"), 0.5), as_is(field(o, "extracted_data"))
        return F.struct(
            F.when(r["clean"], data).otherwise(F.coalesce(data, o)).alias("data"), field(o, "field_confidence").try_cast("map<string,double>").alias("field_confidence"),
            F.when(r["clean"], clamped(said)).when(o.isNotNull(), said).alias("overall_confidence"), field(o, "reasoning").try_cast("string").alias("reasoning"), r["status"].alias("status"),
        )

    return let(reply_object(reply), read)


ISSUE = {
    "issue_type": lambda v: F.when(F.coalesce(v.try_cast("string"), F.lit("format_error")).isin(*ISSUE_TYPES), v.try_cast("string")).otherwise("format_error"), "field_path": lambda v: F.coalesce(as_text(v), F.lit("unknown")),
    "message": lambda v: F.coalesce(as_text(v), F.lit("Unknown issue")), "severity": spoken(SEVERITIES, "medium", "medium"), "current_value": lambda v: F.when(~F.is_variant_null(v), v.try_cast("string")), "suggestion": lambda v: F.when(~F.is_variant_null(v), v.try_cast("string")),
}


def verification_reply(reply: Column) -> Column:
    """STRUCT<consistency_score, issues, passed_checks, recommendations, analysis, status>: unknown issue types are format errors, unknown severities medium."""

    def read(r: Column) -> Column:
        o = r["object"]
        texts = lambda name: F.coalesce(field(o, name).try_cast("array<string>"), F.array().cast("array<string>"))
        return F.struct(F.when(o.isNotNull(), number(field(o, "consistency_score"), 0.5)).alias("consistency_score"), shaped_list(ISSUE)(field(o, "issues")).alias("issues"), texts("passed_checks").alias("passed_checks"), texts("recommendations").alias("recommendations"), F.coalesce(field(o, "analysis").try_cast("string"), F.lit("")).alias("analysis"), r["status"].alias("status"))

    return let(reply_object(reply), read)


def id_list(v: Column) -> Column:
    """A list of ids, a lone one as a list; null for none."""
    listed = F.coalesce(v.try_cast("array<string>"), F.when(counts(v), F.array(v.try_cast("string"))))
    return F.when(F.size(listed) > 0, listed)


def plan_steps(v: Column) -> Column:
    def one(o: Column, i: Column) -> Column:
        said = lambda name, default: F.coalesce(let(field(o, name), as_text), F.lit(default)).alias(name)
        return F.struct(F.coalesce(let(field(o, "step_number"), whole), (i + 1).cast("bigint")).alias("step_number"), said("action", "Unknown action"), said("target", "Unknown target"), said("strategy", "default"), said("expected_output", ""), field(o, "fallback").try_cast("string").alias("fallback"), let(field(o, "depends_on"), id_list).alias("depends_on"))

    return F.coalesce(F.transform(objects(v), one), F.array())


PRIORITY = {
    "region_type": lambda v: F.coalesce(as_text(v), F.lit("unknown")), "priority": lambda v: F.coalesce(whole(v), F.lit(5).cast("bigint")), "reason": lambda v: F.coalesce(as_text(v), F.lit("")),
    "schema_fields": lambda v: F.coalesce(v.try_cast("array<string>"), F.array().cast("array<string>")),
}


def challenges(names: Column) -> Column:
    """Known challenges of a list of names, by their own or another usual name, in order; unknown ones fall out."""
    alias = F.transform(names, lambda n: F.when(n.isin(*CHALLENGES), n).otherwise(F.element_at(literal_map(CHALLENGE_ALIASES), F.replace(F.lower(n), F.lit("_"), F.lit("-")))))
    return F.array_compact(alias)


def thresholds(v: Column) -> Column:
    return F.struct(
        number(field(v, "min_overall_confidence"), 0.7).alias("min_overall_confidence"), number(field(v, "min_field_confidence"), 0.6).alias("min_field_confidence"), number(field(v, "required_field_coverage"), 0.9).alias("required_field_coverage"),
        F.coalesce(whole(field(v, "max_iterations")), F.lit(3).cast("bigint")).alias("max_iterations"),
    )


def plan_reply(reply: Column) -> Column:
    """STRUCT<steps, region_priorities, challenges, thresholds, status>."""

    def read(r: Column) -> Column:
        o = r["object"]
        return F.struct(plan_steps(field(o, "steps")).alias("steps"), shaped_list(PRIORITY)(field(o, "region_priorities")).alias("region_priorities"), F.coalesce(challenges(field(o, "challenges").try_cast("array<string>")), F.array().cast("array<string>")).alias("challenges"), let(field(o, "quality_thresholds"), thresholds).alias("thresholds"), r["status"].alias("status"))

    return let(reply_object(reply), read)


def agent_reply(structured: Column, messages: Column) -> Column:
    """VARIANT object of an agent's end: its structured response, else the last message that holds an object, else {}."""
    parsed = F.filter(F.transform(messages, lambda m: reply_object(m)["object"]), lambda v: v.isNotNull())
    return F.coalesce(F.when(structured.try_cast("struct<_:boolean>").isNotNull(), structured), F.try_element_at(parsed, F.lit(-1)), F.parse_json(F.lit("{}")))


def token_usage(usages: Column) -> Column:
    """STRUCT<total, prompt, completion> of array<struct<input_tokens, output_tokens>>; messages without usage count nothing."""
    total = lambda name: F.aggregate(F.transform(usages, lambda u: F.coalesce(u[name], F.lit(0)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.struct((total("input_tokens") + total("output_tokens")).alias("total"), total("input_tokens").alias("prompt"), total("output_tokens").alias("completion"))
