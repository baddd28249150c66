"""Whole JSON records against a compiled schema: paths, cleaning, null stripping, validation, redaction.

Paths that a schema names are column expressions over VARIANT. What goes down a record of any shape
(phones by the nearest name, every string leaf, all violations) can't be one, so it is an Arrow UDF
over JSON text, once a record. Records that are null or no JSON object give null. Keys keep their
order, numbers their spelling as JSON has it; of equal keys the last counts.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from datetime import datetime
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import privacy
from vellumflow.functions.replies import field
from vellumflow.functions.values import DATE_PATTERNS, PIVOT_YEAR, date_shape, is_phone_field
from vellumflow.plans.schema import Field, _kind, fields

Json = Any


# ---- paths over VARIANT -------------------------------------------------------------------
def at_path(v: Column, path: str) -> Column:
    """VARIANT at a dotted path of plain objects; null where a step is missing or null."""
    found = reduce(field, path.split("."), v)
    return F.when(~F.is_variant_null(found), found)


def fanned(v: Column, path: str) -> Column:
    """VARIANT at a path in which `name[]` goes through a list: a list of what each element gives, nulls kept in place."""
    head, _, rest = path.partition("[]")
    if not _:
        return at_path(v, path)
    listed = reduce(field, head.split("."), v).try_cast("array<variant>")
    rest = rest.lstrip(".")
    inner = listed if not rest else F.transform(listed, lambda x: F.coalesce(fanned(x, rest), F.parse_json(F.lit("null"))))
    return F.to_variant_object(inner)


def first_of(v: Column, path: str) -> Column:
    """The same with the first element in place of the list; null for an empty one."""
    for step in path.split("."):
        name = step.removesuffix("[]")
        v = field(v, name)
        if name != step:
            v = F.get(v.try_cast("array<variant>"), F.lit(0))
    return F.when(~F.is_variant_null(v), v)


def field_rows(v: Column, tree: Sequence[Field], confidence: Callable[[Column, str], Column], nested: bool = True) -> Column:
    """array<struct<field_path, value, required, confidence>>: a row for each field, and for those within an object that is there.

    value is text, JSON for objects and lists. confidence gives a field's from its value and path."""

    def row(f: Field) -> Column:
        value = fanned(v, f.path)
        return F.struct(F.lit(f.path).alias("field_path"), value.try_cast("string").alias("value"), F.lit(f.required).alias("required"), confidence(value, f.path).alias("confidence"))

    parts = []
    for f in tree:
        parts.append(F.array(row(f)))
        if nested and f.kind == "object" and f.children:
            inside = fanned(v, f.path).try_cast("struct<_:boolean>").isNotNull()
            parts.append(F.when(inside, F.array(*map(row, f.children))).otherwise(F.array()))
    return F.concat(*parts) if parts else F.array().cast("array<struct<field_path:string,value:string,required:boolean,confidence:double>>")


def stated(value: float | None = None, found: float | None = None, by_path: Column | None = None, default: float | None = None) -> Callable[[Column, str], Column]:
    """Ways to a field's confidence: one for all, one for what was found, or from a map by path with a default."""
    if by_path is not None:
        return lambda _, path: F.coalesce(F.element_at(by_path, path), F.lit(default))
    if found is not None:
        return lambda v, _: F.when(v.isNotNull(), F.lit(found))
    return lambda _, __: F.lit(value).cast("double")


def skeleton(schema: Mapping[str, Json]) -> Column:
    """JSON text of a record in which every field is null, for documents without content."""
    return F.lit(json.dumps(dict.fromkeys(schema.get("properties", {}))))


# ---- plain functions on records -----------------------------------------------------------
def with_path(record: Json, path: str, value: Json) -> Json:
    """The record with a value at a dotted path; missing parents are made, and what is no object on the way is replaced."""
    head, _, rest = path.partition(".")
    own = dict(record) if isinstance(record, dict) else {}
    own[head] = with_path(own.get(head), rest, value) if rest else value
    return own


def default_of(kind: str | Sequence[str]) -> Json:
    return {"array": [], "object": {}}.get(kind if isinstance(kind, str) else kind[0])


@lru_cache(None)
def _strptime(pattern: str) -> str:
    names = {"y": "%Y", "yy": "%y", "M": "%m", "d": "%d", "MMM": "%b", "MMMM": "%B"}
    return re.sub(r"[A-Za-z]+", lambda m: names[m.group()], pattern)


_SHAPES = {p: re.compile(date_shape(p)) for p in DATE_PATTERNS}


def iso_date(value: str) -> str:
    """The first pattern that fits; ISO-shaped text as it is, what can't be read unchanged."""
    bare = value.strip()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", bare):
        return bare
    for pattern, shape in _SHAPES.items():
        if not shape.match(bare):
            continue
        try:
            day = datetime.strptime(bare, _strptime(pattern))
        except ValueError:
            continue
        if pattern.endswith("yy") and day.year >= PIVOT_YEAR:
            day = day.replace(year=day.year - 100)
        return f"{day.year:04d}-{day.month:02d}-{day.day:02d}"
    return value


def e164(value: str) -> str:
    """As far as the digits allow; a blank comes back as it is."""
    bare, digits = value.strip(), re.sub(r"\D", "", value)
    if not bare or not digits:
        return value
    if bare.startswith("+"):
        return "+" + digits
    return "+1" + digits if len(digits) == 10 else "+" + digits if len(digits) >= 11 else value


def coerced(value: Json, kind: str, fmt: str | None = None) -> Json:
    """A value under a schema type; one that doesn't fit stays."""
    if kind == "string":
        if fmt == "date" and isinstance(value, str):
            return iso_date(value)
        return value if isinstance(value, str) else str(value)
    if kind in ("integer", "number") and isinstance(value, (bool, int, float, str)):
        try:
            if kind == "number":
                return float(value) if isinstance(value, str) else value
            return int(float(value)) if isinstance(value, str) else int(value)
        except (ValueError, OverflowError):
            return value
    if kind == "boolean" and not isinstance(value, bool):
        return value.lower() in ("true", "yes", "1") if isinstance(value, str) else bool(value)
    return [value] if kind == "array" and not isinstance(value, list) else value


def phones(value: Json, name: str = "") -> Json:
    """Strings in E.164 wherever the nearest field name is a phone's."""
    if isinstance(value, dict):
        return {k: phones(x, k) for k, x in value.items()}
    if isinstance(value, list):
        return [phones(x, name) for x in value]
    return e164(value) if isinstance(value, str) and name and is_phone_field(name) else value


def cleaned(record: dict[str, Json], tree: Sequence[Field], defaults: bool = True) -> dict[str, Json]:
    """Schema fields first, in type or with their default, then what the record has beside them; phones normalised."""
    out = {f.name: coerced(record[f.name], f.kind, f.format) if record.get(f.name) is not None else default_of(f.kind) if defaults else None for f in tree}
    return phones(out | {k: v for k, v in record.items() if k not in out})


def optional_paths(tree: Sequence[Field]) -> frozenset[str]:
    """Optional fields, and optional ones one level below any field."""
    return frozenset(f.path for top in tree for f in (top, *top.children) if not f.required)


def without_nulls(value: Json, optional: frozenset[str], path: str = "") -> Json:
    """The record without nulls at optional paths; elements of a list have the path `list[]`."""
    if isinstance(value, list):
        return [without_nulls(x, optional, path + "[]") if isinstance(x, dict) else x for x in value]
    if not isinstance(value, dict):
        return value
    at = lambda k: f"{path}.{k}" if path else k
    return {k: without_nulls(v, optional, at(k)) for k, v in value.items() if v is not None or at(k) not in optional}


# ---- validation (draft 7 without references and formats) ----------------------------------
Violation = tuple[tuple[Json, ...], str, str]  # path, keyword, message


_PYTHON = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Json, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("number", "integer"):
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _PYTHON[kind]) if kind in _PYTHON else True


def _same(a: Json, b: Json) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _measures(value: Json, schema: Mapping[str, Json]) -> Iterator[tuple[str, str]]:
    """(keyword, message) of the limits that a value breaks."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for key, broken, words in (
            ("minimum", lambda x: value < x, "less than the minimum of"), ("maximum", lambda x: value > x, "greater than the maximum of"),
            ("exclusiveMinimum", lambda x: value <= x, "less than or equal to the minimum of"), ("exclusiveMaximum", lambda x: value >= x, "greater than or equal to the maximum of"),
        ):
            if key in schema and broken(schema[key]):
                yield key, f"{value!r} is {words} {schema[key]!r}"
        if schema.get("multipleOf") and not math.isclose(value / schema["multipleOf"], round(value / schema["multipleOf"]), abs_tol=1e-9):
            yield "multipleOf", f"{value!r} is not a multiple of {schema['multipleOf']!r}"
    sized = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}.get(type(value))
    if sized:
        least, most = (schema.get(k) for k in sized)
        if least is not None and len(value) < least:
            yield sized[0], f"{value!r} should be non-empty" if least == 1 and not value else f"{value!r} is too short"
        if most is not None and len(value) > most:
            yield sized[1], f"{value!r} is too long"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        yield "pattern", f"{value!r} does not match {schema['pattern']!r}"
    if isinstance(value, list) and schema.get("uniqueItems") and any(_same(a, b) for i, a in enumerate(value) for b in value[:i]):
        yield "uniqueItems", f"{value!r} has non-unique elements"


_MEASURED = frozenset(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "pattern", "uniqueItems"))


def violations(value: Json, schema: Json, path: tuple[Json, ...] = ()) -> Iterator[Violation]:
    """Every violation, keyword by keyword in the schema's order."""
    if schema is False:
        yield path, "false", f"False schema does not allow {value!r}"
    if not isinstance(schema, dict):
        return
    known = schema.get("properties", {})
    limits = dict(_measures(value, schema)) if not _MEASURED.isdisjoint(schema) else {}
    for key, rule in schema.items():
        if key in limits:
            yield path, key, limits[key]
        elif key == "type":
            kinds = rule if isinstance(rule, list) else [rule]
            if not any(_is(value, k) for k in kinds):
                yield path, key, f"{value!r} is not of type {', '.join(map(repr, kinds))}"
        elif key == "enum" and not any(_same(value, x) for x in rule):
            yield path, key, f"{value!r} is not one of {rule!r}"
        elif key == "const" and not _same(value, rule):
            yield path, key, f"{rule!r} was expected"
        elif key in ("allOf", "anyOf", "oneOf"):
            fits = [not any(True for _ in violations(value, sub, path)) for sub in rule]
            if key == "allOf":
                for sub in rule:
                    yield from violations(value, sub, path)
            elif not any(fits) or (key == "oneOf" and sum(fits) > 1):
                yield path, key, f"{value!r} is not valid under any of the given schemas" if not any(fits) else f"{value!r} is valid under each of {', '.join(repr(s) for s, ok in zip(rule, fits, strict=True) if ok)}"
        elif key == "not" and not any(True for _ in violations(value, rule, path)):
            yield path, key, f"{value!r} should not be valid under {rule!r}"
        elif isinstance(value, dict):
            if key == "properties":
                for name, sub in rule.items():
                    if name in value:
                        yield from violations(value[name], sub, (*path, name))
            elif key == "required":
                yield from ((path, key, f"{name!r} is a required property") for name in rule if name not in value)
            elif key == "additionalProperties":
                extra = [k for k in value if k not in known]
                if rule is False and extra:
                    yield path, key, f"Additional properties are not allowed ({', '.join(map(repr, extra))} {'was' if len(extra) == 1 else 'were'} unexpected)"
                elif isinstance(rule, dict):
                    for name in extra:
                        yield from violations(value[name], rule, (*path, name))
        elif isinstance(value, list) and key == "items":
            for i, item in enumerate(value):
                yield from violations(item, rule[i] if isinstance(rule, list) and i < len(rule) else {} if isinstance(rule, list) else rule, (*path, i))


def most_telling(found: Iterable[Violation]) -> Violation | None:
    """The one violation that is reported: the least deep, alternatives after the rest, the first of equals."""
    return min(found, key=lambda v: (len(v[0]), v[1] in ("anyOf", "oneOf")), default=None)


def dotted(path: Sequence[Json]) -> str:
    return ".".join(map(str, path)) or "root"


# ---- redaction ----------------------------------------------------------------------------
def masked(value: Json, keep: int) -> Json:
    """Strings, numbers and flags masked, within lists and objects as well."""
    if isinstance(value, dict):
        return {k: masked(v, keep) for k, v in value.items()}
    if isinstance(value, list):
        return [masked(v, keep) for v in value]
    return value if value is None else mask(value if isinstance(value, str) else str(value), keep)


def mask(text: str, keep: int) -> str:
    tail = text[-keep:] if 0 < keep < len(text) else ""
    return "*" * (len(text) - len(tail)) + tail


_SWEEP = tuple(re.compile(p) for p in privacy.TEXT_PATTERNS.values())


class Redaction:
    """Policies by path, then the sweep of every string; counts what it did.

    detector: finds further spans in a text; its failures count as no spans."""

    def __init__(self, tree: Sequence[Field] = (), default: str = "mask", keep: int = privacy.TEXT_KEEPS, salt: str = "", detector: Callable[[str], Iterable[str]] | None = None) -> None:
        self.policies = [(f.path, f.pii or default) for f in tree]
        self.names = {f.name for f in tree}
        self.default, self.keep, self.salt, self.detector = default, keep, salt, detector
        self.counts = dict.fromkeys(METRICS, 0)

    def text(self, text: str) -> str:
        out, hits = text, 0
        for pattern in _SWEEP:
            out, n = pattern.subn(lambda m: mask(m.group(), max(self.keep, privacy.TEXT_KEEPS)), out)
            hits += n
        try:
            spans = list(self.detector(text)) if self.detector else []
        except Exception:  # noqa: BLE001 - a detector may raise anything
            spans = []
        for span in spans:
            if span and span in out:
                out, hits = out.replace(span, mask(span, self.keep)), hits + 1
        self.counts["text_spans_redacted"] += hits
        self.counts["detections"] += hits
        return out

    def swept(self, value: Json) -> Json:
        if isinstance(value, dict):
            return {k: self.swept(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.swept(v) for v in value]
        return self.text(value) if isinstance(value, str) else value

    def treated(self, value: Json, policy: str) -> Json:
        if policy == "allow":
            return value
        self.counts[{"mask": "masked", "hash": "hashed", "drop": "dropped"}[policy]] += 1
        return masked(value, self.keep) if policy == "mask" else hashlib.sha256(f"{self.salt}{value}".encode()).hexdigest() if policy == "hash" else None

    def along(self, value: Json, path: str, policy: str) -> Json:
        """The value with a policy at a path below it; `name[]` goes through a list."""
        if not path:
            return self.treated(value, policy)
        if isinstance(value, list):
            return [self.along(x, path, policy) for x in value]
        step, _, rest = path.partition(".")
        key = step.removesuffix("[]")
        if not isinstance(value, dict) or key not in value:
            return value
        own = value[key]
        if key != step:
            new = [self.along(x, rest, policy) for x in own] if isinstance(own, list) else own
        else:
            new = self.along(own, rest, policy)
        return {k: new if k == key else v for k, v in value.items() if k != key or rest or policy != "drop"}

    def record(self, record: dict[str, Json]) -> dict[str, Json]:
        extra = [(k, self.default) for k in record if k not in self.names] if self.default in privacy.POLICIES else []
        for path, policy in (*self.policies, *extra):
            if policy != "allow" and policy in privacy.POLICIES:
                self.counts["fields_processed"] += (path, policy) not in extra
                record = self.along(record, path, policy)
        return self.swept(record)


METRICS = ("fields_processed", "masked", "hashed", "dropped", "text_spans_redacted", "detections")


# ---- columns ------------------------------------------------------------------------------
def _object(text: str | None) -> dict[str, Json] | None:
    try:
        found = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _written(value: Json) -> str:
    return json.dumps(value, ensure_ascii=False)


def _mapped(run: Callable[[dict[str, Json]], Json]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _written(run(r)) for r in map(_object, texts)], dtype=object)

    return column


def cleaned_record(schema: Mapping[str, Json], defaults: bool = True) -> Callable[[Column], Column]:
    """JSON text -> JSON text with the schema's fields first, typed, defaulted, and phones normalised."""
    tree = fields(schema)
    return _mapped(lambda r: cleaned(r, tree, defaults))


def stripped_record(schema: Mapping[str, Json]) -> Callable[[Column], Column]:
    optional = optional_paths(fields(schema))
    return _mapped(lambda r: without_nulls(r, optional))


_VALIDITY = T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("missing_required", T.ArrayType(T.StringType())), T.StructField("violation", T.StructType([T.StructField("field_path", T.StringType()), T.StructField("message", T.StringType())]))])


def _get(record: Json, path: str) -> Json:
    for key in path.split("."):
        if not isinstance(record, dict) or key not in record:
            return None
        record = record[key]
    return record


def validity(schema: Mapping[str, Json]) -> Callable[[Column], Column]:
    """STRUCT<is_valid, errors, missing_required, violation> of a JSON text.

    errors are all violations as `path: message`; missing_required the required top fields that are
    null; violation is the most telling one once nulls at optional paths are out, null if none."""
    tree = fields(schema)
    required, optional = [f.path for f in tree if f.required], optional_paths(tree)

    def one(r: dict[str, Json] | None) -> Json:
        if r is None:
            return None
        errors = [f"{dotted(p)}: {m}" for p, _, m in violations(r, schema)]
        missing = [p for p in required if _get(r, p) is None]
        worst = most_telling(violations(without_nulls(r, optional), schema)) if errors else None  # fewer nulls break no rule anew
        return {"is_valid": not errors and not missing, "errors": errors, "missing_required": missing, "violation": None if worst is None else {"field_path": dotted(worst[0]), "message": f"Schema validation failed: {worst[2]}"}}

    @F.pandas_udf(_VALIDITY)
    def column(texts: pd.Series) -> pd.DataFrame:
        rows = [one(r) or dict.fromkeys(_VALIDITY.names) for r in map(_object, texts)]
        return pd.DataFrame(rows, columns=_VALIDITY.names)

    return column


def feedback(validity_column: Column) -> Column:
    """What a next attempt is told: missing fields, then violations; empty for a valid record."""
    v = validity_column
    missing = F.when(F.size(v["missing_required"]) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(v["missing_required"], ", "), F.lit(". Please extract values for these fields from the text.")))
    errors = F.when(F.size(v["errors"]) > 0, F.concat(F.lit("Validation errors:\n"), F.array_join(F.transform(v["errors"], lambda e: F.concat(F.lit("- "), e)), "\n")))
    return F.concat_ws("\n\n", missing, errors)


def redacted_record(schema: Mapping[str, Json] | None = None, default: str = "mask", keep: int = privacy.TEXT_KEEPS, salt: str = "", detector: Callable[[str], Iterable[str]] | None = None, enabled: bool = True) -> Callable[[Column, Column], Column]:
    """(JSON text, Markdown text) -> STRUCT<data, markdown, metrics>; not enabled, both come back as they are with zero counts."""
    tree = fields(schema) if schema else ()
    metrics = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])
    result = T.StructType([T.StructField("data", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("metrics", metrics)])

    @F.pandas_udf(result)
    def column(texts: pd.Series, markdowns: pd.Series) -> pd.DataFrame:
        out = []
        for text, markdown in zip(texts, markdowns, strict=True):
            r, job = _object(text), Redaction(tree, default, keep, salt, detector)
            if enabled:
                data = None if r is None else _written(job.record(r))
                markdown = None if markdown is None else job.text(markdown)
            else:
                data = text
            out.append((data, markdown, job.counts))
        return pd.DataFrame(out, columns=result.names)

    return column


def assembled(pairs: Column) -> Column:
    """JSON text of array<struct<field_path, value>>: each value at its dotted path, in order; parents are made."""
    return _assembled(pairs)


@F.pandas_udf(T.StringType())
def _assembled(rows: pd.Series) -> pd.Series:
    return rows.map(lambda pairs: None if pairs is None else _written(reduce(lambda r, p: with_path(r, p["field_path"], p["value"]), pairs, {})))


def described(schema: Mapping[str, Json]) -> str:
    """The schema in words: type, then required and optional fields with their types and descriptions."""
    tree = fields(schema)
    line = lambda f: f"- {f.path} ({f.kind})" + (f" - {f.description}" if f.description else "")
    required, optional = [line(f) for f in tree if f.required], [line(f) for f in tree if not f.required]
    return "\n".join([f"Schema type: {_kind(dict(schema))}", "", *(["Required fields:", *required] if required else []), *(["", "Optional fields:", *optional] if optional else [])])


def listed(tree: Sequence[Field]) -> str:
    """`- path: type - description` lines; None for no fields."""
    return "\n".join(f"- {f.path}: {f.kind}" + (f" - {f.description}" if f.description else "") for f in tree) or "None"

