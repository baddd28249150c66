"""JSON Schema (a subset of draft 7) compiled on the driver: fields, Spark types, data rules, complexity."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("string", "number", "integer", "boolean", "object", "array", "null")
PII = ("allow", "mask", "hash", "drop")


class SchemaError(ValueError):
    """All problems of a schema as `path: message` lines."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Field:
    name: str
    path: str
    kind: str
    required: bool
    format: str | None = None
    pii: str | None = None
    depth: int = 0
    description: str | None = None
    children: tuple[Field, ...] = field(default=())


def problems(schema: Any, path: str = "root") -> list[str]:
    """Type whitelist through properties, items, additionalProperties and the combinators."""
    if not isinstance(schema, dict):
        return [f"{path}: not an object"]
    out = []
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in TYPES:
            out.append(f"{path}: unknown type {kind!r}")
    if not isinstance(schema.get("required", []), list):
        out.append(f"{path}: required is not a list")
    for name, sub in schema.get("properties", {}).items():
        out += problems(sub, f"{path}.{name}")
    for key in ("items", "additionalProperties"):
        if isinstance(schema.get(key), dict):
            out += problems(schema[key], f"{path}.{key}")
    for key in ("allOf", "anyOf", "oneOf"):
        for i, sub in enumerate(schema.get(key, [])):
            out += problems(sub, f"{path}.{key}[{i}]")
    return out


def _kind(schema: dict[str, Any]) -> str:
    kind = schema.get("type", "any")
    return next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind


def fields(schema: dict[str, Any], parent: str = "", depth: int = 0) -> tuple[Field, ...]:
    out = []
    for name, sub in schema.get("properties", {}).items():
        kind, path = _kind(sub), f"{parent}.{name}" if parent else name
        inner: tuple[Field, ...] = ()
        if kind == "object":
            inner = fields(sub, path, depth + 1)
        elif kind == "array" and _kind(sub.get("items", {})) == "object":
            inner = fields(sub["items"], path + "[]", depth + 1)
        pii = sub.get("pii")
        out.append(Field(name, path, kind, name in schema.get("required", []), sub.get("format"), pii if pii in PII else None, depth, sub.get("description"), inner))
    return tuple(out)


def validated(schema: Any) -> tuple[Field, ...]:
    found = problems(schema)
    if found:
        raise SchemaError(found)
    return fields(schema)


def flat(tree: tuple[Field, ...]) -> list[Field]:
    return [f for top in tree for f in (top, *flat(top.children))]


def fields_table(spark: SparkSession, tree: tuple[Field, ...]) -> DataFrame:
    rows = [(f.path, f.kind, f.required, f.format, f.pii, f.depth) for f in flat(tree)]
    return spark.createDataFrame(rows, "field_path string, kind string, required boolean, format string, pii string, depth int")


def spark_type(schema: dict[str, Any]) -> T.DataType:
    kind = _kind(schema)
    if kind == "object":
        if schema.get("properties"):
            return T.StructType([T.StructField(n, spark_type(s)) for n, s in schema["properties"].items()])
        return T.MapType(T.StringType(), T.StringType())
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {"type": "string"})))
    return {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


_VARIANT_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "integer": ("BIGINT", "DECIMAL(1"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def rules(tree: tuple[Field, ...], data: str) -> Column:
    """array<struct<path, message>> of the violations of a VARIANT column's top level and nested objects."""
    checks: list[Column] = []

    def walk(level: tuple[Field, ...], under: str) -> None:
        for f in level:
            if "[]" in f.path:
                continue
            value = F.try_variant_get(data, f"$.{f.path}", "variant")
            empty = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))
            inside = F.lit(True) if not under else F.try_variant_get(data, f"$.{under}", "variant").isNotNull()
            if f.required:
                checks.append(F.when(inside & empty, F.struct(F.lit(f.path).alias("path"), F.lit("required value is missing").alias("message"))))
            wanted = _VARIANT_KINDS.get(f.kind)
            if wanted:
                found = F.schema_of_variant(value)
                fits = found.rlike("^(" + "|".join(w.replace("(", r"\(") for w in wanted) + ")")
                checks.append(F.when(~empty & ~fits, F.struct(F.lit(f.path).alias("path"), F.concat(F.lit(f"not of type {f.kind}: "), found).alias("message"))))
            if f.kind == "object":
                walk(f.children, f.path)

    walk(tree, "")
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<struct<path:string,message:string>>")


def depth(schema: dict[str, Any], at: int = 0) -> int:
    deepest = at
    for sub in schema.get("properties", {}).values():
        deepest = max(deepest, depth(sub, at + 1))
    return max(deepest, depth(schema["items"], at + 1)) if isinstance(schema.get("items"), dict) else deepest


def complexity(schema: dict[str, Any]) -> str:
    tree = fields(schema)
    everything = flat(tree)
    arrays = any(f.kind == "array" for f in everything)
    of_objects = any(f.kind == "array" and f.children for f in everything)
    if len(tree) > 15 or depth(schema) > 3 or of_objects:
        return "complex"
    return "simple" if len(tree) <= 5 and depth(schema) <= 1 and not arrays else "moderate"


def plan(level: str, pages: int | None = None) -> dict[str, Any]:
    """The fixed plan that needs no model: steps, thresholds and chunking by complexity."""
    t = {"simple": (0.8, 0.7, 0.95, 2)}.get(level, (0.7, 0.6, 0.9, 3))
    return {"steps": ["extract", "verify", "finalise"], "thresholds": dict(zip(("min_confidence", "min_field_confidence", "min_required_coverage", "max_iterations"), t, strict=True)), "chunked": bool(pages and pages > 5)}
