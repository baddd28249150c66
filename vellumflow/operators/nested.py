"""Deeply nested records to flat child tables (problem 3), as one higher-order SQL projection.

JSON becomes VARIANT once. For each array of the declared tree a nested transform attaches the
ancestors' keys and positions to every element, flatten joins the arrays of all parents, and one
inline per target table emits its rows; there is no Python, and the only shuffle drops results
delivered twice. An element carries its path, its parent's path and its position, and of its
object no more than what is looked up below it: keys are normalised once an object, and a table's
own columns are read only where that table is asked for. To emit all tables from one parse, the
arrays are written once as a columnar table, of which each target reads its own column.

Keys match whatever their case and separators. A lone object in an array's place is its element
0, a string that holds a JSON array counts as the array, a null element emits no row but keeps
its position, a Markdown fence is stripped, and a record that isn't one complete JSON value
(null and empty text included) emits nothing. A column whose value doesn't fit its type is null;
numbers may be written as text, with thousands separators. Empty tables give empty results; extra
columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.values import whole_json
from vellumflow.session import staged


@dataclass(frozen=True)
class ArrayNode:
    """An array of objects below its parent: `via` are the plain objects on the way to it, `columns` (name and type) those of its table."""

    name: str
    columns: str
    via: tuple[str, ...] = ()
    children: tuple[ArrayNode, ...] = field(default=())

    @property
    def step(self) -> str:
        return ".".join((*self.via, self.name))

    @property
    def typed(self) -> list[tuple[str, str]]:
        return [tuple(c.strip().split(" ")) for c in self.columns.split(",")]


#: The arrays of objects in extraction_results.extracted_data.
EXTRACTED = (
    ArrayNode(
        "line_items",
        "description string, quantity double, unit_price double, total double",
        children=(ArrayNode("allocations", "cost_center string, share double", children=(ArrayNode("approvals", "step bigint, approved_on string", children=(ArrayNode("comments", "desk string, body string"),)),)),),
    ),
    ArrayNode("contacts", "role string, desk string", via=("vendor",)),
    ArrayNode(
        "experience",
        "company string, title string, location string, start_date string, end_date string, responsibilities array<string>",
        children=(ArrayNode("projects", "name string, tools array<string>", children=(ArrayNode("milestones", "title string, due string"),)),),
    ),
    ArrayNode("education", "institution string, degree string, field string, graduation_date string, gpa double"),
    ArrayNode("employees", "name string, email string, department string, salary double, start_date string", children=(ArrayNode("assignments", "site string, since string"),)),
    ArrayNode("social_health_scores", "year string, score double"),
    ArrayNode("gdp", "year string, gdp double"),
    ArrayNode("years", "year bigint, personal_consumption double, business_capital_spending double, residential_building double, government_spending double, net_exports double"),
)
#: The arrays of objects of form_analyses: the struct array, the objects in its values, and theirs.
FORM = (
    ArrayNode(
        "fields",
        "label string, value string, field_type string, is_handwritten boolean, is_required boolean, position_on_page string",
        children=(ArrayNode("value", "option string, selected boolean", children=(ArrayNode("notes", "by string, on string"),)),),
    ),
)


def _is_object(v: Column) -> Column:
    """Any object casts to a struct of a field that it need not have; nothing of it is copied for that."""
    return v.try_cast("struct<_:boolean>").isNotNull()


def complete_json(text: Column) -> Column:
    """VARIANT of a text that is one complete JSON value, with or without a Markdown fence; else null."""
    bare = F.regexp_replace(text, r"(?s)\A\s*```[A-Za-z0-9_-]*\s*|\s*```\s*\z", "")
    return whole_json(bare)


def _bare(name: str) -> str:
    return name.replace("_", "")


def entries(v: Column, names: list[str]) -> Column:
    """array<struct<k,v>> of an object's non-null values under the given names, compared without case and separators."""
    named = F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e: F.struct(F.lower(F.regexp_replace(e["key"], r"[^\p{L}\p{N}]+", "")).alias("k"), e["value"].alias("v")))
    return F.filter(named, lambda e: e["k"].isin([_bare(n) for n in names]) & ~F.is_variant_null(e["v"]))


def member(found: Column, name: str) -> Column:
    """The first value under a name in what `entries` found."""
    return F.get(F.filter(found, lambda e: e["k"] == _bare(name)), F.lit(0))["v"]


def elements(v: Column) -> Column:
    """array<variant> of an array, a lone object, or a string that holds a JSON array."""
    in_string = complete_json(v.try_cast("string")).try_cast("array<variant>")
    return F.coalesce(v.try_cast("array<variant>"), F.when(_is_object(v), F.array(v)), in_string)


def _value(v: Column, kind: str) -> Column:
    if kind in ("double", "bigint"):
        return F.regexp_replace(v.try_cast("string"), r",(?=[0-9]{3}(?![0-9]))", "").try_cast(kind)
    return v.try_cast(kind)


def _kept(node: ArrayNode, target: str | None) -> list[str]:
    """The names that are looked up in an object of the node: its children's, and its own columns if it is the target."""
    below = [c.via[0] if c.via else c.name for c in node.children]
    return below + [c for c, _ in node.typed if node.name == target]


def _element(node: ArrayNode, prefix: Column, parent: Column, i: Column, v: Column, target: str | None) -> Column:
    path = F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]"))
    kept = _kept(node, target)
    return F.struct(path.alias("path"), parent.alias("parent_path"), i.cast("long").alias("position"), *([entries(v, kept).alias("kept")] if kept else []))


def _array(node: ArrayNode, parents: str, target: str | None) -> Column:
    """array<struct<path, parent_path, position[, kept]>>: one struct for each object of the node's arrays below all parents."""

    def below(p: Column) -> Column:
        inner = reduce(lambda found, name: entries(member(found, name), [node.name]), node.via, p["kept"])
        prefix = F.when(p["path"] == "", F.lit(node.step)).otherwise(F.concat(p["path"], F.lit("." + node.step)))
        placed = F.transform(elements(member(inner, node.name)), lambda x, i: F.struct(i.alias("i"), x.alias("v")))
        objects = F.filter(placed, lambda e: _is_object(e["v"]))
        return F.coalesce(F.transform(objects, lambda e: _element(node, prefix, p["path"], e["i"], e["v"], target)), F.array())

    return F.flatten(F.transform(parents, below))


def with_arrays(df: DataFrame, nodes: tuple[ArrayNode, ...], parents: str, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Adds one array column `t_<name>` a node, parents before children, so that no array is built twice."""
    names: list[str] = []
    for node in nodes:
        df = df.withColumn(f"t_{node.name}", _array(node, parents, target))
        df, below = with_arrays(df, node.children, f"t_{node.name}", target)
        names += [node.name, *below]
    return df, names


def tables_of(nodes: tuple[ArrayNode, ...]) -> dict[str, ArrayNode]:
    """The nodes of a declared tree by name."""
    return {n.name: n for node in nodes for n in (node, *tables_of(node.children).values())}


def _extracted(results: DataFrame, target: str | None = None) -> tuple[DataFrame, list[str]]:
    once = results.select(F.col("result_id").alias("record_id"), "extracted_data").distinct()
    parsed = once.select("record_id", complete_json(F.col("extracted_data")).alias("v")).filter(_is_object(F.col("v")))
    tops = list(dict.fromkeys(n.via[0] if n.via else n.name for n in EXTRACTED))
    root = F.array(F.struct(F.lit("").alias("path"), entries(F.col("v"), tops).alias("kept")))
    return with_arrays(parsed.select("record_id", root.alias("root")), EXTRACTED, "root", target)


def _forms(forms: DataFrame, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """The same from the struct array; only the texts of values are JSON."""
    fields, value = FORM[0], FORM[0].children[0]
    listed = F.filter(F.transform("fields", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: e["v"].isNotNull())
    own = lambda v: F.struct(*[v["position" if c == "position_on_page" else c].alias(c) for c, _ in fields.typed])
    typed = lambda v: [own(v).alias("own")] if target == "fields" else []
    made = F.transform(listed, lambda e: F.struct(F.concat(F.lit("fields["), e["i"].cast("string"), F.lit("]")).alias("path"), F.lit("").alias("parent_path"), e["i"].cast("long").alias("position"), e["v"]["value"].alias("text"), *typed(e["v"])))
    base = forms.select(F.col("form_id").alias("record_id"), made.alias("t_fields"))

    def values(p: Column) -> Column:
        parsed = complete_json(p["text"])
        inner = F.coalesce(parsed.try_cast("array<variant>"), F.when(_is_object(parsed), F.array(parsed)))
        objects = F.filter(F.transform(inner, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: _is_object(e["v"]))
        return F.coalesce(F.transform(objects, lambda e: _element(value, F.concat(p["path"], F.lit(".value")), p["path"], e["i"], e["v"], target)), F.array())

    df, below = with_arrays(base.withColumn("t_value", F.flatten(F.transform("t_fields", values))), value.children, "t_value", target)
    return df, ["fields", "value", *below]


def child_table(source: DataFrame, target: str) -> DataFrame:
    """One target table: record_id, node_path (its key), parent_path (its parent's, null at the top), position, and its typed columns.

    source has result_id and extracted_data, or form_id and fields."""
    ours = target in tables_of(FORM)
    node = tables_of(FORM if ours else EXTRACTED)[target]
    df, _ = (_forms if ours else _extracted)(source, target)
    struct = target == "fields"
    rows = F.transform(
        f"t_{target}",
        lambda s: F.struct(
            s["path"].alias("node_path"), F.nullif(s["parent_path"], F.lit("")).alias("parent_path"), s["position"].alias("position"), *[(s["own"][c] if struct else _value(member(s["kept"], c), kind)).alias(c) for c, kind in node.typed]
        ),
    )
    return df.select("record_id", F.inline(rows))


def child_links(results: DataFrame, forms: DataFrame) -> DataFrame:
    """The keys of all target tables' rows: record_table, record_id, target_table, node_path, parent_path, position.

    Each source is parsed once, into a written table of the target arrays; each target is one inline over its column."""
    parts = []
    for source, (df, names) in (("extraction_results", _extracted(results)), ("form_analyses", _forms(forms))):
        keys = lambda s: F.struct(s["path"].alias("node_path"), F.nullif(s["parent_path"], F.lit("")).alias("parent_path"), s["position"].alias("position"))
        written = staged(df.select("record_id", *[F.transform(f"t_{n}", keys).alias(n) for n in names]))
        parts += [written.select(F.lit(source).alias("record_table"), "record_id", F.lit(n).alias("target_table"), F.inline(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)
