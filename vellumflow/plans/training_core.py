"""Queries of the general training-data problems: 2 (instants), 3 (nested records), 6 (rejects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators import instants, nested, rejects
from vellumflow.plans.registry import Registry
from vellumflow.session import spread, table

registry = Registry()


def _instants(spark: SparkSession, d: str) -> DataFrame:
    return instants.normalise(instants.dated_rows(spread(table(spark, d, "signatures"), "signature_id"), spread(table(spark, d, "employee_rows"), "row_id")))


@registry.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.same_instant_pairs(_instants(spark, d))


@registry.add("p2_instants")
def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).select(F.col("source").alias("record_table"), "record_id", "micros", "layout", F.bround("posterior", 6).alias("posterior"), "status")


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spread(table(spark, d, "extraction_results").select("result_id", "extracted_data"), "result_id"), spread(table(spark, d, "form_analyses").select("form_id", "fields"), "form_id")


def _duck_key(v: str, bare: str) -> str:
    """The value of a JSON object under a key, compared without case and separators."""
    return f"json_extract({v}, '$.\"' || list_filter(json_keys({v}), lambda k: lower(regexp_replace(k, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) = '{bare}' AND json_type(json_extract({v}, '$.\"' || k || '\"')) <> 'NULL')[1] || '\"')"


def _duck_elements(c: str) -> str:
    return f"CASE json_type({c}) WHEN 'ARRAY' THEN CAST({c} AS JSON[]) WHEN 'OBJECT' THEN [{c}] WHEN 'VARCHAR' THEN CASE WHEN json_valid({c}->>'$') THEN CASE WHEN json_type({c}->>'$') = 'ARRAY' THEN CAST(CAST({c}->>'$' AS JSON) AS JSON[]) END END END"


def _duck_level(name: str, parent: str, value: str, step: str) -> str:
    """One CTE: the objects of an array below all rows of the parent's."""
    path = f"CASE WHEN path = '' THEN '' ELSE path || '.' END || '{step}[' || i || ']'"
    inner = f"SELECT record_id, path, unnest({_duck_elements('c')}) AS x, generate_subscripts({_duck_elements('c')}, 1) - 1 AS i FROM (SELECT record_id, path, {value} AS c FROM t_{parent})"
    return f"t_{name} AS (SELECT record_id, nullif(path, '') AS parent_path, {path} AS path, CAST(i AS BIGINT) AS position, x AS v FROM ({inner}) WHERE json_type(x) = 'OBJECT')"


def _duck_tree(nodes: tuple[nested.ArrayNode, ...], parent: str) -> list[str]:
    out = []
    for n in nodes:
        value = "v"
        for step in (*n.via, n.name):
            value = _duck_key(value, step.replace("_", ""))
        out += [_duck_level(n.name, parent, value, n.step), *_duck_tree(n.children, n.name)]
    return out


_FENCED = r"regexp_replace({}, '(?s)^\s*```[A-Za-z0-9_-]*\s*|\s*```\s*$', '', 'g')"
_DUCK_RECORDS = f"""raw AS (SELECT DISTINCT result_id AS record_id, {_FENCED.format('extracted_data')} AS t FROM extraction_results), t_root AS (SELECT record_id, '' AS path, CAST(t AS JSON) AS v FROM raw WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END), """ + ", ".join(_duck_tree(nested.EXTRACTED, "root"))
_DUCK_FORMS = (
    f"""f AS (SELECT form_id AS record_id, unnest(fields) AS f, generate_subscripts(fields, 1) - 1 AS i FROM form_analyses), t_fields AS (SELECT record_id, CAST(NULL AS VARCHAR) AS parent_path, 'fields[' || i || ']' AS path, CAST(i AS BIGINT) AS position, f FROM f WHERE f IS NOT NULL),
    texts AS (SELECT record_id, path, {_FENCED.format('f.value')} AS t FROM t_fields), parsed AS (SELECT record_id, path, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) IN ('ARRAY', 'OBJECT') THEN CAST(t AS JSON) END END AS v FROM texts),
    """ + _duck_level("value", "parsed", "v", "value").replace("FROM t_parsed", "FROM parsed") + ", " + ", ".join(_duck_tree(nested.FORM[0].children[0].children, "value"))
)


def _duck_links() -> str:
    parts = [f"SELECT '{source}' AS record_table, record_id, '{n}' AS target_table, path AS node_path, parent_path, position FROM t_{n}" for source, tree in (("extraction_results", nested.EXTRACTED), ("form_analyses", nested.FORM)) for n in nested.tables_of(tree)]
    return f"WITH {_DUCK_RECORDS}, {_DUCK_FORMS} " + " UNION ALL ".join(parts)


def _duck_child(target: str, form: bool) -> str:
    """The table's SQL; lists of texts are compared in the tests instead."""
    node = nested.tables_of(nested.FORM if form else nested.EXTRACTED)[target]

    def column(name: str, kind: str) -> str:
        text = f"({_duck_key('v', name.replace('_', ''))}->>'$')"
        number = f"replace({text}, ',', '')"
        return {"string": text, "double": f"TRY_CAST({number} AS DOUBLE) + 0.0::DOUBLE", "bigint": f"TRY_CAST({number} AS BIGINT)", "boolean": f"TRY_CAST({text} AS BOOLEAN)"}[kind] + f" AS {name}"

    if target == "fields":
        columns = ", ".join(f"f.{'position' if c == 'position_on_page' else c} AS {c}" for c, _ in node.typed)
    else:
        columns = ", ".join(column(c, k) for c, k in node.typed)
    return f"WITH {_DUCK_FORMS if form else _DUCK_RECORDS} SELECT record_id, path AS node_path, parent_path, position, {columns} FROM t_{target}"


@registry.add("p3_found", f"SELECT record_table, record_id, node_path FROM ({_duck_links()})")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_links(*_records(spark, d)).select("record_table", "record_id", "node_path")


@registry.add("p3_links", _duck_links())
def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_links(*_records(spark, d))


def _child(target: str, form: bool) -> None:
    lists = any(k.startswith("array") for _, k in nested.tables_of(nested.FORM if form else nested.EXTRACTED)[target].typed)

    @registry.add(f"p3_{target}", None if lists else _duck_child(target, form))
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.child_table(_records(spark, d)[form], target)


for _target in nested.tables_of(nested.EXTRACTED):
    _child(_target, False)
for _target in nested.tables_of(nested.FORM):
    _child(_target, True)


@registry.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(spread(table(spark, d, "csv_lines"), "line_id"), table(spark, d, "csv_files"))


@registry.add("p6_rows")
def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    return rejects.typed_rows(spread(table(spark, d, "csv_lines"), "line_id"), table(spark, d, "csv_files"))
