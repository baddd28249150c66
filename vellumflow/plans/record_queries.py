"""Queries of the operators on records, replies, pages and jobs; replies are made from table columns, so that plain SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import boxes as B
from vellumflow.functions import records, replies
from vellumflow.operators import layout, loops, outputs, quality, results, text_extraction, tools, visual
from vellumflow.plans import schema as S
from vellumflow.plans.registry import Registry
from vellumflow.session import spread, table
from vellumflow.sources import delimited, workbook
from vellumflow.streaming import jobs, lifecycle

registry = Registry()


def _json(**columns: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


# ---- records ------------------------------------------------------------------------------
STAFF = {"type": "object", "properties": {"name": {"type": "string", "pii": "hash"}, "employee_no": {"type": "string", "pii": "mask"}, "department": {"type": "string", "pii": "allow"}, "team": {"type": "object", "properties": {"site": {"type": "string"}}}, "email": {"type": "string", "pii": "drop"}}}


@registry.add(
    "q_redacted_records",
    """SELECT DISTINCT row_id, sha256('salt' || coalesce(name, 'None')) AS name, CASE WHEN length(employee_no) <= 4 THEN repeat('*', length(employee_no)) ELSE repeat('*', length(employee_no) - 4) || right(employee_no, 4) END AS employee_no, department,
    CASE WHEN length(office_tz) <= 4 THEN repeat('*', length(office_tz)) ELSE repeat('*', length(office_tz) - 4) || right(office_tz, 4) END AS site, CASE WHEN length(locale) <= 4 THEN repeat('*', length(locale)) ELSE repeat('*', length(locale) - 4) || right(locale, 4) END AS extra, false AS has_email,
    CAST(3 + 1 AS BIGINT) AS fields_processed FROM employee_rows""",
)
def q_redacted_records(spark: SparkSession, d: str) -> DataFrame:
    """Employees as nested records under field policies; what the schema doesn't name falls under the default policy."""
    rows = spread(table(spark, d, "employee_rows").select("row_id", "name", "employee_no", "department", "office_tz", "locale", "email"), "row_id").distinct()
    record = _json(name="name", employee_no="employee_no", department="department", team=F.struct(F.col("office_tz").alias("site")), email="email", notes=F.array(F.struct(F.col("locale").alias("l"))))
    done = rows.select("row_id", records.redacted_record(STAFF, default="mask", salt="salt")(record, F.lit(None).cast("string")).alias("r"))
    at = lambda p: F.get_json_object("r.data", p)
    return done.select("row_id", at("$.name").alias("name"), at("$.employee_no").alias("employee_no"), at("$.department").alias("department"), at("$.team.site").alias("site"), at("$.notes[0].l").alias("extra"), F.col("r.data").contains('"email"').alias("has_email"), F.col("r.metrics.fields_processed").alias("fields_processed"))


@registry.add("q_redacted_extractions")
def q_redacted_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Every string in every extracted record swept, keys unknown to a schema under the policy 'allow'."""
    rows = spread(table(spark, d, "extraction_results").select("result_id", "extracted_data"), "result_id").distinct()
    return rows.select("result_id", records.redacted_record(None, default="allow")("extracted_data", F.lit(None).cast("string")).alias("r")).select("result_id", F.col("r.data").alias("data"), "r.metrics")


ORDER = {
    "type": "object", "required": ["key", "total"],
    "properties": {"key": {"type": "string"}, "total": {"type": "number", "minimum": 1000}, "placed": {"type": "string", "format": "date"}, "open": {"type": "boolean"}, "pages": {"type": "integer"}, "tags": {"type": "array"}, "phone": {"type": "string"}, "priority": {"type": "string", "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}},
}


def _order_records(spark: SparkSession, d: str) -> DataFrame:
    o = spread(table(spark, d, "orders"), "o_orderkey")
    placed = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy"))
    flag = F.when(F.col("o_orderstatus") == "O", "Yes").otherwise("no")
    return o.select("o_orderkey", _json(key="o_orderkey", total=F.format_string("%.2f", "o_totalprice"), placed=placed, open=flag, pages=F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(".7")), tags="o_orderpriority", phone=F.format_string("(212) 555-%04d", F.col("o_orderkey") % 10000), priority="o_orderpriority", extra=F.lit(1)).alias("record"))


@registry.add(
    "q_cleaned_records",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key, round(o_totalprice, 2) AS total, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS placed, o_orderstatus = 'O' AS is_open, o_custkey % 90 AS pages, '["' || o_orderpriority || '"]' AS tags, '+1212555' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone, 1 AS extra FROM orders""",
)
def q_cleaned_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _order_records(spark, d).select("o_orderkey", records.cleaned_record(ORDER)("record").alias("r"))
    at = lambda n: F.get_json_object("r", f"$.{n}")
    return rows.select("o_orderkey", at("key").alias("key"), at("total").cast("double").alias("total"), at("placed").alias("placed"), (at("open") == "true").alias("is_open"), at("pages").cast("long").alias("pages"), at("tags").alias("tags"), at("phone").alias("phone"), at("extra").cast("int").alias("extra"))


@registry.add(
    "q_record_validity",
    """WITH v AS (SELECT o_orderkey, round(o_totalprice, 2) < 1000 AS low, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS odd, o_orderkey % 3 = 2 AS undated FROM orders)
    SELECT o_orderkey, NOT (low OR odd OR undated) AS is_valid, CAST(low::INT + odd::INT + undated::INT AS BIGINT) AS n_errors, CASE WHEN low THEN 'total' WHEN odd THEN 'priority' END AS violation FROM v""",
)
def q_record_validity(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned records against their schema; a null at an optional path is an error, but not the violation that is reported."""
    v = _order_records(spark, d).select("o_orderkey", records.validity(ORDER)(records.cleaned_record(ORDER)("record")).alias("v"))
    return v.select("o_orderkey", "v.is_valid", F.size("v.errors").cast("long").alias("n_errors"), F.col("v.violation.field_path").alias("violation"))


@registry.add(
    "q_record_paths",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS plain, '[' || o_custkey || ',' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE CAST(o_custkey + 1 AS VARCHAR) END || ']' AS fanned, CAST(o_custkey AS VARCHAR) AS first_one, CAST(NULL AS VARCHAR) AS missing FROM orders""",
)
def q_record_paths(spark: SparkSession, d: str) -> DataFrame:
    item = lambda x: F.struct(x.alias("x"))
    record = _json(a=F.struct(F.col("o_custkey").alias("b")), l=F.array(item(F.col("o_custkey")), item(F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") + 1))))
    rows = table(spark, d, "orders").select("o_orderkey", F.parse_json(record).alias("v"))
    v = F.col("v")
    return rows.select("o_orderkey", records.at_path(v, "a.b").try_cast("string").alias("plain"), F.to_json(records.fanned(v, "l[].x")).alias("fanned"), records.first_of(v, "l[].x").try_cast("string").alias("first_one"), records.at_path(v, "a.b.c").try_cast("string").alias("missing"))


SHIPMENT = {"type": "object", "required": ["vendor", "parts"], "properties": {"vendor": {"type": "object", "required": ["name", "city"], "properties": {"name": {"type": "string"}, "city": {"type": "string"}}}, "parts": {"type": "array", "items": {"type": "object", "required": ["size"], "properties": {"size": {"type": "integer"}}}}, "note": {"type": "string"}}}


def _shipments(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    part = lambda x: F.struct(x.alias("size"))
    record = _json(vendor=F.struct(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "x").alias("city")), parts=F.when(F.col("s_suppkey") % 4 == 0, F.array().cast("array<struct<size:bigint>>")).otherwise(F.array(part(F.col("s_suppkey")), part(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey"))))), note=F.lit(None).cast("string"))
    return s.select(F.col("s_suppkey").alias("doc_id"), record.alias("data"))


@registry.add(
    "q_nested_nulls",
    """SELECT s_suppkey AS doc_id, 'vendor.city' AS field_path, 'null_value' AS issue_type, 'high' AS severity, 'Nested required field ''vendor.city'' has null value' AS message FROM supplier WHERE s_acctbal <= 0
    UNION ALL SELECT s_suppkey, 'parts[].size', 'null_value', 'high', 'Nested required field ''parts[].size'' has null value' FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0""",
)
def q_nested_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = _shipments(spark, d).select("doc_id", F.parse_json("data").alias("v"))
    return quality.nested_nulls(rows, S.fields(SHIPMENT)).select("doc_id", "field_path", "issue_type", "severity", "message")


@registry.add(
    "q_schema_issues",
    """WITH x AS (SELECT s_suppkey AS doc_id, CASE WHEN s_acctbal <= 0 THEN 'vendor.city' WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 THEN 'parts.1.size' END AS field_path, s_acctbal <= 0 AS is_city FROM supplier)
    SELECT doc_id, field_path, 'schema_violation' AS issue_type, 'critical' AS severity, 'Schema validation failed: None is not of type ' || CASE WHEN is_city THEN '''string''' ELSE '''integer''' END AS message FROM x WHERE field_path IS NOT NULL""",
)
def q_schema_issues(spark: SparkSession, d: str) -> DataFrame:
    """At most one violation a record: the one least deep."""
    return quality.schema_issues(_shipments(spark, d), SHIPMENT).select("doc_id", "field_path", "issue_type", "severity", "message")


@registry.add(
    "q_field_rows",
    """WITH s AS (SELECT s_suppkey AS doc_id, s_name, CASE WHEN s_acctbal > 0 THEN 'x' END AS city FROM supplier)
    SELECT doc_id, 'vendor' AS field_path, true AS required, true AS found, 0.85::DOUBLE AS confidence FROM s UNION ALL SELECT doc_id, 'vendor.name', true, true, 0.85 FROM s UNION ALL SELECT doc_id, 'vendor.city', true, city IS NOT NULL, CASE WHEN city IS NOT NULL THEN 0.85 END FROM s
    UNION ALL SELECT doc_id, 'parts', true, true, 0.85 FROM s UNION ALL SELECT doc_id, 'note', false, false, NULL FROM s""",
)
def q_field_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row a schema field and a row for each field of an object that is there."""
    rows = _shipments(spark, d).select("doc_id", F.inline(records.field_rows(F.parse_json("data"), S.fields(SHIPMENT), records.stated(found=0.85))))
    return rows.select("doc_id", "field_path", "required", F.col("value").isNotNull().alias("found"), "confidence")


# ---- replies ------------------------------------------------------------------------------
@registry.add(
    "q_signature_replies",
    """SELECT signature_id, coalesce(signature_present, false) AS signature_present, nullif(regexp_replace(signer_name, '^\\s+|\\s+$', '', 'g'), '') AS signer_name, nullif(regexp_replace(date_signed, '^\\s+|\\s+$', '', 'g'), '') AS date_signed,
    CASE WHEN lower(stamp_type) IN ('company_seal', 'notary', 'certification', 'watermark') THEN lower(stamp_type) END AS stamp_type,
    array_to_string(list_filter(list_transform(missing_elements, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''), '|') AS missing_elements FROM signatures""",
)
def q_signature_replies(spark: SparkSession, d: str) -> DataFrame:
    """Signature readings as a tool's JSON reply with words around it, read back into their shape."""
    names = ("signature_present", "signer_name", "signer_title", "date_signed", "location", "stamp_present", "stamp_type", "stamp_text", "certification_marks", "missing_elements", "is_complete", "notes")
    told = table(spark, d, "signatures").select("signature_id", F.concat(F.lit("Here it is: "), _json(**{n: n for n in names}), F.lit(" (end)")).alias("reply"))
    read = told.select("signature_id", replies.shaped(replies.reply_object(F.col("reply"))["object"], replies.SIGNATURE).alias("s"))
    lost = F.coalesce(F.array_join("s.missing_elements", "|"), F.lit(""))
    return read.select("signature_id", "s.signature_present", "s.signer_name", "s.date_signed", "s.stamp_type", lost.alias("missing_elements")).withColumn("missing_elements", F.when(F.col("missing_elements") != "", F.col("missing_elements")))


@registry.add(
    "q_image_replies",
    """SELECT p_partkey, trim(p_name) AS description, CAST(1 AS BIGINT) AS n_objects, CASE p_size % 3 WHEN 0 THEN 'vehicle' ELSE 'other' END AS object_type, CAST(CASE p_size % 4 WHEN 1 THEN NULL ELSE p_size END AS BIGINT) AS object_count, CAST(trunc(p_retailprice) AS BIGINT) AS total_items, CASE p_size % 2 WHEN 0 THEN 'good' END AS condition FROM part""",
)
def q_image_replies(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    thing = F.struct(F.when(size % 3 == 0, "Vehicle").otherwise("spaceship").alias("object_type"), F.when(size % 4 == 0, size.cast("string")).when(size % 4 == 1, F.concat(size.cast("string"), F.lit(".5"))).otherwise(size.cast("string")).alias("count"))
    reply = _json(description=F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")), objects=F.array(thing), total_items="p_retailprice", condition_assessment=F.when(size % 2 == 0, "GOOD").otherwise("like new"))
    read = table(spark, d, "part").select("p_partkey", replies.shaped(replies.reply_object(reply)["object"], replies.IMAGE).alias("i"))
    o = F.col("i.objects")[0]
    return read.select("p_partkey", "i.description", F.size("i.objects").cast("long").alias("n_objects"), o["object_type"].alias("object_type"), o["count"].alias("object_count"), "i.total_items", F.col("i.condition_assessment").alias("condition"))


@registry.add(
    "q_diagram_replies",
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_nodes, CASE c_custkey % 3 WHEN 0 THEN 'decision' ELSE 'other' END AS node_type, CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_edges, CASE WHEN c_custkey % 7 <> 0 THEN CASE c_custkey % 2 WHEN 0 THEN 'hierarchical' ELSE 'directed' END END AS edge_type FROM customer""",
)
def q_diagram_replies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    node = lambda i, kind: F.struct(i.alias("id"), F.lit("n").alias("label"), kind.alias("node_type"))
    kind = F.when(k % 3 == 0, "DECISION").otherwise("cloud")
    edge = F.struct(F.lit("a").alias("from_node"), F.when(k % 7 != 0, "b").alias("to_node"), F.when(k % 2 == 0, "Hierarchical").otherwise("loose").alias("connection_type"))
    read = table(spark, d, "customer").select("c_custkey", replies.shaped(replies.reply_object(_json(nodes=F.array(node(F.lit("a"), kind), node(F.when(k % 5 != 0, "b"), kind)), connections=F.array(edge)))["object"], replies.DIAGRAM).alias("g"))
    return read.select("c_custkey", F.size("g.nodes").cast("long").alias("n_nodes"), F.col("g.nodes")[0]["node_type"].alias("node_type"), F.size("g.connections").cast("long").alias("n_edges"), F.get("g.connections", F.lit(0))["connection_type"].alias("edge_type"))


def _wrapped(reply: Column) -> Column:
    """Replies as they come: bare, with words around them, or broken off."""
    k = F.col("o_orderkey") % 3
    return F.when(k == 0, reply).when(k == 1, F.concat(F.lit("Sure: "), reply, F.lit("!"))).otherwise(F.substring(reply, 1, 12))


@registry.add(
    "q_region_replies",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN least(1.0::DOUBLE, o_custkey % 30 / 20.0::DOUBLE) WHEN 1 THEN o_custkey % 30 / 20.0::DOUBLE END AS confidence, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS status_read, CASE WHEN o_orderkey % 3 < 2 THEN 'ok' ELSE 'parse_error' END AS status FROM orders""",
)
def q_region_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = _json(extracted_content=F.struct(F.col("o_orderstatus").alias("s")), confidence=F.col("o_custkey") % 30 / 20.0, reasoning=F.lit("r"))
    read = spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", replies.region_reply(_wrapped(reply)).alias("r"))
    return read.select("o_orderkey", "r.confidence", F.try_variant_get("r.content", "$.s", "string").alias("status_read"), "r.status")


@registry.add(
    "q_verification_replies",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey % 11 / 10.0::DOUBLE END AS consistency, CASE WHEN o_orderkey % 3 < 2 THEN CASE o_orderstatus WHEN 'F' THEN 'null_value' ELSE 'format_error' END END AS issue_type, CASE WHEN o_orderkey % 3 < 2 THEN CASE o_orderstatus WHEN 'F' THEN 'high' ELSE 'medium' END END AS severity, CASE WHEN o_orderkey % 3 < 2 THEN 'ok' ELSE 'parse_error' END AS status FROM orders""",
)
def q_verification_replies(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    issue = F.struct(F.when(done, "null_value").otherwise("strange").alias("issue_type"), F.when(done, "HIGH").otherwise("grave").alias("severity"), F.lit("p").alias("field_path"))
    read = spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", replies.verification_reply(_wrapped(_json(issues=F.array(issue), consistency_score=F.col("o_custkey") % 11 / 10.0))).alias("v"))
    first = F.get("v.issues", F.lit(0))
    return read.select("o_orderkey", F.col("v.consistency_score").alias("consistency"), first["issue_type"].alias("issue_type"), first["severity"].alias("severity"), "v.status")


@registry.add(
    "q_plan_replies",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS action, CASE WHEN o_orderkey % 3 < 2 AND o_custkey <> 0 THEN CAST(o_custkey AS VARCHAR) END AS depends_on, CASE WHEN o_orderkey % 3 < 2 THEN 'complex_table,chart_graph' ELSE '' END AS challenges, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey % 5 ELSE 3 END AS max_iterations, 0.6::DOUBLE AS min_field_confidence FROM orders""",
)
def q_plan_replies(spark: SparkSession, d: str) -> DataFrame:
    """A lone dependency is a list of one, and 0 is none."""
    step = F.struct(F.col("o_orderpriority").alias("action"), F.col("o_custkey").alias("depends_on"))
    reply = _json(steps=F.array(step), challenges=F.array(F.lit("Tables"), F.lit("chart_graph"), F.lit("unheard of")), quality_thresholds=F.struct((F.col("o_custkey") % 5).alias("max_iterations")))
    read = spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", replies.plan_reply(_wrapped(reply)).alias("p"))
    first = F.get("p.steps", F.lit(0))
    return read.select("o_orderkey", first["action"].alias("action"), F.get(first["depends_on"], F.lit(0)).alias("depends_on"), F.array_join("p.challenges", ",").alias("challenges"), "p.thresholds.max_iterations", "p.thresholds.min_field_confidence")


@registry.add("q_token_usage", "SELECT extraction_id, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS total FROM (SELECT DISTINCT result_id, extraction_id, prompt_tokens, completion_tokens FROM extraction_results) GROUP BY 1")
def q_token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens over all the messages that led to an extraction's results."""
    rows = table(spark, d, "extraction_results").select("result_id", "extraction_id", "prompt_tokens", "completion_tokens").distinct()
    gathered = rows.groupBy("extraction_id").agg(F.collect_list(F.struct(F.col("prompt_tokens").alias("input_tokens"), F.col("completion_tokens").alias("output_tokens"))).alias("u"))
    return gathered.select("extraction_id", replies.token_usage(F.col("u")).alias("t")).select("extraction_id", "t.prompt", "t.completion", "t.total")


# ---- pages and regions --------------------------------------------------------------------
def _ocr(spark: SparkSession, d: str) -> DataFrame:
    """An order as a page of OCR output: each line item a word. Every third page in the older form."""
    x = (F.col("l_partkey") % 700).cast("double")
    corner = lambda a, b: F.array(a, b)
    points = F.array(corner(x, F.lit(1.0)), corner(x + 9, F.lit(1.0)), corner(x + 9, F.lit(5.0)), corner(x, F.lit(5.0)))
    word = F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat_ws("-", "l_shipmode_", "l_partkey"))
    li = table(spark, d, "lineitem").withColumn("l_shipmode_", F.col("l_linestatus")).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", word.alias("t"), (F.col("l_quantity") / 64).alias("s"), points.alias("p")).alias("w"))
    page = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("w")).alias("w"))
    new = F.to_json(F.array(F.struct(F.col("w.t").alias("rec_texts"), F.col("w.s").alias("rec_scores"), F.col("w.p").alias("rec_polys"))))
    pair = F.transform("w", lambda x: F.concat(F.lit("["), F.to_json(x["p"]), F.lit(","), F.regexp_replace(F.to_json(F.struct(x["t"].alias("t"), x["s"].alias("s"))), r'^\{"t":(.*),"s":(.*)\}$', "[$1,$2]"), F.lit("]")))
    old = F.concat(F.lit("[["), F.array_join(pair, ","), F.lit("]]"))
    return page.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("l_orderkey") % 3 == 0, old).otherwise(new).alias("output"))


@registry.add(
    "q_ocr_pages",
    """SELECT l_orderkey AS doc_id, coalesce(string_agg(CASE WHEN l_returnflag <> 'R' THEN l_linestatus || '-' || l_partkey END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS text, CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS n_elements, round(coalesce(avg(l_quantity / 64) FILTER (l_returnflag <> 'R'), 0), 6) AS confidence, min(CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 700 AS DOUBLE) END) AS left_edge FROM lineitem GROUP BY 1""",
)
def q_ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    p = visual.ocr_pages(_ocr(spark, d))
    return p.select("doc_id", "text", F.size("elements").cast("long").alias("n_elements"), F.round("confidence", 6).alias("confidence"), F.array_min(F.transform("elements", lambda e: e["bbox"]["x0"])).alias("left_edge"))


@registry.add(
    "q_visual_documents",
    """WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey, o_orderstatus FROM orders),
    r AS (SELECT doc_id, page, CASE WHEN o_orderstatus = 'F' THEN 'pdf_native' ELSE 'ocr' END AS method, CASE WHEN o_orderstatus = 'F' THEN 'native ' || o_orderkey WHEN o_orderstatus = 'P' THEN '' ELSE 'w' || o_orderkey END AS text, CASE WHEN o_orderstatus = 'F' THEN 0.9::DOUBLE WHEN o_orderstatus = 'P' THEN 0 ELSE 0.5 END AS conf FROM p)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS total_pages, coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY page), '') AS full_text, CASE WHEN count(DISTINCT method) = 2 THEN 'hybrid' ELSE min(method) END AS method, round(avg(conf), 6) AS confidence FROM r GROUP BY 1""",
)
def q_visual_documents(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as pages: finished ones with native text, the rest through OCR, some of it blank."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderstatus", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    words = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("native").alias("text"), B.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("bbox")))).otherwise(F.array().cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"))
    native = o.select("doc_id", "page", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("native "), F.col("o_orderkey").cast("string"))).otherwise(" ").alias("text"), words.alias("words"))
    said = F.when(F.col("o_orderstatus") == "P", F.lit('[{"rec_texts":[""],"rec_scores":[0.1]}]')).otherwise(F.format_string('[{"rec_texts":["w%d"],"rec_scores":[0.5],"rec_polys":[]}]', "o_orderkey"))
    ocr = o.select("doc_id", "page", said.alias("output"))
    done = visual.visual_documents(visual.routed_pages(native, ocr))
    return done.select("doc_id", "total_pages", "full_text", "method", F.round("confidence", 6).alias("confidence"))


@registry.add(
    "q_layout_items",
    """SELECT o_orderkey AS doc_id, 'item_p1_1' AS region_id, CASE o_orderstatus WHEN 'F' THEN 'picture' WHEN 'O' THEN 'table' ELSE 'unknown' END AS region_type, CASE WHEN o_custkey % 4 = 0 THEN 0.5::DOUBLE ELSE o_custkey % 4 / 4.0::DOUBLE END AS confidence, CAST(o_custkey % 100 AS DOUBLE) AS x0 FROM orders""",
)
def q_layout_items(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "Figure").when(F.col("o_orderstatus") == "O", "table").otherwise("doodle")
    x = (F.col("o_custkey") % 100).cast("double")
    item = F.struct(F.array(F.array(F.lit(1.0)), F.array(x, F.lit(0.0), x + 5, F.lit(9.0))).alias("boxes"), F.array(F.lit("text"), kind).alias("labels"), F.array(F.lit(0.9), F.col("o_custkey") % 4 / 4.0).alias("scores"))
    empty = F.struct(F.array(F.array(F.lit(2.0))).alias("boxes"), F.array(F.lit("text"), F.lit("text")).alias("labels"), F.array(F.lit(0.9), F.lit(0.9)).alias("scores"))
    pages = spread(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.to_json(F.array(empty, item)).alias("output"))
    return visual.item_regions(pages).select("doc_id", "region_id", "region_type", "confidence", F.col("bbox.x0").alias("x0"))


@registry.add(
    "q_detected_regions",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem WHERE l_quantity >= 25)
    SELECT l_orderkey AS doc_id, 'region_p1_' || n AS region_id, (['caption', 'footnote', 'formula', 'list_item', 'page_footer', 'page_header', 'picture', 'section_header', 'table', 'text', 'title'])[CAST(l_partkey % 11 AS INTEGER) + 1] AS region_type, l_quantity / 50 AS confidence FROM k""",
)
def q_detected_regions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = (F.col("l_partkey") % 700).cast("double")
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), pos.alias("pos"), (F.col("l_partkey") % 11).cast("int").alias("label"), (F.col("l_quantity") / 50).alias("score"), B.box(x, x, x + 5, x + 5).alias("bbox"))
    return visual.detected_regions(found).select("doc_id", "region_id", "region_type", "confidence")


def _scored_regions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    page = W.partitionBy("l_orderkey")
    x, y = (F.col("l_partkey") % 700).cast("double"), (F.col("l_suppkey") % 90 * 9).cast("double")
    pos = F.row_number().over(page.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    placed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), pos.alias("pos"), F.count("*").over(page).alias("n"), F.lit("text").alias("region_type"), B.box(x, y, x + 20, y + 8).alias("bbox"), F.lit(1000.0).alias("page_width"), F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(1200.0).alias("page_height"), "l_partkey")
    scores = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.pmod(F.col("l_partkey") * 7919 + i.cast("long") * 104729 + F.col("pos") * 31, F.lit(1009)).cast("double") / 100)
    return placed.select("doc_id", "page", F.concat(F.lit("r"), F.col("pos").cast("string")).alias("region_id"), "pos", "region_type", "bbox", "page_width", "page_height", scores.alias("scores"))


@registry.add("q_model_order")
def q_model_order(spark: SparkSession, d: str) -> DataFrame:
    """Places settled from an order model's scores; pages without a size by rule."""
    return layout.model_order(_scored_regions(spark, d)).select("doc_id", "region_id", "order_index", "skip", F.round("order_confidence", 6).alias("order_confidence"), "source")


@registry.add(
    "q_segments",
    """SELECT l_orderkey AS doc_id, CASE l_linestatus WHEN 'O' THEN 'table' ELSE 'text' END AS region_type, CAST(count(*) AS BIGINT) AS n_members, max(least(1000, CAST(l_partkey % 995 AS INTEGER) + 10 + 3)) AS right_edge FROM lineitem GROUP BY 1, 2""",
)
def q_segments(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("l_partkey") % 995).cast("double")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("pos"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("region_id"), F.when(F.col("l_linestatus") == "O", "table").otherwise("text").alias("region_type"), B.box(x, F.lit(0.0), x + 10, F.lit(9.0)).alias("bbox"), F.lit(1000).alias("page_width"), F.lit(1200).alias("page_height"))
    s = visual.segments(r, 3)
    return s.select("doc_id", "region_type", F.size("members").cast("long").alias("n_members"), F.array_max(F.transform("members", lambda m: m["crop"]["x1"])).alias("right_edge"))


@registry.add(
    "q_extraction_totals",
    """SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n_regions, CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS successful, CAST(sum(l_partkey + l_suppkey) AS BIGINT) AS total_tokens, CAST(count(DISTINCT l_linenumber % 3) AS BIGINT) AS pages, 'Synthesized from ' || count(*) || ' regions across ' || count(DISTINCT l_linenumber % 3) || ' page(s)' AS provenance FROM lineitem GROUP BY 1""",
)
def q_extraction_totals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.when(F.col("l_returnflag") == "R", "E4001").alias("error"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), F.lit(0.1).alias("seconds"))
    return visual.extraction_totals(r).select("doc_id", "n_regions", "successful", "total_tokens", "pages", "provenance")


@registry.add(
    "q_region_lookup",
    """SELECT o_orderkey AS doc_id, 'r' || o_custkey % 4 AS region_id, CASE WHEN o_custkey % 4 = 0 THEN 'Unknown region_id: r0' WHEN o_custkey % 4 = 1 THEN 'Invalid page for region_id: r1' END AS error, CASE WHEN o_custkey % 4 >= 2 THEN 7 END AS right_edge FROM orders""",
)
def q_region_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    wanted = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string")).alias("region_id"))
    known = o.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(f"r{i}").alias("region_id"), F.lit(9 if i == 1 else 1).alias("page")) for i in (1, 2, 3)])))
    regions = known.select("*", F.lit(2).alias("page_count"), B.box(F.lit(2.0), F.lit(2.0), F.lit(7.0), F.lit(7.0)).alias("bbox"), F.lit(100).alias("page_width"), F.lit(100).alias("page_height"))
    return visual.region_images(wanted, regions).select("doc_id", "region_id", "error", F.col("crop.x1").alias("right_edge"))


# ---- outputs ------------------------------------------------------------------------------
def _results(spark: SparkSession, d: str) -> DataFrame:
    o = spread(table(spark, d, "orders"), "o_orderkey")
    said = F.struct(F.lit("status").alias("field_path"), F.col("o_orderstatus").alias("value"), F.lit(0.85).alias("confidence"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("line "), F.col("o_orderkey").cast("string"))).alias("source_text"), F.lit(None).cast("string").alias("reasoning"))
    data = _json(key=F.col("o_orderkey").cast("string"), status="o_orderstatus", buyer=F.struct(F.col("o_custkey").alias("number"), F.lit(None).cast("string").alias("name")), tags=F.array(F.struct(F.col("o_orderpriority").alias("p"), F.lit(None).cast("string").alias("q"))))
    return o.select(F.col("o_orderkey").alias("doc_id"), data.alias("data"), F.lit("rules").alias("model_used"), (F.col("o_custkey") / 8.0).alias("processing_time_seconds"), F.col("o_custkey").alias("prompt_tokens"), F.lit(5).cast("long").alias("completion_tokens"), (F.col("o_custkey") % 3 + 1).alias("chunks_processed"), (F.col("o_custkey") % 3 > 0).alias("is_chunked"), F.array(said).alias("fields"))


@registry.add(
    "q_summary_markdown",
    """SELECT o_orderkey AS doc_id, '# Extraction Summary' || chr(10) || chr(10) || '## Overview' || chr(10) || chr(10) || '- **Model Used:** rules' || chr(10) || '- **Processing Time:** ' || CAST(CAST(o_custkey // 8 AS BIGINT) AS VARCHAR) || (['.00', '.12', '.25', '.38', '.50', '.62', '.75', '.88'])[CAST(o_custkey % 8 AS INTEGER) + 1] || 's' || chr(10) || '- **Total Tokens:** ' || (o_custkey + 5)
      || CASE WHEN o_custkey % 3 > 0 THEN chr(10) || '- **Chunks Processed:** ' || (o_custkey % 3 + 1) ELSE '' END || chr(10) || chr(10) || '## Extracted Data' || chr(10) || chr(10) || '- **key:** ' || o_orderkey || chr(10) || '- **status:** ' || o_orderstatus || ' *(confidence: 85%)*' || chr(10) || '### buyer' || chr(10) || chr(10) || '  - **number:** ' || o_custkey || chr(10) || '  - **name:** *Not found*' || chr(10) || '- **tags:**' || chr(10) || '  - p: ' || o_orderpriority
      || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '## Source References' || chr(10) || chr(10) || '1. **status**: "line ' || o_orderkey || '..."' ELSE '' END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*Generated by vellumflow*' AS markdown FROM orders""",
)
def q_summary_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("doc_id", outputs.summary_markdown().alias("markdown"))


RESULT = {"type": "object", "required": ["key", "owner"], "properties": {"key": {"type": "string"}, "status": {"type": "string", "enum": ["F", "O"]}, "owner": {"type": "string"}}}


@registry.add(
    "q_api_responses",
    """SELECT o_orderkey AS doc_id, false AS is_valid, CAST(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS BIGINT) AS n_errors, 'owner' AS missing, o_custkey + 5 AS total_tokens, true AS has_markdown FROM orders""",
)
def q_api_responses(spark: SparkSession, d: str) -> DataFrame:
    """A required field that no record has: null by default, so it is missing and of the wrong type."""
    r = outputs.api_response(outputs.combined(_results(spark, d), RESULT))
    return r.select("doc_id", "is_valid", F.size("validation_errors").cast("long").alias("n_errors"), F.array_join("missing_required_fields", ",").alias("missing"), "metadata.total_tokens", (F.length("markdown_summary") > 0).alias("has_markdown"))


@registry.add(
    "q_strategies",
    """WITH i AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'missing_required_field' WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'schema_violation' WHEN l_linenumber = 3 THEN 'low_confidence' WHEN l_linenumber = 4 THEN 'logical_inconsistency' ELSE 'format_error' END AS k FROM lineitem)
    SELECT doc_id, CASE WHEN bool_or(k = 'missing_required_field') THEN 'text_comprehensive_search' WHEN bool_or(k = 'schema_violation') THEN 'text_type_correction' WHEN bool_or(k = 'low_confidence') THEN 'text_confidence_boost' WHEN bool_or(k = 'logical_inconsistency') THEN 'text_consistency_check' ELSE 'text_targeted_refinement' END AS text_strategy,
    CASE WHEN bool_or(k = 'missing_required_field') THEN 'visual_region_reprocessing' WHEN bool_or(k = 'logical_inconsistency') THEN 'visual_context_enhanced' ELSE 'visual_targeted_refinement' END AS visual_strategy FROM i GROUP BY 1""",
)
def q_strategies(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when((F.col("l_returnflag") == "R") & (n == 1), "missing_required_field").when((F.col("l_linestatus") == "F") & (n == 2), "schema_violation").when(n == 3, "low_confidence").when(n == 4, "logical_inconsistency").otherwise("format_error")
    kinds = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set(kind).alias("k"))
    return kinds.select("doc_id", results.strategy_of(F.col("k")).alias("text_strategy"), results.strategy_of(F.col("k"), visual=True).alias("visual_strategy"))


@registry.add(
    "q_refined_confidence",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.65 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 END AS confidence, CASE o_orderkey % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 END AS nested_confidence FROM orders""",
)
def q_refined_confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), k.alias("k"))
    paths = F.explode(F.array(F.lit("top"), F.lit("top.inner"))).alias("field_path")
    now = o.select("doc_id", "k", paths).select("doc_id", "field_path", F.when(F.col("k") < 4, "x").alias("value"), F.lit(0.0).alias("confidence"))
    was = o.filter("k < 3").select("doc_id", "k", paths).select("doc_id", "field_path", F.when(F.col("k") == 0, "x").when(F.col("k") == 2, "y").alias("value"), F.lit(0.9).alias("confidence"))
    c = quality.carried_confidence(now, was)
    return c.groupBy("doc_id").agg(F.max(F.when(F.col("field_path") == "top", F.col("confidence"))).alias("confidence"), F.max(F.when(F.col("field_path") != "top", F.col("confidence"))).alias("nested_confidence"))


# ---- loops and tools ----------------------------------------------------------------------
LETTER = {"type": "object", "required": ["Vendor"], "properties": {"Vendor": {"type": "string"}, "Region": {"type": "string"}, "Terms": {"type": "string"}}}


@registry.add("q_valid_extractions")
def q_valid_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extraction with retries on what failed validation; every document has a result."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return loops.extract_valid(docs, LETTER, retries=1).select("doc_id", "data", "validity.is_valid", "retry_count")


@registry.add("q_agentic_loop")
def q_agentic_loop(spark: SparkSession, d: str) -> DataFrame:
    """Strict label rules first, then loose ones on what they left."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return loops.agentic_loop(docs, LETTER, ["rules", "loose_rules"]).select("doc_id", "iterations", "best_iteration", "converged", "status", "strategy", "data")


@registry.add(
    "q_tool_runs",
    """SELECT l_orderkey AS doc_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS region_id, CASE WHEN l_returnflag = 'R' THEN 'Region image not provided for region_id: ' || concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) END AS error,
    CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 1 THEN 'Table spans multiple pages; extraction may be partial.' WHEN l_linestatus <> 'O' THEN 'Region type is text; expected table.' || CASE WHEN l_linenumber % 2 = 1 THEN ' Table spans multiple pages; extraction may be partial.' ELSE '' END END END AS notes FROM lineitem""",
)
def q_tool_runs(spark: SparkSession, d: str) -> DataFrame:
    """The table tool over regions with and without images, by the provider without a model."""
    key = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), key.alias("region_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linestatus") == "O", "table").otherwise("text").alias("region_type"), F.when(F.col("l_returnflag") != "R", F.lit(b"png")).alias("image"), (F.col("l_linenumber") % 2 == 1).alias("spans_pages"))
    return tools.analysed(r.select("doc_id", "region_id"), r, "table").select("doc_id", "region_id", "error", "notes")


@registry.add("q_text_chunks")
def q_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every text in chunks by the ladder of separators."""
    return text_extraction.text_chunks(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"))


@registry.add("q_extracted_texts")
def q_extracted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Label rules over whole texts or their chunks, merged by document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return text_extraction.extract_text(docs, ["Vendor", "Region", "Terms"])


@registry.add(
    "q_position_context",
    """WITH r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 90, l_partkey % 700, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS BIGINT) AS order_index, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey % 90 * 9 + 4 AS yc FROM lineitem)
    SELECT doc_id, order_index, CASE WHEN yc / 1200.0 < 0.33 THEN 'top' WHEN yc / 1200.0 < 0.67 THEN 'middle' ELSE 'bottom' END || '-left of page; Reading order: ' || order_index + 1 || ' of ' || n || CASE WHEN order_index > 0 THEN '; Preceding: ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), CAST(least(3, order_index) AS INTEGER), 'text'), ', ') ELSE '' END || CASE WHEN order_index < n - 1 THEN '; Following: ' || array_to_string(list_resize(CAST([] AS VARCHAR[]), CAST(least(3, n - 1 - order_index) AS INTEGER), 'text'), ', ') ELSE '' END AS position_text FROM r""",
)
def q_position_context(spark: SparkSession, d: str) -> DataFrame:
    """What a region's prompt says about its place."""
    y = (F.col("l_suppkey") % 90 * 9).cast("double")
    x = (F.col("l_partkey") % 700).cast("double") / 10
    key = F.format_string("%09d-%09d-%09d", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("pos"), key.alias("region_id"), F.lit("text").alias("region_type"), B.box(x, y, x + 8, y + 8).alias("bbox"), F.lit(1000.0).alias("page_width"), F.lit(1200.0).alias("page_height"))
    placed = layout.position_context(layout.neighbours(layout.reading_order(r)))
    return placed.select("doc_id", "order_index", "position_text")


# ---- jobs ---------------------------------------------------------------------------------
@registry.add(
    "q_submissions",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 413 WHEN event_id % 5 IN (1, 2, 3) THEN 400 ELSE 202 END AS code, CASE event_id % 5 WHEN 0 THEN 'E1002' WHEN 1 THEN 'E2004' WHEN 2 THEN 'E2001' WHEN 3 THEN 'E2002' END AS error_code, event_id % 5 = 4 AS has_job, CASE WHEN event_id % 5 = 4 THEN '.pdf' END AS landed FROM events""",
)
def q_submissions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    own = F.when(k == 1, "{").when(k == 2, '{"type":"text"}').when(k == 4, '{"type":"object"}')
    up = table(spark, d, "events").select("event_id", F.lit("a.PDF").alias("name"), F.when(k == 0, 10 * 1024 * 1024 + 1).otherwise(10 * 1024 * 1024).alias("length"), own.alias("schema_text"), F.when(k == 4, "{").alias("schema_file_text"), F.lit(False).alias("redact_output"))
    s = lifecycle.submissions(up)
    return s.select("event_id", "code", "error_code", F.col("job_id").isNotNull().alias("has_job"), F.regexp_extract("landed_as", r"(\.\w+)$", 1).alias("landed"))


@registry.add("q_stored_jobs", "SELECT event_id AS job_id, ts AS created_at, ts + INTERVAL 24 HOUR AS expires_at, user_id % 2 = 0 AS redact_output, CAST(7 AS BIGINT) AS n_fields FROM events")
def q_stored_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Job rows written as maps of text and read back."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("job_id"), F.lit("a.pdf").alias("filename"), F.lit("/a").alias("file_path"), F.lit("/s").alias("schema_path"), (F.col("user_id") % 2 == 0).alias("redact_output"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("ts") + F.make_interval(hours=F.lit(24))).cast("timestamp").alias("expires_at"))
    stored = rows.select(lifecycle.stored_row().alias("m"))
    back = stored.select(F.size("m").cast("long").alias("n_fields"), lifecycle.read_row(F.col("m")).alias("j"))
    return back.select(F.col("j.job_id").cast("long").alias("job_id"), F.col("j.created_at").cast("timestamp_ntz").alias("created_at"), F.col("j.expires_at").cast("timestamp_ntz").alias("expires_at"), "j.redact_output", "n_fields")


@registry.add(
    "q_point_reads",
    """WITH n AS (SELECT max(ts) AS now FROM events), w AS (SELECT event_id AS job_id FROM events UNION ALL SELECT -event_id FROM events)
    SELECT w.job_id, CASE WHEN e.event_id IS NULL THEN 404 WHEN now > ts + INTERVAL 24 HOUR THEN 410 ELSE 200 END AS code, CASE WHEN now <= ts + INTERVAL 24 HOUR THEN user_id END AS owner FROM w LEFT JOIN events e ON e.event_id = w.job_id, n""",
)
def q_point_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of known, expired and unknown jobs at the time of the last event."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), (F.col("ts") + F.make_interval(hours=F.lit(24))).alias("expires_at"))
    wanted = e.select(F.col("event_id").alias("job_id")).unionByName(e.select((-F.col("event_id")).alias("job_id")))
    now = e.agg(F.max("ts").alias("now")).scalar()
    return lifecycle.point_reads(wanted, rows, now)[0].select("job_id", "code", "owner")


@registry.add("q_row_documents", "SELECT n_nationkey AS row_no, 'key: ' || n_nationkey || chr(10) || 'name: ' || n_name AS page_content FROM nation")
def q_row_documents(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    rows = n.select(F.lit("nation.csv").alias("path"), F.col("n_nationkey").alias("row_no"), F.array(F.lit("key"), F.lit("name")).alias("columns"), F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("row"), F.lit(",").alias("delimiter"))
    texts = spark.createDataFrame([("nation.csv", "utf-8")], "path string, encoding string")
    return delimited.row_documents(rows, texts).select("row_no", "page_content")


# ---- filters, counts and states -----------------------------------------------------------
@registry.add(
    "q_job_snapshots",
    """SELECT event_id AS job_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 2 HOUR WHEN event_type = 'click' THEN ts + INTERVAL 1 HOUR ELSE ts END AS updated_at FROM events WHERE event_type <> 'view'""",
)
def q_job_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their executions: the state, and the latest moment that is known. Jobs without an execution have none."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    after = lambda h, *kinds: F.when(kind.isin(*kinds), F.col("ts") + F.make_interval(hours=F.lit(h)))
    created = e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"))
    state = F.when(kind == "signup", "queued").when(kind == "click", "running").when(kind == "purchase", "completed").otherwise("lost")
    runs = e.filter(kind != "view").select(F.col("event_id").alias("job_id"), state.alias("state"), after(1, "click", "purchase").alias("started_at"), after(2, "purchase").alias("completed_at"), F.lit(None).cast("timestamp_ntz").alias("progress_at"))
    return jobs.snapshot(created, runs)


@registry.add("q_result_answers", "SELECT event_id AS job_id, CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 500 ELSE 425 END AS code, CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS result FROM events")
def q_result_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    return lifecycle.result_answers(e.select(F.col("event_id").alias("job_id"), status.alias("status")), e.select(F.col("event_id").alias("job_id"), F.col("user_id").cast("string").alias("result")))


def _typed_regions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "O", "table").when(F.col("l_returnflag") == "R", "picture").otherwise("text")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("region_id"), kind.alias("region_type"))


_TYPED = "typed AS (SELECT l_orderkey AS doc_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS region_id, CASE WHEN l_linestatus = 'O' THEN 'table' WHEN l_returnflag = 'R' THEN 'picture' ELSE 'text' END AS region_type FROM lineitem)"


@registry.add("q_regions_of_type", f"WITH {_TYPED} SELECT * FROM typed WHERE region_type IN ('table', 'picture')")
def q_regions_of_type(spark: SparkSession, d: str) -> DataFrame:
    return visual.of_type(_typed_regions(spark, d), "table", "picture")


@registry.add("q_region_type_counts", f"WITH {_TYPED}, n AS (SELECT doc_id, region_type, count(*) AS c FROM typed GROUP BY 1, 2) SELECT doc_id, string_agg(region_type || '=' || c, ',' ORDER BY region_type) AS counts FROM n GROUP BY 1")
def q_region_type_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = layout.type_counts(_typed_regions(spark, d))
    return counted.select("doc_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


_STATES = "f AS (SELECT o_orderkey AS doc_id, 'a' AS field_path, CASE WHEN o_orderstatus = 'O' THEN 'x' END AS value, true AS required, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 10 / 10.0::DOUBLE END AS confidence FROM orders)"


def _status_fields(spark: SparkSession, d: str) -> DataFrame:
    open_ = F.col("o_orderstatus") == "O"
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("a").alias("field_path"), F.when(open_, "x").alias("value"), F.lit(True).alias("required"), F.when(open_, F.col("o_custkey") % 10 / 10.0).alias("confidence"))


@registry.add("q_urgent_issues", f"WITH {_STATES} SELECT doc_id, CASE WHEN value IS NULL THEN 'critical' ELSE 'high' END AS severity FROM f WHERE value IS NULL OR confidence < 0.25")
def q_urgent_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.of_severity(quality.issues(_status_fields(spark, d)), "critical", "high").select("doc_id", "severity")


@registry.add("q_concerned_fields", f"WITH {_STATES} SELECT doc_id, field_path, value FROM f WHERE value IS NULL OR confidence < 0.5")
def q_concerned_fields(spark: SparkSession, d: str) -> DataFrame:
    f = _status_fields(spark, d)
    return quality.concerned_fields(f, quality.issues(f)).select("doc_id", "field_path", "value")


@registry.add("q_refreshed_issues", f"WITH {_STATES} SELECT doc_id, CASE WHEN value IS NULL THEN 'missing_required_field' ELSE 'low_confidence' END AS issue_type, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'final' END, 'before') AS current_value FROM f WHERE value IS NULL OR confidence < 0.5")
def q_refreshed_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues show the final value of their field where there is one."""
    f = _status_fields(spark, d)
    found = quality.issues(f).withColumn("current_value", F.lit("before"))
    return quality.refreshed(found, f.withColumn("value", F.when(F.col("doc_id") % 2 == 0, "final"))).select("doc_id", "issue_type", "current_value")


@registry.add(
    "q_sheet_sizes",
    """SELECT 's' || s_nationkey % 3 AS sheet, CAST(max(s_suppkey + 1) AS BIGINT) AS row_count, CAST(3 AS BIGINT) AS column_count, bool_or(s_acctbal < 0) AS has_formulas, CASE WHEN min(s_suppkey) = 0 THEN 'col_1,col_2,col_3' END AS headers FROM supplier GROUP BY 1""",
)
def q_sheet_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as the cells of three sheets: sizes, formulas, and headers where a first row says anything."""
    cell = lambda i, v, kind: F.struct(F.lit(i).alias("col_idx"), v.cast("string").alias("value"), kind.alias("data_type"))
    made = F.array(cell(1, F.col("s_suppkey"), F.lit("number")), cell(2, F.col("s_name"), F.lit("string")), cell(3, F.col("s_acctbal"), F.when(F.col("s_acctbal") < 0, "formula").otherwise("number")))
    cells = table(spark, d, "supplier").select(F.lit("a.xlsx").alias("path"), F.concat(F.lit("s"), (F.col("s_nationkey") % 3).cast("string")).alias("sheet"), (F.col("s_suppkey") + 1).alias("row_idx"), F.inline(made))
    s = workbook.sheet_sizes(cells)
    return s.select("sheet", F.col("row_count").cast("long").alias("row_count"), F.col("column_count").cast("long").alias("column_count"), "has_formulas", F.array_join("headers", ",").alias("headers"))


@registry.add(
    "q_prompt_previews",
    """SELECT o_orderkey AS doc_id, '- status: confidence=0.85, value=' || o_orderstatus AS previews, '- status: ' || o_orderstatus || ' (confidence: 85%)' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '  Source: "line ' || o_orderkey || '..."' ELSE '' END AS details FROM orders""",
)
def q_prompt_previews(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("doc_id", outputs.field_previews(F.col("fields")).alias("previews"), outputs.field_details(F.col("fields")).alias("details"))


@registry.add(
    "q_refinement_feedback",
    f"""WITH {_STATES} SELECT doc_id, CASE WHEN value IS NULL THEN 'text_comprehensive_search' ELSE 'text_confidence_boost' END AS strategy, 'a' AS focus, CASE WHEN value IS NULL THEN '[CRITICAL] a: Required field ''a'' is missing' || chr(10) || '   Suggestion: Re-extract with focus on finding a' ELSE CASE WHEN confidence < 0.25 THEN '[HIGH]' ELSE '[MEDIUM]' END || ' a: Field ''a'' has low confidence (' || printf('%.2f', confidence) || ' < 0.50)' || chr(10) || '   Suggestion: Re-extract this field or verify manually' END AS issues FROM f WHERE value IS NULL OR confidence < 0.5""",
)
def q_refinement_feedback(spark: SparkSession, d: str) -> DataFrame:
    return results.refinement_feedback(quality.issues(_status_fields(spark, d))).select("doc_id", "strategy", F.array_join("focus_fields", ",").alias("focus"), "issues")
