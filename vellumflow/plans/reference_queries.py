"""Queries of the document-processing operators over the driver's tables, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import boxes as B
from vellumflow.functions import formats, privacy, replies, text, values
from vellumflow.operators import chunk_merge, layout, providers, quality, render, results
from vellumflow.plans.registry import Registry
from vellumflow.session import spread, table
from vellumflow.sources import workbook
from vellumflow.streaming import jobs

registry = Registry()


# ---- text and formats ---------------------------------------------------------------------
@registry.add(
    "q_text_stats",
    r"""WITH d AS (SELECT doc_id, text, replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
    SELECT doc_id, CAST(CASE WHEN t IS NULL OR length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%'||chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS line_count,
    CAST(coalesce(length(t), 0) AS BIGINT) AS char_count, coalesce(length(text) > 16000, false) AS needs_chunking, CAST(coalesce(length(CASE WHEN length(text) > 12000 THEN left(text, 12000) || chr(10) || '... [text truncated] ...' ELSE text END), 0) AS BIGINT) AS prompt_chars FROM d""",
)
def q_text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.line_count(t).alias("line_count"), F.length(text.unix_lines(t)).cast("long").alias("char_count"), text.needs_chunking(t).alias("needs_chunking"), F.length(text.truncated(t)).cast("long").alias("prompt_chars"))


@registry.add(
    "q_encoding_names",
    """WITH e AS (SELECT extraction_id, encoding, replace(replace(lower(encoding), '-', '_'), ' ', '_') AS k FROM text_extractions)
    SELECT extraction_id, CASE WHEN k IN ('utf_8','utf_16','utf_32','iso_8859_1','latin_1') THEN replace(k, '_', '-') WHEN k = 'ascii' THEN 'ascii' WHEN k = 'iso8859_1' THEN 'iso-8859-1' WHEN k = 'latin1' THEN 'latin-1' WHEN k IN ('cp1252','windows_1252') THEN 'cp1252' ELSE replace(k, '_', '-') END AS encoding FROM e""",
)
def q_encoding_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_extractions").select("extraction_id", text.canonical_encoding(F.col("encoding")).alias("encoding"))


# Fixed values, written out once more so that the SQL doesn't follow the code under test.
_DIM = """('.txt', 'text/plain', 'plain_text', 'text_based'), ('.csv', 'text/csv', 'spreadsheet', 'text_based'), ('.pdf', 'application/pdf', 'pdf', 'visual'), ('.doc', 'application/msword', 'document', 'visual'),
    ('.docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'document', 'visual'), ('.odt', 'application/vnd.oasis.opendocument.text', 'document', 'visual'), ('.ppt', 'application/vnd.ms-powerpoint', 'presentation', 'visual'),
    ('.pptx', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'presentation', 'visual'), ('.odp', 'application/vnd.oasis.opendocument.presentation', 'presentation', 'visual'), ('.xlsx', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'spreadsheet', 'structured'),
    ('.jpeg', 'image/jpeg', 'image', 'visual'), ('.jpg', 'image/jpeg', 'image', 'visual'), ('.png', 'image/png', 'image', 'visual'), ('.bmp', 'image/bmp', 'image', 'visual'), ('.psd', 'image/vnd.adobe.photoshop', 'image', 'visual'), ('.tiff', 'image/tiff', 'image', 'visual'), ('.tif', 'image/tiff', 'image', 'visual'), ('.gif', 'image/gif', 'image', 'visual'), ('.webp', 'image/webp', 'image', 'visual')"""


@registry.add(
    "q_format_routing",
    f"""WITH dim(ext, mime, family, category) AS (VALUES {_DIM}), f AS (SELECT file_id, nullif(lower(regexp_extract(file_name, '(\\.[^./\\\\]+)$', 1)), '') AS ext, CASE file_id % 5 WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'audio/ogg' END AS content FROM csv_files),
    j AS (SELECT file_id, f.ext, content, dim.mime AS by_ext FROM f LEFT JOIN dim USING (ext)), m AS (SELECT *, CASE WHEN content = 'text/plain' AND by_ext = 'text/csv' THEN by_ext WHEN content IN (SELECT mime FROM dim) THEN content END AS refined FROM j), r AS (SELECT *, coalesce(refined, by_ext) AS mime FROM m), k AS (SELECT DISTINCT mime, family, category FROM dim)
    SELECT file_id, ext AS extension, r.mime AS mime_type, family AS format_family, category AS processing_category, refined IS NOT NULL AS detected_from_content, CASE WHEN refined IS NOT NULL AND by_ext <> refined THEN ext END AS original_extension, CASE WHEN r.mime IS NULL THEN 'unsupported' ELSE 'ok' END AS status FROM r LEFT JOIN k ON r.mime = k.mime""",
)
def q_format_routing(spark: SparkSession, d: str) -> DataFrame:
    """Uploads by name and by what their content says: none, plain text, two aliases, and a type that isn't supported."""
    k = F.col("file_id") % 5
    content = F.when(k == 1, "text/plain").when(k == 2, "application/csv").when(k == 3, "image/x-ms-bmp").when(k == 4, "audio/ogg")
    info = formats.format_info(F.col("file_name"), content)
    return table(spark, d, "csv_files").select("file_id", info.alias("i")).select("file_id", "i.extension", "i.mime_type", "i.format_family", "i.processing_category", "i.detected_from_content", "i.original_extension", "i.status")


@registry.add(
    "q_supported_formats",
    f"""WITH dim(ext, mime, family, category) AS (VALUES {_DIM}), n AS (SELECT *, row_number() OVER (ORDER BY ext) - 1 AS place FROM dim)
    SELECT csv_files.file_id, ext AS extension, mime AS mime_type, category = 'text_based' AS is_text_based, category = 'visual' AS is_visual, category = 'structured' AS is_structured FROM csv_files JOIN n ON file_id % 19 = place""",
)
def q_supported_formats(spark: SparkSession, d: str) -> DataFrame:
    """Each file under one of the supported extensions, in their sorted order, and the category tests of it."""
    name = F.concat(F.lit("a"), F.get(F.array(*[F.lit(e) for e in formats.supported_extensions()]), (F.col("file_id") % 19).cast("int")))
    rows = table(spark, d, "csv_files").select("file_id", formats.format_info(name, F.lit(None).cast("string")).alias("i"))
    is_of = lambda c: (F.col("i.processing_category") == c).alias(f"is_{c}")
    return rows.select("file_id", "i.extension", "i.mime_type", is_of("text_based"), is_of("visual"), is_of("structured"))


# ---- redaction ----------------------------------------------------------------------------
def _duck_mask(x: str, keep: int) -> str:
    return f"CASE WHEN length({x}) <= {keep} THEN repeat('*', length({x})) ELSE repeat('*', length({x}) - {keep}) || right({x}, {keep}) END"


# Fixed values, written out once more: tax, employer, phone, mail, card, account, birth date, address.
_PATTERNS = (
    r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{2}-\d{7}\b", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?){2}\d{4}\b", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b(?:\d[ -]*?){13,16}\b", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    r"\b(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})\b", r"(?i)\b\d{1,5}\s+[A-Za-z0-9.\-']+\s+(?:Ave|Avenue|St|Street|Rd|Road|Blvd|Lane|Ln|Dr|Drive)\b",
)


def _duck_cascade(column: str) -> str:
    parts, previous = [], column
    for i, p in enumerate(_PATTERNS):
        q = p.replace("'", "''")
        parts.append(f"s{i} AS (SELECT *, CASE WHEN regexp_matches({previous}, '{q}') THEN array_to_string(list_transform(range(1, len(regexp_split_to_array({previous}, '{q}')) + 1), lambda i: regexp_split_to_array({previous}, '{q}')[i] || coalesce({_duck_mask(f"regexp_extract_all({previous}, '{q}')[i]", 4)}, '')), '') ELSE {previous} END AS t{i} FROM {'base' if i == 0 else f's{i - 1}'})")
        previous = f"t{i}"
    return ", ".join(parts)


@registry.add("q_redacted_results", f"WITH base AS (SELECT DISTINCT result_id, extracted_data AS x FROM extraction_results), {_duck_cascade('x')} SELECT result_id, t7 AS redacted FROM s7")
def q_redacted_results(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "extraction_results").select("result_id", "extracted_data"), "result_id").distinct()
    return rows.select("result_id", privacy.redacted_text(F.col("extracted_data")).alias("redacted"))


@registry.add("q_redacted_documents")
def q_redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", privacy.redacted_text(F.col("text")).alias("redacted"))


@registry.add(
    "q_policy_fields",
    f"""SELECT DISTINCT row_id, {_duck_mask('employee_no', 4)} AS employee_no, sha256('salt' || name) AS name, department FROM employee_rows""",
)
def q_policy_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "employee_rows").select("row_id", "employee_no", "name", "department", "email").distinct()
    chosen = privacy.redacted_columns({"employee_no": "mask", "name": "hash", "department": "allow", "email": "drop"}, salt="salt")
    return rows.select("row_id", *chosen).distinct()


# ---- values -------------------------------------------------------------------------------
_STYLES = ("yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "M-d-yyyy", "d.M.yyyy", "M/d/yy", "yyyy.MM.dd", "MMMM d yyyy", "MMM d yyyy")


@registry.add("q_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 14 THEN strftime(o_orderdate, '%d/%Y/%m') WHEN o_orderkey % 15 = 13 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def q_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in all styles and read back; days first where the month could be first as well, and in a form that none reads."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % (len(_STYLES) + 2)
    written = F.when(k == len(_STYLES), F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == len(_STYLES) + 1, F.date_format("o_orderdate", "dd/yyyy/MM"))
    for i, style in enumerate(_STYLES):
        written = written.when(k == i, F.date_format("o_orderdate", style))
    return orders.select("o_orderkey", values.normalised_date(written).alias("iso"))


@registry.add(
    "q_phones",
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+49 ' || c_custkey || ' 5550' WHEN 1 THEN '(212) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '1-212-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE 'ext ' || c_custkey END AS p FROM customer), n AS (SELECT *, regexp_replace(p, '\\D', '', 'g') AS g FROM c)
    SELECT c_custkey, CASE WHEN g = '' THEN p WHEN p LIKE '+%' THEN '+' || g WHEN length(g) = 10 THEN '+1' || g WHEN length(g) >= 11 THEN '+' || g ELSE p END AS phone FROM n""",
)
def q_phones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    last = F.lpad((k % 10000).cast("string"), 4, "0")
    p = F.when(k % 4 == 0, F.concat(F.lit("+49 "), k.cast("string"), F.lit(" 5550"))).when(k % 4 == 1, F.concat(F.lit("(212) 555-"), last)).when(k % 4 == 2, F.concat(F.lit("1-212-555-"), last)).otherwise(F.concat(F.lit("ext "), k.cast("string")))
    return table(spark, d, "customer").select("c_custkey", values.normalised_phone(p).alias("phone"))


@registry.add("q_json_leaves", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IN ('1') AS flag FROM events")
def q_json_leaves(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.try_variant_get(values.tolerant_json(F.col("props")), "$.k", "string")
    return table(spark, d, "events").select("event_id", values.coerced(leaf, "integer").alias("k"), values.coerced(leaf, "boolean").alias("flag"))


@registry.add(
    "q_form_fields",
    """WITH u AS (SELECT form_id, unnest(fields) AS f FROM form_analyses), k AS (SELECT form_id, f, CASE WHEN lower(f.field_type) IN ('text', 'checkbox', 'radio', 'dropdown', 'signature', 'date') THEN lower(f.field_type) ELSE 'text' END AS kind FROM u WHERE f IS NOT NULL),
    c AS (SELECT *, CASE WHEN kind IN ('checkbox', 'radio') AND lower(f.value) IN ('true', 'checked', 'yes', 'selected', 'x', '✓', '☑') THEN true WHEN kind IN ('checkbox', 'radio') AND lower(f.value) IN ('false', 'unchecked', 'no', 'unselected', '', '☐') THEN false END AS checked FROM k)
    SELECT form_id, coalesce(f.label, 'Unknown') AS label, CASE WHEN checked IS NULL THEN f.value END AS value, checked, kind AS field_type, coalesce(f.is_handwritten, false) AS is_handwritten, f.is_required AS is_required, f.position AS position FROM c""",
)
def q_form_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "form_analyses").select("form_id", F.explode("fields").alias("f")).filter(F.col("f").isNotNull())
    made = replies.form_field(*[F.col(f"f.{c}") for c in ("label", "value", "field_type", "is_handwritten", "is_required", "position")])
    return rows.select("form_id", made.alias("m")).select("form_id", "m.*")


# ---- regions ------------------------------------------------------------------------------
_TYPES = ("text", "title", "picture", "table", "caption", "list_item", "page_header")


def _region_id() -> Column:
    return F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))


_REGION_ID = "concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER))"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as regions of a page: an order is a document of one page."""
    li = table(spark, d, "lineitem")
    x0, y0 = (F.col("l_partkey") % 700).cast("double"), (F.col("l_suppkey") % 90 * 9).cast("double")
    kind = F.get(F.array(*[F.lit(t) for t in _TYPES]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(_TYPES)).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), _region_id().alias("region_id"), F.col("l_linenumber").alias("pos"), kind.alias("region_type"), B.box(x0, y0, x0 + F.col("l_quantity") * 8, y0 + F.col("l_quantity") * 8).alias("bbox"), F.lit(1000.0).alias("page_width"), F.lit(1200.0).alias("page_height")
    )


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"
_REGIONS_SQL = f"""regions AS (SELECT l_orderkey AS doc_id, 1 AS page, {_REGION_ID} AS region_id, l_linenumber AS pos, ({_TYPE_LIST})[CAST((l_partkey + l_linenumber) % 7 AS INTEGER) + 1] AS region_type,
    CAST(l_partkey % 700 AS DOUBLE) AS x0, CAST(l_suppkey % 90 * 9 AS DOUBLE) AS y0, CAST(l_partkey % 700 AS DOUBLE) + l_quantity * 8 AS x1, CAST(l_suppkey % 90 * 9 AS DOUBLE) + l_quantity * 8 AS y1 FROM lineitem)"""


@registry.add("q_region_boxes", f"WITH {_REGIONS_SQL} SELECT doc_id, region_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(least(1000, greatest(0, round_even(x0 * (1000.0::DOUBLE / 1000.0::DOUBLE), 0))) AS INTEGER) AS left_1000, CAST(least(1000, greatest(0, round_even(y0 * (1000.0::DOUBLE / 1200.0::DOUBLE), 0))) AS INTEGER) AS top_1000 FROM regions")
def q_region_boxes(spark: SparkSession, d: str) -> DataFrame:
    s = B.scaled(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    return _regions(spark, d).select("doc_id", "region_id", B.area(F.col("bbox")).alias("area"), s["x0"].alias("left_1000"), s["y0"].alias("top_1000"))


@registry.add(
    "q_region_nesting",
    f"""WITH {_REGIONS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, pos, region_id) AS r FROM regions),
    hits AS (SELECT c.doc_id, c.region_id, arg_min(p.region_id, p.r) AS parent_region_id FROM ranked c JOIN ranked p ON c.doc_id = p.doc_id AND c.page = p.page AND c.region_id <> p.region_id
      WHERE c.region_type IN ('caption', 'text') AND p.region_type IN ('picture', 'table') AND (c.x1 - c.x0) * (c.y1 - c.y0) > 0
      AND greatest(0, least(c.x1, p.x1) - greatest(c.x0, p.x0)) * greatest(0, least(c.y1, p.y1) - greatest(c.y0, p.y0)) >= 0.8 * (c.x1 - c.x0) * (c.y1 - c.y0) GROUP BY 1, 2)
    SELECT regions.doc_id, regions.region_id, parent_region_id FROM regions LEFT JOIN hits USING (doc_id, region_id)""",
)
def q_region_nesting(spark: SparkSession, d: str) -> DataFrame:
    return layout.nested(_regions(spark, d)).select("doc_id", "region_id", "parent_region_id")


_LAYOUT_SQL = f"""{_REGIONS_SQL}, c AS (SELECT *, region_type NOT IN ('page_header', 'page_footer', 'footnote') AS content, (y0 + y1) / 2 AS yc, (x0 + x1) / 2 AS xc FROM regions),
    g AS (SELECT *, CASE WHEN yc - lag(yc) OVER (PARTITION BY doc_id, page, content ORDER BY yc) > 100 THEN 1 ELSE 0 END AS fresh FROM c),
    lt AS (SELECT doc_id, page, CASE WHEN count(*) >= 2 AND count(*) FILTER (content) > 3 AND max(xc) FILTER (content) - min(xc) FILTER (content) > 400 AND coalesce(sum(fresh) FILTER (content), 0) + 1 > 1 THEN 'multi_column' ELSE 'single_column' END AS layout_type FROM g GROUP BY 1, 2),
    ord AS (SELECT c.*, layout_type, CAST(row_number() OVER (PARTITION BY c.doc_id, c.page ORDER BY CASE WHEN layout_type = 'multi_column' THEN xc >= 500 ELSE false END, y0, x0, pos, region_id) - 1 AS BIGINT) AS order_index, region_type IN ('page_header', 'page_footer', 'footnote') AS skip FROM c JOIN lt USING (doc_id, page))"""


@registry.add("q_reading_order", f"WITH {_LAYOUT_SQL} SELECT doc_id, region_id, layout_type, order_index, skip FROM ord")
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_regions(spark, d)).select("doc_id", "region_id", "layout_type", "order_index", "skip")


@registry.add("q_region_neighbours", f"WITH {_LAYOUT_SQL} SELECT doc_id, region_id, coalesce(array_to_string(list(region_type) OVER (PARTITION BY doc_id, page ORDER BY order_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS before, coalesce(array_to_string(list(region_type) OVER (PARTITION BY doc_id, page ORDER BY order_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS after, CAST(count(*) OVER (PARTITION BY doc_id, page) AS BIGINT) AS regions_on_page FROM ord")
def q_region_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = layout.neighbours(layout.reading_order(_regions(spark, d)))
    return n.select("doc_id", "region_id", F.array_join("types_before", ",").alias("before"), F.array_join("types_after", ",").alias("after"), "regions_on_page")


@registry.add(
    "q_ordered_content",
    f"WITH {_LAYOUT_SQL}, x AS (SELECT l_orderkey AS doc_id, {_REGION_ID} AS region_id, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END AS body FROM lineitem) SELECT doc_id, region_id, body AS content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, order_index) - 1 AS BIGINT) AS position FROM ord JOIN x USING (doc_id, region_id) WHERE NOT skip AND length(body) > 0",
)
def q_ordered_content(spark: SparkSession, d: str) -> DataFrame:
    content = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _region_id().alias("region_id"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_linestatus")).alias("content"))
    return layout.ordered_content(layout.reading_order(_regions(spark, d)), content).select("doc_id", "region_id", "content", "position")


@registry.add(
    "q_document_shape",
    f"""WITH {_REGIONS_SQL}, m AS (SELECT doc_id, bool_or(apart) AS is_multi_column FROM (SELECT doc_id, coalesce(x1 < lead(x0) OVER (PARTITION BY doc_id, CAST(trunc((y0 + y1) / 2 / 50) AS INTEGER) ORDER BY x0, pos, region_id), false) AS apart FROM regions WHERE region_type IN ('text', 'title')) GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS region_count, count(DISTINCT region_type) AS n_types, bool_or(region_type = 'table') AS has_tables, bool_or(region_type = 'picture') AS has_images, CASE WHEN (max(x1) - min(x0)) * (max(y1) - min(y0)) = 0 THEN 0 ELSE sum(CASE WHEN region_type IN ('text', 'list_item', 'section_header') THEN (x1 - x0) * (y1 - y0) ELSE 0 END) / ((max(x1) - min(x0)) * (max(y1) - min(y0))) END AS dens FROM regions GROUP BY 1)
    SELECT doc_id, CAST(region_count AS BIGINT) AS region_count, has_tables, has_images, coalesce(is_multi_column, false) AS is_multi_column, CASE WHEN dens < 0.3 THEN 'sparse' WHEN dens > 0.7 THEN 'dense' ELSE 'normal' END AS text_density, CASE WHEN has_tables OR has_images OR coalesce(is_multi_column, false) THEN 'complex' WHEN n_types > 3 THEN 'moderate' ELSE 'simple' END AS complexity FROM s LEFT JOIN m USING (doc_id)""",
)
def q_document_shape(spark: SparkSession, d: str) -> DataFrame:
    return layout.characteristics(_regions(spark, d)).select("doc_id", "region_count", "has_tables", "has_images", "is_multi_column", "text_density", "complexity")


# ---- quality ------------------------------------------------------------------------------
_REQUIRED, _OPTIONAL = ("text", "lang", "source"), ("label", "annotator")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their hand labels as extractions of five fields."""
    labels = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("annotator").alias("annotator"))
    rows = table(spark, d, "documents").select("doc_id", "source", "text", "lang").join(labels, "doc_id", "left")
    confidence = lambda c: F.when(F.col(c).isNotNull(), (F.length(c) % 10) / 10.0)
    made = F.array(*[F.struct(F.lit(c).alias("field_path"), F.col(c).alias("value"), F.lit(c in _REQUIRED).alias("required"), confidence(c).alias("confidence")) for c in (*_REQUIRED, *_OPTIONAL)])
    return rows.select("doc_id", F.inline(made))


_FIELDS_SQL = """lab AS (SELECT doc_id, max(label) AS label, max(annotator) AS annotator FROM doc_labels GROUP BY 1), docs AS (SELECT doc_id, text, lang, source, label, annotator FROM documents LEFT JOIN lab USING (doc_id)),
    f AS (""" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field_path, {c} AS value, {str(c in _REQUIRED).lower()} AS required, CASE WHEN {c} IS NOT NULL THEN (length({c}) % 10)::DOUBLE / 10.0::DOUBLE END AS confidence FROM docs" for c in (*_REQUIRED, *_OPTIONAL)) + ")"  # fmt: skip
_ISSUES_SQL = """i AS (SELECT doc_id, field_path, 'missing_required_field' AS issue_type, 'critical' AS severity, 'Required field ''' || field_path || ''' is missing' AS message, 'Re-extract with focus on finding ' || field_path AS suggestion FROM f WHERE required AND value IS NULL
    UNION ALL SELECT doc_id, field_path, 'low_confidence', CASE WHEN confidence < 0.25 THEN 'high' ELSE 'medium' END, 'Field ''' || field_path || ''' has low confidence (' || printf('%.2f', confidence) || ' < 0.50)', 'Re-extract this field or verify manually' FROM f WHERE confidence < 0.5
    UNION ALL SELECT doc_id, field_path, 'empty_array', 'high', 'Required array field ''' || field_path || ''' is empty', 'Re-extract to populate ' || field_path || ' array' FROM f WHERE required AND regexp_replace(value, '\\s', '', 'g') = '[]')"""
_REPORT_SQL = f"""{_FIELDS_SQL}, {_ISSUES_SQL}, ic AS (SELECT doc_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM i GROUP BY 1),
    mm AS (SELECT doc_id, count(*) FILTER (required AND value IS NULL) = 0 AS complete, count(value)::DOUBLE / count(*) AS schema_coverage, (count(*) FILTER (required AND value IS NOT NULL))::DOUBLE / (count(*) FILTER (required)) AS required_coverage, (count(*) FILTER (NOT required AND value IS NOT NULL))::DOUBLE / (count(*) FILTER (NOT required)) AS optional_coverage, avg(confidence) AS conf FROM f GROUP BY 1),
    r AS (SELECT mm.*, 0.7::DOUBLE * required_coverage + 0.3::DOUBLE * optional_coverage AS completeness, coalesce(conf, least(1, greatest(0, 0.6 * required_coverage + 0.3 * schema_coverage + 0.1 + CASE WHEN required_coverage >= 1 THEN 0.05 ELSE 0 END))) AS overall, coalesce(c, 0) AS c, coalesce(h, 0) AS h, coalesce(m, 0) AS m FROM mm LEFT JOIN ic USING (doc_id)),
    s AS (SELECT *, greatest(0.0::DOUBLE, 1 - 0.3::DOUBLE * c - 0.15::DOUBLE * h - 0.05::DOUBLE * m) AS consistency FROM r),
    rep AS (SELECT *, CASE WHEN c > 0 THEN 'failed' WHEN required_coverage < 0.9 THEN 'failed' WHEN overall < 0.7 THEN 'needs_improvement' WHEN h >= 3 THEN 'needs_improvement' WHEN consistency < 0.5 THEN 'needs_improvement' ELSE 'passed' END AS status FROM s)"""


@registry.add("q_quality_by_source", f"WITH {_REPORT_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n, round(CAST(avg(completeness) AS DOUBLE), 6) AS completeness, round(CAST(avg(overall) AS DOUBLE), 6) AS confidence, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS n_failed FROM rep JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1")
def q_quality_by_source(spark: SparkSession, d: str) -> DataFrame:
    judged = quality.report(_fields(spark, d)).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return judged.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("completeness"), 6).alias("completeness"), F.round(F.avg("overall_confidence"), 6).alias("confidence"), F.count_if(F.col("status") == "failed").alias("n_failed"))


@registry.add("q_quality_report", f"WITH {_REPORT_SQL} SELECT doc_id, round(required_coverage, 6) AS required_coverage, round(completeness, 6) AS completeness, round(overall, 6) AS overall_confidence, CAST(c AS BIGINT) AS critical_issues, CAST(h AS BIGINT) AS high_issues, round(consistency, 6) AS consistency, status FROM rep")
def q_quality_report(spark: SparkSession, d: str) -> DataFrame:
    r = quality.report(_fields(spark, d))
    return r.select("doc_id", *[F.round(c, 6).alias(c) for c in ("required_coverage", "completeness", "overall_confidence")], "critical_issues", "high_issues", F.round("consistency", 6).alias("consistency"), "status")


@registry.add("q_issues", f"WITH {_FIELDS_SQL}, {_ISSUES_SQL} SELECT doc_id, field_path, issue_type, severity, message, suggestion FROM i")
def q_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(_fields(spark, d)).select("doc_id", "field_path", "issue_type", "severity", "message", "suggestion")


def _passes(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in time order as the passes over a document."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.row_number().over(w).cast("long").alias("iteration"), F.col("value").alias("score"), "event_type")


_PASSES_SQL = "p AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS iteration, value AS score, event_type FROM events)"


@registry.add("q_best_pass", f"WITH {_PASSES_SQL} SELECT doc_id, iteration, score, event_type FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, iteration) = 1")
def q_best_pass(spark: SparkSession, d: str) -> DataFrame:
    return quality.best_pass(_passes(spark, d))


@registry.add("q_pass_deltas", f"WITH {_PASSES_SQL} SELECT doc_id, iteration, round(score - lag(score) OVER w, 6) AS d_score, max(score) OVER (PARTITION BY doc_id ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS best_so_far FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY iteration)")
def q_pass_deltas(spark: SparkSession, d: str) -> DataFrame:
    return quality.deltas(_passes(spark, d), ["score"]).select("doc_id", "iteration", F.round("d_score", 6).alias("d_score"), "best_so_far")


# ---- merging, rendering, tables -----------------------------------------------------------
@registry.add(
    "q_chunk_merge",
    """SELECT l_orderkey AS doc_id, arg_min(nullif(l_returnflag, 'N'), CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey) FILTER (nullif(l_returnflag, 'N') IS NOT NULL) AS flag, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS statuses, CAST(arg_min(l_quantity, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1""",
)
def q_chunk_merge(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("chunk_idx"), F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.array("l_linestatus").alias("statuses"), F.struct(F.col("l_quantity").cast("double").alias("quantity")).alias("detail"))
    merged = chunk_merge.merge_chunks(chunks)
    return merged.select("doc_id", "flag", F.array_join(F.array_sort("statuses"), ",").alias("statuses"), F.col("detail.quantity").alias("quantity"))


@registry.add("q_markdown", "SELECT r_regionkey AS doc_id, '# ' || r_name || chr(10) || chr(10) || '## Extracted Data' || chr(10) || chr(10) || string_agg('- **' || n_name || ':** ' || n_nationkey || ' (' || CAST(round_even(n_nationkey * 0.01::DOUBLE * 100, 0) AS INTEGER) || '%)', chr(10) ORDER BY n_nationkey) AS markdown FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name")
def q_markdown(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = joined.select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("title"), F.col("n_nationkey").alias("field_order"), F.col("n_name").alias("field_path"), F.col("n_nationkey").cast("string").alias("value"), (F.col("n_nationkey") * 0.01).alias("confidence"))
    return render.documents_markdown(fields)


@registry.add("q_sheet_rows", "SELECT CAST(s_suppkey + 1 AS BIGINT) AS row_idx, 'A=' || s_suppkey || ';B=' || s_name AS row_text FROM supplier")
def q_sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as spreadsheet cells, gathered to rows again."""
    cell = lambda i, v: F.struct(F.lit(i).alias("col_idx"), v.cast("string").alias("value"))
    cells = table(spark, d, "supplier").select(F.lit("s").alias("sheet"), (F.col("s_suppkey") + 1).alias("row_idx"), F.inline(F.array(cell(1, F.col("s_suppkey")), cell(2, F.col("s_name")), cell(3, F.col("s_nationkey")))))
    rows = workbook.rows_of(cells, (1, 1 << 30), ["A", "B"])
    return rows.select("row_idx", F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("row_text"))


# ---- jobs ---------------------------------------------------------------------------------
@registry.add(
    "q_job_lifecycle",
    """WITH s AS (SELECT *, CASE event_type WHEN 'signup' THEN 'scheduled' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'lost' END AS state FROM events)
    SELECT event_id, CASE WHEN state IN ('scheduled', 'queued') THEN 'pending' WHEN state = 'running' THEN 'processing' WHEN state = 'completed' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN state IN ('scheduled', 'queued', 'running') THEN 425 WHEN state = 'completed' THEN 200 ELSE 500 END AS result_code,
    ts + INTERVAL 24 HOUR AS expires_at, CASE WHEN (SELECT max(ts) FROM events) > ts + INTERVAL 24 HOUR THEN 410 ELSE 200 END AS code FROM s""",
)
def q_job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Events as executions in all states, read at the time of the last one."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    state = F.when(kind == "signup", "scheduled").when(kind == "view", "queued").when(kind == "click", "running").when(kind == "purchase", "completed").otherwise("lost")
    now, until, status = e.agg(F.max("ts").alias("now")).scalar(), jobs.expires_at(F.col("ts")), jobs.job_status(state)
    return e.select("event_id", status.alias("status"), jobs.result_status(status).alias("result_code"), until.alias("expires_at"), jobs.lookup_status(until, now).alias("code"))


@registry.add("q_retention", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (ts < now - INTERVAL 7 DAY) AS BIGINT) AS removed, CAST(count(*) FILTER (NOT ts < now - INTERVAL 7 DAY) AS BIGINT) AS skipped FROM events, n")
def q_retention(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("ts", "modificationTime")
    return jobs.retention_counts(jobs.retention(e, e.agg(F.max("modificationTime").alias("now")).scalar(), 7))


@registry.add("q_rule_extraction")
def q_rule_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Label rules over all documents, loose ones on those they left, the best pass of each."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return quality.best_pass(providers.refine(docs, ["rules", "loose_rules"], ["Vendor"], ["Region", "Terms"])).select("doc_id", "iteration", "status", "data")


# ---- results ------------------------------------------------------------------------------
@registry.add(
    "q_passed_checks",
    f"""WITH {_REPORT_SQL} SELECT doc_id, regexp_replace(concat_ws('|', CASE WHEN required_coverage >= 0.9 THEN 'Required field coverage (100%) meets threshold (90%)' END, CASE WHEN overall >= 0.7 THEN 'Overall confidence (0.70) meets threshold (0.70)' END, 'Schema validation passed', CASE WHEN complete THEN 'All required fields present' END), '[0-9.]+%?', '#', 'g') AS passed FROM rep""",
)
def q_passed_checks(spark: SparkSession, d: str) -> DataFrame:
    """Numbers are compared by the tests, not here: two engines round halves of binary fractions differently."""
    return quality.report(_fields(spark, d)).select("doc_id", F.regexp_replace(F.array_join(results.passed_checks(), "|"), "[0-9.]+%?", "#").alias("passed"))


@registry.add("q_issue_feedback", f"WITH {_FIELDS_SQL}, {_ISSUES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), CASE issue_type WHEN 'missing_required_field' THEN 1 WHEN 'low_confidence' THEN 2 ELSE 3 END, field_path) AS place FROM i) SELECT doc_id, string_agg('[' || upper(severity) || '] ' || field_path || ': ' || message || ' (' || suggestion || ')', chr(10) ORDER BY place) AS feedback FROM r WHERE place <= 10 GROUP BY 1")
def q_issue_feedback(spark: SparkSession, d: str) -> DataFrame:
    return results.feedback(quality.issues(_fields(spark, d))).select("doc_id", "feedback")


@registry.add("q_attachments", f"WITH {_REGIONS_SQL} SELECT doc_id, region_id, region_type FROM regions WHERE region_type IN ('table', 'picture') UNION ALL SELECT o_orderkey, 'fallback_full_image', 'picture' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM regions)")
def q_attachments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return results.attachments(_regions(spark, d), docs).select("doc_id", "region_id", "region_type")


@registry.add("q_job_upsert", "WITH u AS (SELECT user_id AS job_id, nullif(event_type, 'view') AS state, ts AS updated_at, event_id FROM events) SELECT job_id, state, updated_at FROM u QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, state IS NULL DESC, state DESC) = 1 AND state IS NOT NULL")
def q_job_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newer half of the events merged into the jobs that the older half left."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.nullif("event_type", F.lit("view")).alias("state"), F.col("ts").alias("updated_at"))
    middle = e.agg(F.timestamp_seconds((F.unix_timestamp(F.min("updated_at")) + F.unix_timestamp(F.max("updated_at"))) / 2).cast(e.schema["updated_at"].dataType).alias("middle")).scalar()
    older, newer = e.filter(F.col("updated_at") < middle), e.filter(F.col("updated_at") >= middle)
    return results.upserted(results.upserted(older.limit(0), older), newer)


@registry.add("q_result_records")
def q_result_records(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    extracted = providers.extract(docs, ["Vendor", "Region"])
    return results.result_records(quality.report(providers.field_rows(extracted, ["Vendor"], ["Region"])), extracted)
